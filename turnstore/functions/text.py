"""Column expressions over message text, timestamps and memory ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnstore import settings as S

# Every character that counts as white space: the Unicode white space set plus
# the four ASCII information separators.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Formats and patterns shared with existing stores.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
LINE_BREAK = r"\R|[\x1c-\x1e]"
MEMORY_ID = r"^([0-9a-f]{16})-([rf])([0-9]+)$"
EPOCH = "1970-01-01 00:00:00"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def lines(text: Column) -> Column:
    """Split on every Unicode line boundary."""
    return F.split(text, LINE_BREAK)


def millis(timestamp: Column) -> Column:
    """Milliseconds since the epoch; seconds are scaled, impossible values are null."""
    ms = F.when((timestamp > 0) & (timestamp < S.SECONDS_BELOW), timestamp * 1000).otherwise(timestamp)
    return F.when(ms.between(S.MIN_MILLIS, S.MAX_MILLIS), ms)


def utc_text(ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the zone of the session."""
    seconds = F.floor(ms / 1000).cast("decimal(18,6)")
    moment = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.substring(moment.cast("string"), 1, len(EPOCH))


def created_at(timestamp: Column) -> Column:
    """ISO-8601 in UTC; microseconds only when they are not zero."""
    ms = millis(timestamp)
    rest = F.pmod(ms, F.lit(1000))
    fraction = F.when(rest == 0, "").otherwise(F.format_string(".%03d000", rest))
    return F.concat(F.replace(utc_text(ms), F.lit(" "), F.lit("T")), fraction, F.lit("Z"))


def stamp_prefix(timestamp: Column) -> Column:
    """``[YYYY-MM-DD HH:MM] `` or an empty string."""
    minute = F.substring(utc_text(millis(timestamp)), 1, len("yyyy-MM-dd HH:mm"))
    return F.coalesce(F.concat(F.lit("["), minute, F.lit("] ")), F.lit(""))


def speaker(role: Column) -> Column:
    """``I`` for the user, otherwise the role with only its first letter in upper case."""
    name = F.when(F.coalesce(role, F.lit("")) == "", "other").otherwise(role)
    label = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 2_147_483_647)))
    return F.when(role == "user", "I").otherwise(label)


def digest(user_id: Column, request_id: Column) -> Column:
    """Sixteen hex digits naming one user's request."""
    return F.substring(F.sha1(F.concat(user_id, F.lit("\0"), request_id)), 1, 16)


def memory_id(chunk: Column, kind: Column, index: Column) -> Column:
    """``<digest>-r<position>`` or ``<digest>-f<number>``."""
    return F.concat(chunk, F.lit("-"), F.substring(kind, 1, 1), index.cast("string"))


def id_part(memory: Column, part: int) -> Column:
    """Digest (1), kind letter (2) or index (3) of a well-formed id, else null."""
    return F.nullif(F.regexp_extract(memory, MEMORY_ID, part), F.lit(""))


def id_digest(memory: Column) -> Column:
    return id_part(memory, 1)


def id_kind(memory: Column) -> Column:
    return F.when(id_part(memory, 2) == "r", "raw").when(id_part(memory, 2) == "f", "fact")


def id_index(memory: Column) -> Column:
    return id_part(memory, 3).cast("int")


def dedupe_key(content: Column) -> Column:
    """Two memories with the same key count as one."""
    folded = F.btrim(F.regexp_replace(F.lower(content), SPACE_RUN, " "), F.lit(" "))
    return F.substring(folded, 1, S.DEDUPE_KEY_CHARS)
