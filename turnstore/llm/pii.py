"""Personal data: protected entities by pattern, and the terms that reveal them.

E-mail addresses, IP addresses, card and phone numbers are found by pattern. A term
discloses such an entity if, over the whole corpus, knowing the term makes the entity
likely: P(entity | term), from the number of distinct texts that hold both, anywhere,
and the number of all distinct texts that hold the term. The estimate counts one text
more that holds the term alone, so that one text is no evidence and a few are some.
Terms over the upper threshold are removed, terms over the lower one are generalised.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BinaryType, LongType, StringType, StructField, StructType)

from turnstore.runtime import cut_lineage, small_side

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE = "generalise", "remove"
# A term is generalised from this P(entity | term) on, and removed from the second on.
GENERALISE_AT, REMOVE_AT = 0.6, 0.9
# Texts that are supposed to hold a term without the entity, beside those counted.
PRIOR_TEXTS = 1
# Most memory for disclosing terms that are sent to every task, and what one takes beside its text.
SENT_BYTES, TERM_BYTES = 32 << 20, 150
# Most entities of several texts that are sent to every task.
ENTITY_ROWS = 50_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", GENERALISE: "[TERM]", REMOVE: ""}

Span = tuple[int, int]


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: from the first character that may belong to the name before an ``@``."""
    least = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > least and _NAME.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        least = domain.end() if domain else at + 1
        if domain:
            yield start, least
        at = text.find("@", least)


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans (code points, end exclusive) by kind, leftmost and non-overlapping within a kind.

    A match that fails the check of its kind is dropped, and nothing inside it is tried again.
    """
    found: dict[str, list[Span]] = {"email": list(_emails(text)), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


def _entities(text: str) -> set[str]:
    """Protected entities: addresses in lower case, numbers as their digits."""
    return {f"{kind}:{_digits(text[a:b]) if kind in ('card', 'phone') else text[a:b].lower()}"
            for kind, spans in base_spans(text).items() for a, b in spans}


def _terms(text: str) -> set[str]:
    return set(map(str.lower, _TERM.findall(text)))


def _free_terms(text: str) -> set[str]:
    """Terms that occur outside the entities."""
    taken = sorted(s for spans in base_spans(text).values() for s in spans)
    at, parts = 0, []
    for start, end in taken:
        parts.append(text[at:max(at, start)])
        at = max(at, end)
    whole = _terms(text)
    return whole & _terms("\n".join([*parts, text[at:]]))


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _own_terms(texts: DataFrame) -> DataFrame:
    """(key, terms) of the distinct texts; terms parted by spaces."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(map(_key, texts), pa.binary()),
                "terms": pa.array([" ".join(sorted(_terms(t))) for t in texts], pa.string())})

    # Copies fold here, so that texts are counted afterwards and not their keys.
    return texts.mapInArrow(read, "key binary, terms string").distinct()


def _protected(texts: DataFrame) -> DataFrame:
    """(key, entities, terms) of the distinct texts that hold an entity, with the terms outside of entities."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(t, e) for t in batch.column("text").to_pylist() if (e := _entities(t))]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([_key(t) for t, _ in found], pa.binary()),
                "entities": pa.array([sorted(e) for _, e in found], pa.list_(pa.string())),
                "terms": pa.array([sorted(_free_terms(t)) for t, _ in found], pa.list_(pa.string()))})

    return texts.mapInArrow(read, "key binary, entities array<string>, terms array<string>").distinct()


def disclosing_terms(docs: DataFrame, generalise_at: float = GENERALISE_AT, prior_texts: float = PRIOR_TEXTS) -> DataFrame:
    """(term, likelihood, estimate) of the terms that make some entity likely, over all of *docs*.

    Equal texts count once. The likelihood is the share as counted; the estimate, which
    is at least *generalise_at*, has *prior_texts* more texts below the line.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    protected = cut_lineage(_protected(texts))
    holds = cut_lineage(protected.select("key", F.explode("entities").alias("entity")))
    # Entities of the same texts are as likely as each other: one stands for all.
    same = cut_lineage(holds.groupBy("entity").agg(
        F.count("*").alias("n_texts"), F.bit_xor(F.xxhash64("key")).alias("mark"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("mark_2")))
    # No term is likelier to come with an entity than one that occurs in all its texts and nowhere else.
    likely = same.where(F.col("n_texts") / (F.col("n_texts") + prior_texts) >= generalise_at)
    groups = holds.join(small_side(likely, ENTITY_ROWS), "entity").select("key", "n_texts", "mark", "mark_2").distinct()
    both = (groups.join(protected.select("key", "terms"), "key")
            .select("n_texts", "mark", "mark_2", F.explode("terms").alias("term"))
            .groupBy("n_texts", "mark", "mark_2", "term").agg(F.count("*").alias("n_both"))
            .groupBy("term").agg(F.max("n_both").alias("n_both"))
            .where(F.col("n_both") / (F.col("n_both") + prior_texts) >= generalise_at))
    both = cut_lineage(both)
    counts = (_own_terms(texts).select(F.explode(F.split("terms", " ")).alias("term")).where("term <> ''")
              .groupBy("term").agg(F.count("*").alias("n")))
    return (counts.join(both, "term")
            .select("term", (F.col("n_both") / F.col("n")).alias("likelihood"),
                    (F.col("n_both") / (F.col("n") + prior_texts)).alias("estimate"))
            .where(F.col("estimate") >= generalise_at))


def _with_terms(docs: DataFrame, generalise_at: float, remove_at: float, prior_texts: float,
                sent_bytes: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[dict[str, str]]]]:
    """*docs*, and what gives each row of a batch of them its disclosing terms, by kind.

    A small table of terms is sent to every task. A larger one meets the terms of the
    texts in a shuffle, and each row brings its own few in a column ``_terms``.
    """
    kind = F.when(F.col("estimate") >= remove_at, REMOVE).otherwise(GENERALISE)
    terms = cut_lineage(disclosing_terms(docs, generalise_at, prior_texts).select("term", kind.alias("kind")))
    size = terms.agg(F.sum(F.octet_length("term") + TERM_BYTES)).first()[0] or 0
    if size <= sent_bytes:
        rows = terms.toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(
            dict(zip(rows.column("term").to_pylist(), rows.column("kind").to_pylist())))
        return docs, lambda batch: [sent.value] * batch.num_rows
    text = F.col("text").cast("string")
    own = _own_terms(docs.select(text.alias("text")).where("text is not null"))
    few = (own.select("key", F.explode(F.split("terms", " ")).alias("term")).join(terms, "term")
           .groupBy("key").agg(F.collect_list(F.struct("term", "kind")).alias("_terms")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [None if t is None else _key(t) for t in batch.column("text").cast(pa.string()).to_pylist()]
            yield batch.append_column("_key", pa.array(keys, pa.binary()))

    schema = StructType([*docs.schema.fields, StructField("_key", BinaryType())])
    few = cut_lineage(few).withColumnRenamed("key", "_key")
    joined = docs.mapInArrow(keyed, schema).join(few, "_key", "left").drop("_key")
    return joined, lambda batch: [{x["term"]: x["kind"] for x in own or ()} for own in batch.column("_terms").to_pylist()]


def all_spans(text: str, kinds: dict[str, str]) -> dict[str, list[Span]]:
    """Base spans, and the disclosing terms outside them, by kind."""
    found = base_spans(text)
    found[GENERALISE], found[REMOVE] = [], []
    if kinds and not kinds.keys().isdisjoint(_terms(text)):
        taken = sorted(s for k in KINDS for s in found[k])
        for m in _TERM.finditer(text):
            kind = kinds.get(m[0].lower())
            if kind and not any(a < m.end() and m.start() < b for a, b in taken):
                found[kind].append(m.span())
    return found


_SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])


def find_personal_data(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT,
                       prior_texts: float = PRIOR_TEXTS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Per row of *docs* (doc_id, text): doc_id, spans (array of kind, start, end).

    Spans are ordered by kind (email, ip, card, phone, generalise, remove), then start;
    a null text has none. Repeated rows are judged one by one and count once as evidence.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows, kinds_of = _with_terms(rows, generalise_at, remove_at, prior_texts, sent_bytes)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, of in all_spans(text or "", kinds).items() for a, b in of]
                     for text, kinds in zip(batch.column("text").to_pylist(), kinds_of(batch))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, kind)})

    schema = StructType([docs.schema["doc_id"], StructField("spans", ArrayType(_SPAN))])
    return rows.mapInArrow(run, schema)


def sanitised(text: str, kinds: dict[str, str]) -> str:
    """*text* with placeholders for entities and generalised terms, and without removed terms.

    Where spans of two kinds overlap, the one that starts first is replaced, with all it overlaps.
    """
    spans = sorted((a, -b, k) for k, of in all_spans(text, kinds).items() for a, b in of)
    out, at = [], 0
    for start, minus_end, kind in spans:
        if start >= at:
            out += [text[at:start], _PLACEHOLDER[kind]]
        at = max(at, -minus_end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT,
             prior_texts: float = PRIOR_TEXTS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """*docs* with sanitised texts; all rows and other columns stay, null texts too.

    A column ``n_chars`` of whole numbers is set to the length of the new text.
    """
    rows, kinds_of = _with_terms(docs, generalise_at, remove_at, prior_texts, sent_bytes)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = [None if t is None else sanitised(t, kinds)
                     for t, kinds in zip(batch.column(place).to_pylist(), kinds_of(batch))]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type)).select(names)

    done = rows.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, LongType):
        done = done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done
