"""Column expressions that read what a language model answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnstore import settings as S
from turnstore.functions.text import lines, strip

# The shapes of reply that are understood.
REASONING = r"(?s)<think>.*?</think>(?U)[\s\x1c-\x1f]*"
JSON_OBJECT = r"(?s)\{.*\}"
LIST_LINE = r"(?U)^(?:[-*]|\d+[.)]|\[)"
BULLET = r"(?U)^(?:[-*]|\d+[.)])[\s\x1c-\x1f]*"
QUOTES_AND_SPACES = ' "'

# What the recalling and the reflecting model are shown.
OPTION_SEPARATOR = " | "
RECALL_PROMPT = ("Question: ", "\nAnswer options: ")
REFLECTION_PROMPT = ("Original question: ", "Answer options: ", "\nRetrieved evidence:\n", "- ")

_STRICT = {"allowSingleQuotes": "false", "allowUnquotedControlChars": "false"}


def strip_reasoning(reply: Column) -> Column:
    """Drop closed reasoning blocks; a block that never closes empties the reply."""
    rest = F.regexp_replace(reply, REASONING, "")
    return F.when(rest.contains("<think>"), "").otherwise(strip(rest))


def _json_fields(text: Column) -> Column:
    """Fields of the outermost ``{...}`` as text, null when it is not one JSON object."""
    body = F.regexp_extract(text, JSON_OBJECT, 0)
    alone = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    return F.when(alone, F.from_json(body, "map<string,string>", _STRICT))


def _listed_facts(text: Column) -> Column:
    """Bulleted, numbered or bracketed lines; prose is not a list of facts."""
    listed = F.filter(F.transform(lines(text), strip), lambda x: x.rlike(LIST_LINE))
    cleaned = F.transform(
        listed, lambda x: F.btrim(F.regexp_replace(x, BULLET, ""), F.lit(QUOTES_AND_SPACES)))
    return F.filter(cleaned, lambda x: F.length(x) > S.MIN_FACT_CHARS)


def add_facts(replied: DataFrame, reply: str = "reply", out: str = "facts",
              max_facts: int | None = S.MAX_FACTS) -> DataFrame:
    """Add the array of facts in a model's reply, at most *max_facts* (None: all); empty for a null reply.

    An object whose ``facts`` is a list is taken at its word, also when the list
    is absent or empty. Everything else is searched for list lines. Items that
    are not strings are kept as JSON text, JSON nulls are dropped. The steps are
    columns of their own, so the reply is cleaned and parsed once per row.
    """
    parsed = (replied.withColumn("_text", strip_reasoning(F.col(reply)))
              .withColumn("_fields", _json_fields(F.col("_text")))
              .withColumn("_items", F.from_json(F.col("_fields")["facts"], "array<string>")))
    none = F.array().cast("array<string>")
    listed = F.filter(F.transform("_items", strip), lambda x: x != "")
    facts = (F.when(F.col("_fields").isNotNull() & ~F.map_contains_key("_fields", "facts"), none)
             .when(F.col("_fields")["facts"].startswith("[") & F.col("_items").isNotNull(), listed)
             .otherwise(_listed_facts(F.col("_text"))))
    status = (F.when(F.col("_text").isNull(), "failed")
              .when((F.col("_text") != "") & (F.size(out) == 0), "empty").otherwise("ok"))
    facts = F.coalesce(facts, none)
    return (parsed.withColumn(out, facts if max_facts is None else F.slice(facts, 1, max_facts))
            .withColumn("_outcome", status).drop("_text", "_fields", "_items"))


def recall_question(reply: Column) -> Column:
    """First line without quotes; null when the model gave nothing."""
    first = F.btrim(F.element_at(lines(reply), 1), F.lit(QUOTES_AND_SPACES))
    return F.nullif(first, F.lit(""))


def follow_up_question(reply: Column) -> Column:
    """The question of an INCOMPLETE reflection, else null."""
    # A one-element array binds the parsed fields, so they are read once.
    asked = F.transform(F.array(_json_fields(reply)), lambda f: F.when(
        f["status"] == "INCOMPLETE", F.nullif(f["question"], F.lit(""))))
    return asked[0]


def options_text(options: Column, most: int | None = S.PROMPT_OPTIONS) -> Column:
    """The first *most* answer options on one line (None: all), null without options."""
    shown = options if most is None else F.slice(options, 1, most)
    return F.when(F.size(options) > 0, F.array_join(shown, OPTION_SEPARATOR))


def recall_prompt(query: Column, options: Column, most_options: int | None = S.PROMPT_OPTIONS) -> Column:
    asked, offered = map(F.lit, RECALL_PROMPT)
    shown = F.concat(offered, options_text(options, most_options))
    return F.concat(asked, query, F.coalesce(shown, F.lit("")))


def reflection_prompt(query: Column, options: Column, evidence: Column, items: int | None = S.REFLECT_ITEMS,
                      chars: int | None = S.REFLECT_CHARS, most_options: int | None = S.PROMPT_OPTIONS) -> Column:
    """*evidence* is the array of result contents, best first: *items* of them, *chars* of each (None: all)."""
    asked, offered, found, bullet = map(F.lit, REFLECTION_PROMPT)
    shown = F.coalesce(F.concat(offered, options_text(options, most_options), F.lit("\n")), F.lit(""))
    snippets = F.transform(evidence if items is None else F.slice(evidence, 1, items),
                           lambda c: F.concat(bullet, c if chars is None else F.substring(c, 1, chars)))
    return F.concat(asked, query, F.lit("\n"), shown, found, F.array_join(snippets, "\n"))
