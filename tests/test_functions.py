import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnstore.functions import replies as R, text as X
from turnstore.functions.vectors import blend, embed, hashed_embedder


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_timestamps(spark):
    cases = [None, 1_684_576_800, 0, -1, 10**18, 1_684_576_800_123, 99_999_999_999, 100_000_000_000]
    stamps = values(spark, X.created_at(F.col("x")), cases, "x bigint")
    prefixes = values(spark, X.stamp_prefix(F.col("x")), cases, "x bigint")
    assert stamps == [None, "2023-05-20T10:00:00Z", "1970-01-01T00:00:00Z", "1969-12-31T23:59:59.999000Z", None,
                      "2023-05-20T10:00:00.123000Z", "5138-11-16T09:46:39Z", "1973-03-03T09:46:40Z"]
    assert prefixes[:2] == ["", "[2023-05-20 10:00] "] and prefixes[4] == ""
    for ms, got in zip(cases, stamps):
        if got and ms > 10**11:
            moment = dt.datetime.fromtimestamp(ms / 1000, tz=dt.timezone.utc)
            assert got == moment.isoformat().replace("+00:00", "Z")


def test_speaker(spark):
    got = values(spark, X.speaker(F.col("x")), ["user", "ASSISTANT", "tool bot", "", None, "User"], "x string")
    assert got == ["I", "Assistant", "Tool bot", "Other", "Other", "User"]


def test_ids(spark):
    row = spark.range(1).select(
        X.memory_id(X.digest(F.lit("u"), F.lit("r")), F.lit("raw"), F.lit(3)).alias("a"),
        X.memory_id(X.digest(F.lit("v"), F.lit("r")), F.lit("fact"), F.lit(0)).alias("b")).first()
    assert row.a.endswith("-r3") and row.b.endswith("-f0") and row.a[:16] != row.b[:16]
    ids = [row.a, row.b, "nonsense", row.a + "x", row.a.upper()]
    assert values(spark, X.id_kind(F.col("x")), ids, "x string") == ["raw", "fact", None, None, None]
    assert values(spark, X.id_index(F.col("x")), ids, "x string") == [3, 0, None, None, None]


def test_dedupe_key_and_lengths(spark):
    expected = {"Some\tText  here": "some text here", "some text　here ": "some text here", "a" * 120 + "b": "a" * 120,
                "a" * 120 + "c": "a" * 120, "\x1c x\x85y \x0bz": "x y z", "ÄB\n\nc": "äb c", "\u2003": "", "": ""}
    assert values(spark, X.dedupe_key(F.col("x")), list(expected), "x string") == list(expected.values())
    assert values(spark, F.length("x"), ["a😀b"], "x string") == [3]


REPLIES = {
    "<think>long\nthought</think>\n{\"facts\": [\" one \", \"\", \"two\"]}": ["one", "two"],
    "<think>never closed {\"facts\": [\"no\"]}": [],
    "The user likes tea. They said so on Monday.": [],
    "- likes tea\n* \"has a dog\"\n1. moved to Rome\n2) abc\n- ok\n[2023-05-20] ran\nprose": [
        "likes tea", "has a dog", "moved to Rome", "[2023-05-20] ran"],
    "{\"facts\": []}": [],
    "{\"other\": 1}": [],
    "{\"facts\": null}\n- kept line": ["kept line"],
    "{\"facts\": \"text\"}\n- kept line": ["kept line"],
    "{\"facts\": [1, true, null, {\"a\": 1}]}": ["1", "true", '{"a":1}'],
    "{'facts': ['single']}\n- bullet wins": ["bullet wins"],
    "{\"facts\": [\"cut off\n- still listed": ["still listed"],
    "first\r\n- crlf line\x0b- vt line": ["crlf line", "vt line"],
    "": [],
    None: [],
}


def test_facts_from_replies(spark):
    rows = spark.createDataFrame([(r,) for r in REPLIES], "reply string")
    got = {r.reply: r.facts for r in R.add_facts(rows).collect()}
    for reply, want in REPLIES.items():
        assert got[reply] == want, reply


def test_fact_cap_and_outcome(spark):
    many = "\n".join(f"- fact number {n}" for n in range(30))
    rows = spark.createDataFrame([(many,), ("prose",), ("<think>x",), (None,)], "reply string")
    got = [(len(r.facts), r._outcome) for r in R.add_facts(rows).collect()]
    assert got == [(24, "ok"), (0, "empty"), (0, "ok"), (0, "failed")]


def test_prompts(spark):
    df = spark.createDataFrame(
        [("Q?", [str(n) for n in range(12)]), ("Q?", None), ("Q?", [])], "query string, options array<string>")
    prompts = [r[0] for r in df.select(R.recall_prompt(F.col("query"), F.col("options"))).collect()]
    assert prompts[0] == "Question: Q?\nAnswer options: " + " | ".join(str(n) for n in range(10))
    assert prompts[1] == prompts[2] == "Question: Q?"
    shown = df.select(R.reflection_prompt(F.col("query"), F.col("options"), F.array(F.lit("a" * 300), F.lit("b"))))
    assert shown.collect()[1][0] == "Original question: Q?\n\nRetrieved evidence:\n- " + "a" * 200 + "\n- b"


def test_recall_and_follow_up(spark):
    got = values(spark, R.recall_question(F.col("x")), ['"Did I?" \nmore', "", '""', None, "plain"], "x string")
    assert got == ["Did I?", None, None, None, "plain"]
    replies = ['{"status": "INCOMPLETE", "question": "When?"}', '{"status": "COMPLETE"}',
               '{"status": "INCOMPLETE", "question": ""}', "broken {", None]
    assert values(spark, R.follow_up_question(F.col("x")), replies, "x string") == ["When?", None, None, None, None]


def test_embedding(spark):
    df = spark.createDataFrame([("tea and tea",), ("",), (None,)], "text string")
    vecs = [r[0] for r in df.select(embed(F.col("text"), hashed_embedder(16))).collect()]
    assert sum(x * x for x in vecs[0]) == pytest.approx(1.0, abs=1e-6) and not any(vecs[1]) and not any(vecs[2])
    asked = [r[0] for r in df.select(embed(F.col("text"), hashed_embedder(16), is_query=True)).collect()]
    assert asked[0] != vecs[0] and any(asked[1])


def test_blend_equals_two_channels(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0]), ([1.0, 2.0], None)], "q array<float>, r array<float>")
    got = [r[0] for r in df.select(blend(F.col("q"), F.col("r"), 0.25)).collect()]
    assert got == [[1.5, 2.75], [1.0, 2.0]]


def test_times_are_utc_in_any_session_zone(spark):
    from turnstore.sources.corpus import session_millis

    # One of the moments falls in the hour that this zone leaves out.
    rows = [(1_700_000_000_000,), (1_700_000_000_123,), (1_678_588_200_000,), (-5,), (None,)]
    want = [("2023-11-14T22:13:20Z", "[2023-11-14 22:13] "), ("2023-11-14T22:13:20.123000Z", "[2023-11-14 22:13] "),
            ("2023-03-12T02:30:00Z", "[2023-03-12 02:30] ")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/Los_Angeles", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.createDataFrame(rows, "t long").select(X.created_at(F.col("t")).alias("c"), X.stamp_prefix(F.col("t")).alias("p"))
            assert [tuple(r) for r in df.collect()][:3] == want
            at = spark.createDataFrame([("2:30 am on 12 March, 2023",)], "s string").select(session_millis(F.col("s")).alias("m"))
            assert at.first().m == 1_678_588_200_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
