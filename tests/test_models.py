"""Model stages: batches, retries, calls in flight, kept replies; judging; stored runs; the sign test."""

import math
import os
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from turnstore.functions.vectors import embed
from turnstore.operators.models import ModelStage, ReplyTable, call_model, stored_replies
from turnstore.operators import replicates
from turnstore.plans.evaluate import filled, judge
from turnstore.sources.results import Results


def logged(path, fail=lambda prompt, n: False, batch=False):
    """A caller that writes down every call; *fail* sees the prompt and how often it came."""

    def build():
        def one(prompts):
            with open(path, "a") as log:
                log.write("\x1e".join(prompts) + "\n")
            seen = [line.split("\x1e") for line in open(path).read().split("\n")[:-1]]
            if any(fail(p, sum(p in s for s in seen)) for p in prompts):
                raise RuntimeError("provider down")
            return [p.upper() for p in prompts]
        return one if batch else lambda prompt: one([prompt])[0]
    return build


def calls(path):
    return [line.split("\x1e") for line in open(path).read().split("\n")[:-1]] if os.path.exists(path) else []


def prompts(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, prompt string").coalesce(1)


def test_batches_and_a_bad_prompt_among_them(spark, tmp_path):
    path = str(tmp_path / "log")
    stage = ModelStage(logged(path, lambda p, n: p == "bad", batch=True), batch=3)
    rows = call_model(prompts(spark, *"abcde", "bad", "f"), stage).collect()
    assert [(r.prompt, r.reply, r.status) for r in rows] == [
        *[(p, p.upper(), "ok") for p in "abcde"], ("bad", None, "failed"), ("f", "F", "ok")]
    assert [len(c) for c in calls(path)] == [3, 3, 1, 1, 1, 1]


def test_failed_calls_are_tried_again(spark, tmp_path):
    path = str(tmp_path / "log")
    stage = ModelStage(logged(path, lambda p, n: n < 3), retries=2, in_flight=1)
    rows = call_model(prompts(spark, "a", "b"), stage).collect()
    assert [r.reply for r in rows] == ["A", "B"] and len(calls(path)) == 6
    few = call_model(prompts(spark, "c"), ModelStage(logged(path, lambda p, n: n < 3), retries=1)).first()
    assert (few.reply, few.status) == (None, "failed")


def sleepy():
    import threading
    import time
    open_now, most = [0], [0]
    lock = threading.Lock()

    def call(prompt):
        with lock:
            open_now[0] += 1
            most[0] = max(most[0], open_now[0])
        time.sleep(0.05)
        with lock:
            open_now[0] -= 1
        return f"{prompt} {most[0]}"
    return call


def test_calls_in_flight_keep_their_order(spark):
    rows = call_model(prompts(spark, *[str(n) for n in range(24)]), ModelStage(sleepy, in_flight=8)).collect()
    assert [r.reply.split()[0] for r in rows] == [str(n) for n in range(24)]
    assert 2 <= max(int(r.reply.split()[1]) for r in rows) <= 8


def test_kept_replies_are_not_asked_for_again(spark, tmp_path):
    path, table = str(tmp_path / "log"), ReplyTable(str(tmp_path / "replies"), "m1")
    stage = ModelStage(logged(path, lambda p, n: p == "bad" and n < 2), replies=table)
    first = call_model(prompts(spark, "a", "b", "a", "bad", None), stage).orderBy("n").collect()
    assert [r.reply for r in first] == ["A", "B", "A", None, None] and len(calls(path)) == 3
    again = call_model(prompts(spark, "b", "bad", "c"), stage).orderBy("n").collect()
    assert [(r.reply, r.status) for r in again] == [("B", "ok"), ("BAD", "ok"), ("C", "ok")]
    # Only what failed before and what is new was sent.
    assert sorted(c[0] for c in calls(path)[3:]) == ["bad", "c"]
    assert {r.reply for r in stored_replies(spark, table).collect()} == {"A", "B", "BAD", "C"}
    other = ModelStage(logged(path), replies=ReplyTable(table.root, "m2"))
    assert call_model(prompts(spark, "a"), other).first().reply == "A" and calls(path)[-1] == ["a"]


def counting():
    import numpy as np

    def encode(texts):
        assert 0 < len(texts) <= 3
        return np.array([[len(t), len(texts)] for t in texts], float)
    return encode


def test_embedding_batches_and_nulls(spark):
    df = spark.createDataFrame([(t,) for t in ["a", None, "bb", "", "cccc", None, "d"]], "t string").coalesce(1)
    vecs = [r.v for r in df.select(embed(F.col("t"), counting, batch_size=3, skip_nulls=True).alias("v")).collect()]
    assert [v is None for v in vecs] == [False, True, False, False, False, True, False]
    assert vecs[0][0] == pytest.approx(1 / math.sqrt(10)) and vecs[6][1] == pytest.approx(2 / math.sqrt(5))
    assert df.where("t is null").select(embed(F.col("t"), counting, skip_nulls=True).alias("v")).where("v is not null").count() == 0


def judger():
    def call(prompt):
        if "fail" in prompt:
            raise RuntimeError("provider down")
        return "hard to say" if "vague" in prompt else "It is WRONG, not CORRECT"
    return call


def test_judging(spark):
    answers = spark.createDataFrame([("a", "x", None), ("b", "vague", "y"), ("c", "fail", "z")],
                                    "question string, gold_answer string, generated_answer string")
    rows = {r.question: (r.label, r.judge_raw) for r in judge(answers, judger, raw_chars=None).collect()}
    assert rows == {"a": ("WRONG", "It is WRONG, not CORRECT"), "b": (None, "hard to say"), "c": (None, "JUDGE_ERROR")}
    assert answers.select(filled("{question}: {generated_answer}!").alias("p")).first().p == "a: !"


def test_runs_are_replaced_one_by_one_and_read_across_tags(spark, tmp_path):
    results = Results(str(tmp_path / "r"))
    assert results.prefixes(spark, "t").count() == 0
    rows = spark.createDataFrame([("q1", "CORRECT"), ("q2", None)], "question_id string, label string")
    for prefix in (100, 5, 20):
        results.write("judged", rows, "t", prefix)
    results.write("judged", rows.limit(1), "u", 5)
    results.write("judged", rows.where("label is null"), "t", 5)
    assert [r.prefix for r in results.prefixes(spark, "t").collect()] == [5, 20, 100]
    assert results.read(spark, "judged", "t", 5).count() == 1 and results.read(spark, "judged", "u").count() == 1
    chunk = spark.createDataFrame([("d" * 16, 0, "D1:1", 1)], "digest string, position int, dia_id string, conv int")
    results.write("chunks", chunk, "store")
    results.write("chunks", chunk.withColumn("dia_id", F.lit("own")), "run")
    runs = spark.createDataFrame([("run", "store"), ("store", None)], "tag string, store_tag string")
    crossed = results.of_stores(spark, "chunks", runs)
    assert {(r.tag, r.dia_id) for r in crossed.collect()} == {("run", "D1:1"), ("store", "D1:1")}
    filters = crossed._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "tag" in filters and "store" in filters


def test_sign_test_is_exact_at_any_size(spark):
    rows = [(0, 0), (5, 5), (0, 9), (3, 17), (64, 70), (65, 65), (65, 66), (66, 90), (500, 700), (3000, 2900), (0, 900)]
    huge = [(1_500_000_000, 1_500_040_000), (1_500_000_000, 1_500_000_000), (100, 10**9)]
    got = {(r.fixes, r.breaks): r.p_value for r in replicates.sign_test(
        spark.createDataFrame(rows + huge, "fixes bigint, breaks bigint")).collect()}
    for a, b in rows:
        n, small = a + b, min(a, b)
        exact = min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(small + 1)), 2 ** n)))
        assert got[a, b] == pytest.approx(exact, rel=1e-11), (a, b)
    # At three billion flips the normal tail with continuity correction is as good as exact.
    n = sum(huge[0])
    z = (huge[0][0] + 0.5 - n / 2) / math.sqrt(n / 4)
    assert got[huge[0]] == pytest.approx(math.erfc(-z / math.sqrt(2)), rel=1e-7)
    assert got[huge[1]] == 1.0 and got[huge[2]] == 0.0
