import json
import shutil

import pytest
from pyspark.sql import functions as F

from turnstore.functions.vectors import hashed_embedder
from turnstore.operators import health, ingest
from turnstore.operators.models import call_model
from turnstore.plans.add import AddJob
from turnstore.runtime import is_local, running_total
from turnstore.schemas import ADD_REQUEST
from turnstore.sources import requests as requests_source, tables
from turnstore.streaming.ingest import request_stream, start_ingest

EMBEDDER = hashed_embedder(8)


def request(rid, user, *messages, arrival=0, session="s"):
    return (rid, user, session, [(m if len(m) == 3 else (*m, None)) for m in messages], arrival)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ADD_REQUEST)


def facts_caller():
    def call(prompt):
        if "fail" in prompt:
            raise RuntimeError("provider down")
        return json.dumps({"facts": [f"fact about {len(prompt)}", "[2020-01-01] dated"]})
    return call


STAMP = 1_684_576_800_000


def test_blank_messages_keep_positions(spark):
    made = ingest.prepared(frame(spark, request(
        "r", "u", ("user", " hi 　", STAMP), ("user", " \t"), ("ASSISTANT", "yo", STAMP + 60_000))))
    rows = {r.position: r for r in ingest.raw_memories(made).collect()}
    assert sorted(rows) == [0, 2]
    assert rows[0].content == "[2023-05-20 10:00] I: hi" and rows[2].content == "[2023-05-20 10:01] Assistant: yo"
    assert made.first().transcript == "[2023-05-20 10:00] user: hi\n[2023-05-20 10:01] ASSISTANT: yo"


def test_fact_prefix_and_stamp_come_from_different_messages(spark):
    replied = ingest.prepared(frame(spark, request("r", "u", ("user", " ", STAMP), ("user", "later")))).withColumn(
        "reply", F.lit("- likes tea\n[2020] dated fact")).withColumn("status", F.lit("ok"))
    rows = ingest.fact_memories(ingest.with_facts(replied)).orderBy("position").collect()
    assert [r.content for r in rows] == ["[2023-05-20 10:00] likes tea", "[2020] dated fact"]
    assert rows[0].created_at is None and rows[0].id.endswith("-f0")


def test_requests_are_checked(spark):
    good = request("a", "u", ("user", "x"))
    df = frame(spark, good, request("b", "u"), ("c", None, "s", [("user", "x", None)], 0),
               ("d", "u", "s", [("user", None, None)], 0), (None, "u", "s", [("user", "x", None)], 0))
    assert [r.request_id for r in requests_source.accepted(df).collect()] == ["a"]
    problems = {r.request_id: r.problem for r in requests_source.quarantined(df).collect()}
    assert problems == {"b": "messages", "c": "user_id", "d": "messages", None: "request_id"}


def test_unreadable_json_is_quarantined(spark, tmp_path):
    lines = [json.dumps({"request_id": "a", "user_id": "u", "session_id": "s",
                         "messages": [{"role": "user", "content": "x"}]}), '{"request_id": "b", ']
    (tmp_path / "in.json").write_text("\n".join(lines))
    df = requests_source.read_add_requests(spark, str(tmp_path / "in.json")).cache()
    assert [r.request_id for r in requests_source.accepted(df).collect()] == ["a"]
    assert [r.problem for r in requests_source.quarantined(df).collect()] == ["malformed"]
    df.unpersist()


def test_add_is_exactly_once(spark, tmp_path):
    root = str(tmp_path / "store")
    job = AddJob(root, EMBEDDER, facts_caller)
    first = request("r1", "u1", ("user", "one"), ("user", "two"), arrival=1)
    blank = request("r2", "u1", ("user", "  "), arrival=2)
    report = job.run(frame(spark, first, first, blank, request("r3", "u1", ("user", "fail"), arrival=3)), 0)
    assert {(r.request_id, r.status) for r in report.collect()} == {("r1", "stored"), ("r2", "blank"), ("r3", "stored")}
    again = job.run(frame(spark, first, request("r1", "u2", ("user", "other")), blank), 1)
    assert {(r.request_id, r.user_id, r.status) for r in again.collect()} == {
        ("r1", "u1", "duplicate"), ("r1", "u2", "stored"), ("r2", "u1", "blank")}
    rows = tables.read_memories(spark, root).orderBy("user_id", "seq").collect()
    assert [(r.user_id, r.seq, r.kind) for r in rows] == [
        ("u1", 0, "raw"), ("u1", 1, "raw"), ("u1", 2, "fact"), ("u1", 3, "fact"), ("u1", 4, "raw"),
        ("u2", 0, "raw"), ("u2", 1, "fact"), ("u2", 2, "fact")]
    assert len({r.id for r in rows}) == 8 and all(len(r.vec) == 8 for r in rows)
    assert {r.request_id for r in tables.read_ledger(spark, root).collect()} == {"r1", "r3"}
    stats = health.store_stats(tables.read_memories(spark, root)).first()
    assert (stats.users, stats["items"]) == (2, 8)
    mine = tables.user_memories(tables.read_memories(spark, root), "u2")
    assert [r.seq for r in mine.collect()] == [0, 1, 2]


def test_a_batch_that_died_before_its_ledger_is_replaced(spark, tmp_path):
    root = str(tmp_path / "store")
    job = AddJob(root, EMBEDDER)
    rows = frame(spark, request("r1", "u1", ("user", "one")), request("r2", "u1", ("user", "two")))
    job.run(rows, 0)
    shutil.rmtree(f"{root}/commits")
    assert tables.read_memories(spark, root).count() == 0
    job.run(rows, 0)
    job.run(rows, 0)
    assert [r.seq for r in tables.read_memories(spark, root).orderBy("seq").collect()] == [0, 1]


def test_a_repeated_batch_number_takes_nothing_away(spark, tmp_path):
    root = str(tmp_path / "store")
    job = AddJob(root, EMBEDDER)
    x, y, z = (request(r, "u", ("user", r)) for r in ("rx", "ry", "rz"))
    job.run(frame(spark, x), 0)
    job.run(frame(spark, y), 0)
    assert {r.request_id for r in tables.read_memories(spark, root).collect()} == {"rx", "ry"}
    # A run with rz and rv dies before its commit; rz comes in another batch; the first is repeated.
    before = set((tmp_path / "store/commits").glob("*"))
    job.run(frame(spark, z, request("rv", "u", ("user", "rv"))), 1)
    for file in set((tmp_path / "store/commits").glob("*")) - before:
        file.unlink()
    job.run(frame(spark, z), 2)
    job.run(frame(spark, z, request("rv", "u", ("user", "rv"))), 1)
    rows = tables.read_memories(spark, root).collect()
    assert sorted(r.request_id for r in rows) == ["rv", "rx", "ry", "rz"] and sorted(r.seq for r in rows) == [0, 1, 2, 3]
    assert tables.read_ledger(spark, root).count() == 4


def test_rejects_of_a_stream_are_kept(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    good = {"request_id": "a", "user_id": "u", "session_id": "s", "messages": [{"role": "user", "content": "x"}]}
    lines = [json.dumps(good), '{"request_id": "b", ', json.dumps(good | {"request_id": "c", "messages": []})]
    (source / "0.json").write_text("\n".join(lines))
    start_ingest(request_stream(spark, str(source)), AddJob(root, EMBEDDER), str(tmp_path / "check"), available_now=True).awaitTermination()
    assert [r.request_id for r in tables.read_memories(spark, root).collect()] == ["a"]
    kept = {(r.request_id, r.problem, r._corrupt_record) for r in tables.read_quarantine(spark, root).collect()}
    assert ("c", "messages", None) in kept and len(kept) == 2 and any(p == "malformed" and t == lines[1] for _, p, t in kept)


def test_scratch_needs_a_shared_folder():
    assert is_local("local") and is_local("local[8]") and is_local("local[*]")
    assert not is_local("local-cluster[2,1,1024]") and not is_local("yarn") and not is_local("spark://h:7077")


def test_stream_replay_stores_once(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for n in range(3):
        frame(spark, *[request(f"r{n}-{i}", f"u{i % 2}", ("user", f"{n} {i}"), arrival=n) for i in range(4)]) \
            .coalesce(1).write.json(str(tmp_path / f"part{n}"))
        part = next((tmp_path / f"part{n}").glob("*.json"))
        shutil.copy(part, source / f"{n}.json")
    job = AddJob(root, EMBEDDER)
    for attempt in range(2):
        stream = request_stream(spark, str(source), files_per_batch=1)
        start_ingest(stream, job, str(tmp_path / f"check{attempt}"), available_now=True).awaitTermination()
    rows = tables.read_memories(spark, root).collect()
    assert len(rows) == 12 and {r.batch for r in rows} == {0, 1, 2}
    for user in ("u0", "u1"):
        assert sorted(r.seq for r in rows if r.user_id == user) == list(range(6))


def test_upsert_keeps_the_last_write(spark):
    stored = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, content string")
    incoming = spark.createDataFrame([("b", "v1", 1), ("b", "v2", 2), ("c", "v1", 1)], "id string, content string, v int")
    got = {r.id: r.content for r in tables.upsert(stored, incoming, "v").collect()}
    assert got == {"a": "old", "b": "v2", "c": "v1"}


def test_model_failures_become_rows(spark):
    prompts = spark.createDataFrame([(f"p{n}" if n % 3 else "fail",) for n in range(9)], "prompt string")
    rows = call_model(prompts, facts_caller).collect()
    assert sorted(r.status for r in rows) == ["failed"] * 3 + ["ok"] * 6
    assert all((r.reply is None) == (r.status == "failed") for r in rows)
    assert {r.status for r in call_model(prompts, None).collect()} == {"off"}


@pytest.mark.parametrize("calls,failures,status", [(4, 4, "ok"), (5, 3, "degraded"), (6, 3, "ok")])
def test_channel_health(spark, calls, failures, status):
    rows = [("failed" if n < failures else "ok",) for n in range(calls)] + [("off",)]
    got = health.channel_health(spark.createDataFrame(rows, "status string")).first()
    assert (got.calls, got.failures, got.status) == (calls, failures, status)


def test_running_total_splits_a_hot_key(spark):
    rows = [("hot" if n % 3 else f"k{n % 50}", n % 4000, f"{n:05d}", n % 7) for n in range(9000)]
    df = spark.createDataFrame(rows, "k string, a bigint, b string, v bigint")
    start = spark.createDataFrame([("hot", 5)], "k string, start bigint")
    got = {r.b: r.t for r in running_total(df, ["k"], ["a", "b"], "v", "t", start, pieces=8).collect()}
    sums = {"hot": 5}
    for k, _, b, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[b] == sums.get(k, 0), (k, b)
        sums[k] = sums.get(k, 0) + v
    assert len(got) == 9000
