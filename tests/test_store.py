"""The store: merging, lookup of requests and counters, replacing, and what a crash leaves."""

import os

import pytest
from pyspark.sql import functions as F, types as T

from turnstore.functions.vectors import hashed_embedder
from turnstore.operators import health
from turnstore.plans.add import AddJob
from turnstore.schemas import ADD_REQUEST, LEDGER, MEMORY
from turnstore.sources import tables
from turnstore.sources.store import Store, request_filters, user_bucket


def memory(user, request, n, content="text"):
    values = {"id": f"{user}-{request}-{n}", "user_id": user, "request_id": request, "kind": "raw", "content": content,
              "seq": n, "dedupe_key": content, "n_chars": len(content), "vec": [1.0, 0.0]}
    return tuple(values.get(f.name) for f in MEMORY)


def batch_of(spark, requests):
    """(memories, ledger) of (user, request, items)."""
    rows = [memory(u, r, i) for u, r, n in requests for i in range(n)]
    return (spark.createDataFrame(rows, MEMORY), spark.createDataFrame([(r, u, n) for u, r, n in requests], LEDGER))


def size_of(store, table, attempts):
    """Bytes of a table's live attempts."""
    total = 0
    for a in attempts:
        for folder, _, names in os.walk(f"{store.root}/{table}/attempt={a.attempt}"):
            total += sum(os.path.getsize(f"{folder}/{n}") for n in names if n.endswith(".parquet"))
    return total


def contents(store, spark):
    return {r.id: r.content for r in store.memories(spark).collect()}


def test_many_batches_leave_few_attempts(spark, tmp_path):
    store = Store(str(tmp_path / "s"), buckets=4, fan_in=3, flat_items=3)
    sizes = []
    for batch in range(10):
        store.append(batch, *batch_of(spark, [("u1", f"r{batch}", 2), (f"v{batch % 3}", f"r{batch}", 3)]))
        live = store.attempts(spark)
        # At most fan_in - 1 of each tier.
        assert len(live) <= 2 * (1 + max(a.tier for a in live))
        sizes.append(size_of(store, "counters", live) / len(live))
    assert [a.tier for a in live] == sorted((a.tier for a in live), reverse=True) and max(a.tier for a in live) == 2
    # Counters have a row per user and attempt, however many batches there were.
    assert sizes[-1] < 2 * sizes[2]
    assert store.read(spark, "counters", live[:1]).count() == 4
    counts = {r.user_id: r.start for r in store.stored_counts(spark.createDataFrame([("u1",), ("v2",), ("x",)], "user_id string"), live).collect()}
    assert counts == {"u1": 20, "v2": 9}
    assert store.memories(spark).count() == 50 and store.ledger(spark).count() == 20
    assert {r.batch for r in store.ledger(spark).collect()} == set(range(10))
    stats = store.stats(spark).first()
    assert (round(stats.users), stats["items"]) == (4, 50)
    approximate = health.stored_stats(spark, store).first()
    assert (approximate.users, approximate["items"]) == (4, 50)


def test_requests_are_found_through_filters(spark, tmp_path):
    store = Store(str(tmp_path / "s"), buckets=4, fan_in=0)
    for batch in range(2):
        store.append(batch, *batch_of(spark, [(f"u{n}", f"r{batch}-{n}", 1) for n in range(40)]))
    live = store.attempts(spark)
    keys = spark.createDataFrame([("r0-1", "u1"), ("r1-7", "u7"), ("r0-7", "u8"), ("new", "u1"), ("r0-1", "u2")], "request_id string, user_id string")
    assert {tuple(r) for r in store.stored_requests(keys, live).collect()} == {("r0-1", "u1"), ("r1-7", "u7")}
    assert store.stored_requests(keys, []).count() == 0
    # Only buckets of the batch are looked at, and the ledger only where a filter points.
    assert len(store.buckets_of(keys.where("user_id = 'u1'"))) == 1
    before = size_of(store, "ledger", live)
    fresh = spark.createDataFrame([(f"n{n}", "u1") for n in range(30)], "request_id string, user_id string")
    for a in live:
        os.rename(f"{store.root}/ledger/attempt={a.attempt}", f"{store.root}/away-{a.attempt}")
    # The ledger is not even there, and new requests do not need it.
    assert before and store.stored_requests(fresh, live).count() == 0


def test_bucket_filter_reaches_the_folders(spark, tmp_path):
    store = Store(str(tmp_path / "s"), buckets=4, flat_items=0)
    store.append(0, *batch_of(spark, [(f"u{n}", "r", 2) for n in range(9)]))
    memories = store.memories(spark)
    users = spark.createDataFrame([("u3",)], "user_id string")
    found = tables.user_memories(memories, users, 4)
    assert [r.seq for r in found.collect()] == [0, 1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "user_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    asked = tables.of_askers(memories, users, 4)
    assert {r.b for r in asked.select(user_bucket(F.col("user_id"), 4).alias("b")).collect()} == set(store.buckets_of(users))


def test_filters_hold_every_key_and_few_others(spark):
    rows = [(f"r{n}", f"u{n % 7}", 1) for n in range(3000)]
    ledger = spark.createDataFrame(rows, LEDGER).withColumn("user_bucket", user_bucket(F.col("user_id"), 2))
    blocks = request_filters(ledger).collect()
    assert {b.n_blocks for b in blocks} == {16} and all(len(b.words) == 64 for b in blocks)
    held = sum(bin(w & (2**64 - 1)).count("1") for b in blocks for w in b.words)
    assert 0.9 * 5 * 3000 < held <= 5 * 3000


def test_replaced_ids_have_their_last_row(spark, tmp_path):
    store = Store(str(tmp_path / "s"), buckets=3, fan_in=0)
    store.append(0, *batch_of(spark, [("u", "r", 3)]))
    versions = spark.createDataFrame(
        [(*memory("u", "r", 1, "one"), 1), (*memory("u", "r", 1, "two"), 2), (*memory("u", "new", 0, "added"), 1)],
        T.StructType([*MEMORY.fields, T.StructField("v", T.IntegerType())]))
    store.replace(versions, "v")
    expected = {"u-r-0": "text", "u-r-1": "two", "u-r-2": "text", "u-new-0": "added"}
    assert contents(store, spark) == expected
    store.append(1, *batch_of(spark, [("w", "r", 1)]))
    expected["w-r-0"] = "text"
    assert contents(store, spark) == expected
    reader = store.memories(spark)
    store.merge(spark)
    assert len(store.attempts(spark)) == 1 and contents(store, spark) == expected
    # A reader that began before the merge still finds its files.
    assert {r.id: r.content for r in reader.collect()} == expected
    store.replace(versions.where("v = 1").withColumn("content", F.lit("three")), "v")
    assert contents(store, spark) == expected | {"u-r-1": "three", "u-new-0": "three"}
    again = spark.createDataFrame([("u",)], "user_id string")
    assert store.stored_counts(again, store.attempts(spark)).first().start == 3


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(str(tmp_path / "s"), buckets=3, fan_in=0)
    for batch in range(3):
        store.append(batch, *batch_of(spark, [("u", f"r{batch}", 1)]))
    before, live = contents(store, spark), store.attempts(spark)

    def die(*_):
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as m:
        m.setattr(Store, "_swap", die)
        with pytest.raises(RuntimeError):
            store.merge(spark)
    assert contents(store, spark) == before and store.attempts(spark) == live
    with monkeypatch.context() as m:
        # Dying between the new epoch and its hint: the epoch counts.
        real = store._append_log
        m.setattr(Store, "_append_log", lambda self, spark, epoch, rows: (real(spark, epoch, rows), die()))
        with pytest.raises(RuntimeError):
            store.merge(spark)
    assert contents(store, spark) == before and len(store.attempts(spark)) == 1
    store.append(3, *batch_of(spark, [("u", "r3", 1)]))
    assert len(contents(store, spark)) == 4


def test_jobs_go_on_over_merges(spark, tmp_path):
    job = AddJob(str(tmp_path / "s"), hashed_embedder(8), buckets=4, fan_in=2)
    for batch in range(4):
        asked = [(f"r{n}", "u", "s", [("user", f"{n} {m}", None) for m in range(2)], n) for n in range(batch + 1)]
        report = job.run(spark.createDataFrame(asked, ADD_REQUEST), batch)
        assert sorted(r.status for r in report.collect()) == ["duplicate"] * batch + ["stored"]
    rows = job.store.memories(spark).collect()
    assert sorted(r.seq for r in rows) == list(range(8)) and len({r.id for r in rows}) == 8


def test_repeated_rejects_are_kept_once(spark, tmp_path):
    job = AddJob(str(tmp_path / "s"), hashed_embedder(8))
    bad = spark.createDataFrame([("r", None, "s", [("user", "x", None)], 0), ("q", "u", "s", [], 0)], ADD_REQUEST)
    for _ in range(2):
        assert {r.status for r in job.run(bad, 0).collect()} == {"rejected"}
    assert sorted(r.problem for r in tables.read_quarantine(spark, job.root).collect()) == ["messages", "user_id"]
