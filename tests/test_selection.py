import random
from hashlib import sha1

import pytest
from pyspark.sql import functions as F

from selection_rule import check_selection
from turnstore.operators import ordering
from turnstore.operators.scoring import top_hits
from turnstore.operators.selection import neighbour_window, select_memories


def make_store(rng, user, chunks, words, longest=12):
    """Chunks with position gaps, copies and facts."""
    items, seq = [], 0
    for c in range(chunks):
        digest = sha1(f"{user}-{c}".encode()).hexdigest()[:16]
        for kind, n in (("r", rng.randint(1, 6)), ("f", rng.randint(0, 2))):
            for position in range(n):
                if rng.random() < 0.2:
                    continue
                text = rng.choice(words) + " " * rng.randint(0, 3) + "x" * rng.randint(0, longest)
                items.append({"id": f"{digest}-{kind}{position}", "user_id": user, "seq": seq,
                              "kind": "raw" if kind == "r" else "fact", "content": text, "created_at": None,
                              "vec": [float(rng.randint(0, 3)), float(rng.randint(0, 3))]})
                seq += 1
    return items


MEMORY = ("id string, user_id string, seq bigint, kind string, content string, created_at string, "
          "vec array<float>")


def run_case(spark, seed, budget, radius, return_limit, hit_factor, page_hits, words, strategy="scan"):
    rng = random.Random(seed)
    stores = {f"u{n}": make_store(rng, f"u{n}", rng.randint(0, 12), words) for n in range(4)}
    questions = [{"query_id": f"q{n}", "user_id": f"u{n % 5}", "top_k": rng.choice([0, 1, 3, 7, 200]),
                  "qvec": [rng.random(), rng.random()]} for n in range(20)]
    memories = spark.createDataFrame([i for s in stores.values() for i in s], MEMORY).repartition(3)
    queries = spark.createDataFrame(questions, "query_id string, user_id string, top_k int, qvec array<double>")

    got = select_memories(memories, queries, radius, budget, return_limit, hit_factor, page_hits,
                          strategy=strategy, slice_rows=5, query_block=2)
    found = {}
    for row in got.orderBy("query_id", "take").collect():
        found.setdefault(row.query_id, []).append((row.id, round(row.score, 6)))
    for q in questions:
        items = stores.get(q["user_id"], [])
        scores = {i["id"]: round(sum(a * b for a, b in zip(i["vec"], q["qvec"])), 9) for i in items}
        check_selection(found.get(q["query_id"], []), items, scores, min(q["top_k"], return_limit), budget, radius)


FEW_WORDS = ["ok", "OK", "yes", "no\t", "thanks"]
MANY_WORDS = [f"word{n}" for n in range(60)]


@pytest.mark.parametrize("seed,budget,radius,limit,factor,page,words,strategy", [
    (1, 10**6, 1, 10, 2, 100, MANY_WORDS, "scan"),
    (2, 10**6, 0, 5, 1, 100, FEW_WORDS, "scan"),      # copies: more hits are ranked
    (3, 40, 2, 10, 2, 100, MANY_WORDS, "scan"),      # the budget binds
    (4, 15, 1, 6, 1, 4, FEW_WORDS, "grid"),           # both, on tiny pages and cells
    (5, 0, 1, 6, 1, 4, MANY_WORDS, "scan"),           # no budget: one item
    (6, 60, 3, 100, 1, 7, MANY_WORDS, "grid"),
])
def test_selection_keeps_its_rule(spark, seed, budget, radius, limit, factor, page, words, strategy):
    run_case(spark, seed, budget, radius, limit, factor, page, words, strategy)


def chunk_store(spark):
    rows = [(f"{d * 16}-r{p}", "u", "raw", f"chunk {d} turn {p}", n * 5 + p)
            for n, d in enumerate("ab") for p in range(5)]
    rows.append(("a" * 16 + "-f0", "u", "fact", "an extracted fact", 10))
    return spark.createDataFrame(rows, "id string, user_id string, kind string, content string, seq bigint") \
        .withColumn("created_at", F.lit(None).cast("string"))


def test_neighbours_stay_inside_the_chunk(spark):
    store = chunk_store(spark)
    hits = store.where("id in ('aaaaaaaaaaaaaaaa-r0', 'aaaaaaaaaaaaaaaa-f0')").select(
        F.lit("q").alias("query_id"), "id", "seq", F.lit(1.0).alias("score"))
    got = {r.id for r in neighbour_window(hits, store, 2).collect()}
    assert got == {"a" * 16 + t for t in ("-r0", "-r1", "-r2", "-f0")}


def test_neighbours_do_not_bridge_a_gap(spark):
    store = chunk_store(spark).where("id != 'aaaaaaaaaaaaaaaa-r2'")
    hits = store.where("id = 'aaaaaaaaaaaaaaaa-r1'").select(
        F.lit("q").alias("query_id"), "id", "seq", F.lit(1.0).alias("score"))
    got = [(r.slot, r.id[-2:]) for r in neighbour_window(hits, store, 1).orderBy("slot").collect()]
    assert got == [(0, "r1"), (1, "r0")]


def test_orderings_keep_membership(spark):
    taken = spark.createDataFrame(
        [("q", n + 1, name, kind) for n, (name, kind) in enumerate(
            [("f1", "fact"), ("r1", "raw"), ("f2", "fact"), ("r2", "raw"), ("r3", "raw")])],
        "query_id string, take int, id string, kind string")

    def names(name):
        return [r.id for r in ordering.ordered(taken, name).orderBy("pos").collect()]

    assert names("raw_first") == ["r1", "r2", "r3", "f1", "f2"]
    assert names("fact_first") == ["f1", "f2", "r1", "r2", "r3"]
    assert names("relevance") == ["f1", "r1", "f2", "r2", "r3"]
    assert names("sandwich") == ["r1", "r2", "f1", "f2", "r3"]
    with pytest.raises(ValueError):
        ordering.ordered(taken, "unheard of")


def test_scan_and_grid_agree(spark):
    rng = random.Random(9)
    memories = spark.createDataFrame(make_store(rng, "u0", 40, MANY_WORDS), MEMORY)
    queries = spark.createDataFrame(
        [(f"q{n}", "u0", [rng.random(), rng.random()]) for n in range(9)],
        "query_id string, user_id string, qvec array<double>")
    one, two = (sorted(tuple(r) for r in top_hits(
        memories, queries, 7, strategy=s, slice_rows=10, query_block=2).collect()) for s in ("scan", "grid"))
    assert one == two and len(one) == 63
    with pytest.raises(ValueError):
        top_hits(memories, queries, 7, strategy="scan", scan_bytes=10)


def test_keys_beyond_the_broadcast_go_through_a_filter(spark):
    from turnstore.runtime import BLOCK_KEYS, join_few
    large = spark.range(20_000).selectExpr("concat('m', id) AS id", "repeat('text ', 20) AS content")
    few = spark.range(900).selectExpr("concat('m', id * 7) AS id", "id AS n").unionByName(spark.range(5).selectExpr("concat('x', id) AS id", "id AS n"))
    expected = {(f"m{7 * n}", n) for n in range(900)}
    for limits in ({}, {"rows": 10}, {"rows": 10, "blocks": 1}):
        assert {(r.id, r.n) for r in join_few(large, few, ["id"], **limits).collect()} == expected
    # Hardly anything but the keys is shuffled.
    n_blocks = -(-905 // BLOCK_KEYS)
    from turnstore import runtime
    place, bits = runtime.key_hashes(["id"])
    sent = runtime.filter_blocks(few, ["id"], n_blocks)
    passed = large.withColumn("block", F.pmod(place, F.lit(n_blocks))).join(sent, "block").where(runtime.may_hold(F.col("words"), bits))
    assert 900 <= passed.count() < 900 + 0.03 * 20_000


def test_packed_users_and_two_levels_rank_alike(spark):
    from turnstore.operators.scoring import top_hits
    rows = [(f"u{n % 40 if n % 3 else 0}", f"i{n}", n, [float(n % 7), float(n % 11)]) for n in range(900)]
    memories = spark.createDataFrame(rows, "user_id string, id string, seq bigint, vec array<float>")
    asked = spark.createDataFrame([(f"q{n}", f"u{n % 45}", [1.0, float(n % 5)]) for n in range(120)], "query_id string, user_id string, qvec array<float>")
    expected = sorted(map(tuple, top_hits(memories, asked, 7, strategy="scan").collect()))
    for plan in ({"salts": 4}, {"strategy": "grid"}, {"strategy": "grid", "slice_rows": 25, "query_block": 2, "salts": 3}):
        assert sorted(map(tuple, top_hits(memories, asked, 7, **plan).collect())) == expected
