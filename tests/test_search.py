import json

import pytest
from pyspark.sql import functions as F

from turnstore import SearchSettings
from turnstore.functions.vectors import hashed_embedder
from turnstore.operators import rounds
from turnstore.plans.add import AddJob
from turnstore.plans.search import SearchJob
from turnstore.schemas import ADD_REQUEST, SEARCH_REQUEST
from turnstore.sources import tables

EMBEDDER = hashed_embedder(4096)
TALK = ["I adopted a beagle named Ollie", "what does he eat", "mostly kibble and carrots",
        "the train to Lisbon was late", "I bought a red bicycle", "the bicycle has eight gears"]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("search") / "store")
    rows = [(f"r{n}", user, "s", [("user", t, 1_684_576_800_000 + i * 60_000) for i, t in enumerate(TALK[n:n + 3])], n)
            for user in ("ann", "bob") for n in (0, 3)]
    AddJob(root, EMBEDDER).run(spark.createDataFrame(rows, ADD_REQUEST), 0)
    return tables.read_memories(spark, root)


def ask(spark, *rows):
    return spark.createDataFrame([(*r, None)[:5] for r in rows], SEARCH_REQUEST)


def test_a_needle_is_found_with_its_neighbours(spark, store):
    found = SearchJob(EMBEDDER).run(store, ask(spark, ("q", "who bought a red bicycle", "ann", 3))).orderBy("pos").collect()
    assert "red bicycle" in found[0].content and found[0].created_at == "2023-05-20T10:01:00Z"
    assert len(found) == 3 and len({r.id for r in found}) == 3
    assert any("Lisbon" in r.content for r in found) and any("gears" in r.content for r in found)
    assert found[1].score == found[0].score


def test_edges_and_isolation(spark, store):
    found = SearchJob(EMBEDDER).run(store, ask(
        spark, ("none", "bicycle", "nobody", 5), ("zero", "bicycle", "ann", 0), ("minus", "bicycle", "ann", -3),
        ("null", None, "ann", 5), ("all", "bicycle", "bob", 1000)))
    rows = found.collect()
    assert {r.query_id for r in rows} == {"all"} and len(rows) == 6
    owners = store.join(found.select("id"), "id").select("user_id").distinct().collect()
    assert [r.user_id for r in owners] == ["bob"]


def test_nothing_asked(spark, store):
    assert SearchJob(EMBEDDER).run(store, ask(spark, ("zero", "bicycle", "ann", 0))).count() == 0


def recaller():
    return lambda prompt: '"Did I tell you about my beagle Ollie?"' if "pet" in prompt else None


def test_recall_question_moves_the_ranking(spark, store):
    asked = ask(spark, ("q", "pet", "ann", 1))
    plain = SearchJob(EMBEDDER, SearchSettings(radius=0)).run(store, asked).first()
    fused = SearchJob(EMBEDDER, SearchSettings(radius=0), recaller=recaller).run(store, asked).first()
    assert "beagle" in fused.content and fused.score > plain.score


def reflector():
    def call(prompt):
        if "bicycle" in prompt.split("\n")[0]:
            return json.dumps({"status": "COMPLETE"})
        return json.dumps({"status": "INCOMPLETE", "question": "beagle named Ollie"})
    return call


def test_second_round_reopens_incomplete_questions_only(spark, store):
    asked = ask(spark, ("open", "train late", "ann", 2), ("shut", "red bicycle", "ann", 2))
    once = SearchJob(EMBEDDER, SearchSettings(radius=0))
    twice = SearchJob(EMBEDDER, SearchSettings(radius=0, second_round=True), reflector=reflector)
    one = {(r.query_id, r.pos): r.content for r in once.run(store, asked).collect()}
    two = {(r.query_id, r.pos): r.content for r in twice.run(store, asked).collect()}
    assert [one["shut", n] for n in (0, 1)] == [two["shut", n] for n in (0, 1)]
    assert any("Ollie" in t for (q, _), t in two.items() if q == "open")
    assert len([1 for q, _ in two if q == "open"]) == 2


def merged(spark, first, second, top_k=10, budget=1000):
    schema = "query_id string, pos int, id string, kind string, content string, score double, created_at string"
    frames = [spark.createDataFrame([("q", n, i, "raw", c, s, None) for n, (i, c, s) in enumerate(rows)], schema)
              for rows in (first, second)]
    queries = spark.createDataFrame([("q", top_k)], "query_id string, top_k int")
    rows = rounds.merge_rounds(*frames, queries, budget).orderBy("pos").collect()
    return [r.id for r in rows]


def test_merge_keeps_best_score_and_first_place(spark):
    first = [("a", "text a", 0.9), ("b", "text b", 0.5), ("c", "text c", 0.5)]
    second = [("d", "text d", 0.5), ("b2", "TEXT  b", 0.7), ("a2", "text a", 0.9)]
    assert merged(spark, first, second) == ["a", "b2", "c", "d"]
    assert merged(spark, first, second, top_k=2) == ["a", "b2"]
    # The item that uses the budget up is still kept.
    assert merged(spark, first, second, budget=7) == ["a", "b2"]
    assert merged(spark, first, second, budget=6) == ["a"]


def test_responses_leave_out_a_missing_stamp(spark):
    df = spark.createDataFrame([("q", 0, "i", "c", 0.5, None)],
                               "query_id string, pos int, id string, content string, score double, created_at string")
    assert json.loads(tables.responses(df).first()["item"]) == {"id": "i", "content": "c", "score": 0.5}


def test_prompts_are_asked_once_per_distinct_question(spark):
    asked = ask(spark, ("a", "q", "u", 1), ("b", "q", "v", 1), ("c", "other", "u", 1))
    assert rounds.recall_prompts(asked).count() == 2
    got = rounds.with_recall(asked, recaller).select("query_id", "recall").collect()
    assert {r.query_id for r in got} == {"a", "b", "c"} and all(r.recall is None for r in got)
    assert rounds.with_recall(asked, None).where(F.col("recall").isNotNull()).count() == 0
