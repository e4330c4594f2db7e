import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnstore.functions.vectors import hashed_embedder
from turnstore.operators import evaluation, lexical, policies, replicates
from turnstore.plans.add import AddJob
from turnstore.plans.evaluate import EvaluationJob, answer, report
from turnstore.plans.search import SearchJob
from turnstore.sources import corpus as corpus_source, tables

CORPUS = [{
    "conversation": {
        "speaker_a": "Ann", "speaker_b": "Bob", "session_1_date_time": "1:56 pm on 8 May, 2023",
        "session_1": [{"speaker": "Ann", "dia_id": "D1:1", "text": " hello there "}, {"speaker": "Bob", "dia_id": "D1:2", "text": ""},
                      {"speaker": "Bob", "dia_id": "D1:3", "text": "my beagle is Ollie"}],
        "session_10_date_time": "no date", "session_10": [{"speaker": "Ann", "dia_id": "D10:1", "text": "red bicycle"}],
        "session_2": "not a list", "session_3": [{"speaker": "Ann", "dia_id": "D3:1", "text": "  "}]},
    "qa": [{"question": "which dog", "answer": "Ollie", "category": 1, "evidence": ["D1:3", 7]},
           {"question": "adversarial", "answer": "x", "category": 5, "evidence": ["D1:1"]},
           {"question": "no answer", "category": 2, "evidence": []},
           {"question": "what colour", "answer": 3, "category": 2, "evidence": None}]}]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "corpus.json"
    path.write_text(json.dumps(CORPUS, indent=1))
    return corpus_source.read_corpus(spark, str(path))


def test_corpus_is_replayed(spark, corpus):
    turns = corpus_source.corpus_turns(corpus).orderBy("session", "pos").collect()
    assert [t.dia_id for t in turns] == ["D1:1", "D1:2", "D1:3", "D3:1", "D10:1"]
    made = corpus_source.corpus_requests(corpus, "t", 2).orderBy("request_id").collect()
    assert [r.request_id for r in made] == ["local:t:locomo:conv-0:s10:chunk-0", "local:t:locomo:conv-0:s1:chunk-0",
                                            "local:t:locomo:conv-0:s1:chunk-1"]
    base = 1_683_554_160_000
    assert [(m.role, m.content, m.timestamp) for m in made[1].messages] == [("user", "hello there", base)]
    assert [(m.role, m.timestamp) for m in made[2].messages] == [("assistant", base + 120_000)]
    assert made[0].messages[0].timestamp == 1_672_531_200_000
    chunks = corpus_source.chunk_map(corpus_source.corpus_chunks(corpus, "t"))
    assert sorted((r.position, r.dia_id) for r in chunks.collect()) == [(0, "D10:1"), (0, "D1:1"), (1, "D1:3")]


def test_questions(spark, corpus):
    got = [tuple(r) for r in corpus_source.corpus_questions(corpus).orderBy("question_id").collect()]
    assert got == [("conv0-q0", 0, "which dog", "Ollie", 1, ["D1:3"]), ("conv0-q3", 0, "what colour", "3", 2, [])]


def test_session_dates(spark):
    texts = ["1:56 pm on 8 May, 2023", "10:05 AM on 21 Sep, 2023", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(corpus_source.session_millis(F.col("t"))).collect()]
    assert got == [1_683_554_160_000, 1_695_290_700_000, 1_672_531_200_000, 1_672_531_200_000]


def test_a_run_from_corpus_to_recall(spark, corpus, tmp_path):
    embedder = hashed_embedder(64)
    AddJob(str(tmp_path / "s"), embedder).run(corpus_source.corpus_requests(corpus, "t"), 0)
    memories = tables.read_memories(spark, str(tmp_path / "s"))
    job = EvaluationJob(SearchJob(embedder), "later", store_tag="t")
    asked = corpus_source.corpus_questions(corpus)
    ranking = job.retrieve(memories, asked).cache()
    shown = {k: v.collect() for k, v in report(ranking, asked, job.chunk_map(corpus)).items()}
    assert {(r.k, r.hits, r.n) for r in shown["recall_at_k"]} >= {(5, 1, 1), (100, 1, 1)}
    assert {(r.kind, r.hits) for r in shown["recall_by_kind"]} == {("raw", 1), ("fact", 0)}
    other = EvaluationJob(SearchJob(embedder), "later")
    with pytest.raises(ValueError):
        report(ranking, asked, other.chunk_map(corpus))
    ranking.unpersist()


A, B = "a" * 16, "b" * 16


def scored(spark):
    chunks = spark.createDataFrame([(A, 0, "d0"), (A, 1, "d1"), (B, 0, "d2"), (B, 1, "")],
                                   "digest string, position int, dia_id string")
    ranking = [("q1", 0, f"{B}-r0"), ("q1", 1, f"{A}-f0"), ("q1", 2, f"{A}-r1"), ("q2", 0, f"{A}-r0"),
               ("q2", 1, "broken"), ("q2", 2, f"{'c' * 16}-r0"), ("q3", 0, f"{B}-r1")]
    retrieval = spark.createDataFrame(ranking, "question_id string, pos int, id string").withColumn("content", F.col("id"))
    questions = spark.createDataFrame(
        [("q1", 1, ["d1"]), ("q2", 1, ["d2", "d1"]), ("q3", 2, ["d2"]), ("q4", 2, [])],
        "question_id string, category int, evidence array<string>").withColumn("question", F.col("question_id"))
    return chunks, retrieval, questions


def test_provenance(spark):
    chunks, retrieval, _ = scored(spark)
    got = {(r.id, r.dia_id) for r in evaluation.result_provenance(retrieval, chunks).collect()}
    assert got == {(f"{B}-r0", "d2"), (f"{A}-f0", "d0"), (f"{A}-f0", "d1"), (f"{A}-r1", "d1"), (f"{A}-r0", "d0")}


def test_recall(spark):
    chunks, retrieval, questions = scored(spark)
    found = evaluation.first_hits(questions, evaluation.evidence_hits(retrieval, questions, chunks))
    assert {(r.question_id, r.first_pos) for r in found.collect()} == {("q1", 1), ("q2", None), ("q3", None)}
    at = {r.k: (r.hits, r.n) for r in evaluation.recall_at_k(found, (1, 2)).collect()}
    assert at == {1: (0, 3), 2: (1, 3)}
    kinds = {r.kind: r.hits for r in evaluation.recall_by_kind(retrieval, questions, chunks).collect()}
    assert kinds == {"raw": 1, "fact": 1}
    by = {(r.category, r.is_total): (r.n, r.hits) for r in evaluation.recall_by_category(found).collect()}
    assert by == {(1, 0): (2, 1), (2, 0): (1, 0), (None, 1): (3, 1)}


def test_sweep(spark):
    chunks, retrieval, questions = scored(spark)
    labels = {1: ["CORRECT", "WRONG", None, "WRONG"], 2: ["CORRECT", "WRONG", "WRONG", "WRONG"],
              5: ["CORRECT", "CORRECT", "WRONG", "WRONG"], 9: ["WRONG", "CORRECT", "WRONG", "CORRECT"]}
    rows = [(p, f"q{n}", v) for p, vs in labels.items() for n, v in zip((1, 2, 3, 99), vs)]
    judged = spark.createDataFrame(rows, "prefix int, question_id string, label string")
    found = evaluation.first_hits(questions, evaluation.evidence_hits(retrieval, questions, chunks))
    sweep = evaluation.answer_sweep(judged, questions, retrieval, found)
    got = {r.prefix: tuple(r)[1:] for r in evaluation.rounded_sweep(sweep).collect()}
    assert got == {1: (3, 0.333, 0.0, 0.0, 0.5), 2: (4, 0.25, 0.333, 1.0, 0.0), 5: (4, 0.5, 0.333, 1.0, 0.5),
                   9: (4, 0.5, 0.333, 0.0, 0.5)}
    best = evaluation.best_prefix(sweep)
    assert best.first().prefix == 5
    flips = {r.prefix: (r.only_other, r.only_best, r.shared, r.net) for r in evaluation.paired_flips(judged, best).collect()}
    assert flips == {1: (0, 1, 3, 1), 2: (0, 1, 4, 1), 9: (1, 1, 4, 0)}
    summary = {r.prefix: (r.valid, r.correct, r.excluded) for r in evaluation.judge_summary(judged).collect()}
    assert summary[1] == (3, 1, 1)


def test_answers_resume(spark):
    _, retrieval, questions = scored(spark)
    previous = spark.createDataFrame([("q1", "kept"), ("q2", " "), ("q3", None)], "question_id string, generated_answer string")

    def answerer():
        def call(prompt):
            if "q3" in prompt:
                raise RuntimeError("down")
            return "new: " + prompt.split("\n")[0]
        return call

    rows = {r.question_id: (r.generated_answer, r.gap) for r in answer(retrieval, questions, previous, 1, answerer).collect()}
    assert rows["q1"] == ("kept", False) and rows["q2"] == (f"new: {A}-r0", False)
    assert rows["q3"] == ("", True) and rows["q4"][1] is False


def test_sign_test_matches_binomial(spark):
    cases = [(0, 0), (1, 0), (149, 79), (134, 107), (52, 51), (5, 5), (0, 12), (3000, 2800)]
    df = spark.createDataFrame(cases, "fixes bigint, breaks bigint")
    for row in replicates.sign_test(df).collect():
        n, small = row.fixes + row.breaks, min(row.fixes, row.breaks)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(small + 1)) / 2**n)
        assert row.p_value == pytest.approx(want, rel=1e-9)


def test_replicates(spark):
    runs = {("c", 1): [1, 0, 1], ("c", 2): [1, 0, 0], ("c", 3): [1, 1, 0], ("h", 1): [1, 1, 1], ("h", 2): [1, 1, 1], ("h", 3): [1, 1, 0]}
    rows = [(arm, run, f"q{n}", n % 2, bool(v)) for (arm, run), vs in runs.items() for n, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "arm string, run int, question_id string, category int, right boolean")
    spread = {r.arm: (round(r["mean"], 3), round(r.sd, 3)) for r in replicates.run_spread(df).collect()}
    assert spread == {"c": (0.556, 0.192), "h": (0.889, 0.192)}
    voted = replicates.majority(df)
    flips = replicates.arm_flips(voted.where("arm = 'c'"), voted.where("arm = 'h'")).first()
    assert (flips.fixes, flips.breaks, flips.n) == (2, 0, 3)
    assert [r.question_id for r in replicates.stable_questions(voted).collect()] == ["q0"]


def test_bm25_equals_a_plain_loop(spark):
    texts = ["the dog ate", "dog dog cat", "the cat", "a bird sang the song", "", "nothing here"]
    memories = spark.createDataFrame([(f"{n:016x}-r0", "u", n, t) for n, t in enumerate(texts)],
                                     "id string, user_id string, seq bigint, content string")
    queries = spark.createDataFrame([("q1", "u", "the dog, THE dog!"), ("q2", "u", "zebra"), ("q3", "v", "dog")],
                                    "query_id string, user_id string, query string")
    words = [t.split() for t in texts]
    mean, want = sum(map(len, words)) / len(words), {}
    for n, doc in enumerate(words):
        for term in ("the", "dog"):
            df = sum(term in d for d in words)
            idf = max(math.log((len(words) - df + 0.5) / (df + 0.5)), 1e-6)
            tf = Counter(doc)[term]
            want[n] = want.get(n, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
    want = {n: round(s, 6) for n, s in want.items() if s > 0}
    for strategy in ("scan", "grid"):
        hits = lexical.bm25_hits(memories, queries, 10, strategy, slice_rows=2).collect()
        assert {r.query_id for r in hits} == {"q1"}
        assert {r.seq: round(r.score, 6) for r in hits} == want


def test_fusion(spark):
    schema = "query_id string, id string, seq bigint, p int"
    dense = spark.createDataFrame([("q", "a", 1, 1), ("q", "b", 2, 2), ("q", "late", 9, 201)], schema)
    lex = spark.createDataFrame([("q", "b", 2, 1), ("q", "c", 3, 2)], schema)
    rows = lexical.fuse(dense, lex, 10, 2.0).orderBy("p").collect()
    assert [r.id for r in rows] == ["b", "c", "a"]
    assert rows[0].score == round(1 / 62 + 2 / 61, 9)


def test_diversity_cap_when_chunks_crowd_the_top(spark):
    rows = [(f"{n // 30:016x}-r{n % 30}", "u", n, [1.0 - n / 1000, 0.0]) for n in range(120)]
    memories = spark.createDataFrame(rows, "id string, user_id string, seq bigint, vec array<float>")
    queries = spark.createDataFrame([("q", "u", [1.0, 0.0])], "query_id string, user_id string, qvec array<double>")

    for plan in ({}, {"strategy": "grid", "slice_rows": 9}):
        got = [r.seq for r in policies.diverse_hits(memories, queries, 7, **plan).orderBy("p").collect()]
        assert got == [0, 1, 30, 31, 60, 61, 90]


def test_parents_within_a_budget(spark):
    items = spark.createDataFrame([("q", n, c) for n, c in enumerate(["x" * 9, "y" * 8, "z" * 3, "w"])],
                                  "query_id string, pos int, content string")

    def kept(budget):
        return sorted(r.pos for r in policies.within_budget(items, budget).collect())

    assert kept(5) == [0] and kept(13) == [0, 2, 3] and kept(100) == [0, 1, 2, 3]
    size = policies.footprint(items.withColumn("id", F.concat(F.lit(A), F.lit("-r0")))).first()
    assert (size["items"], size.chars, size.chunks) == (4, 21, 1)
