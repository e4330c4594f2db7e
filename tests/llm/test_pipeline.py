"""The pipeline as a whole on a small folder: which documents reach the sequences, stage by stage."""

import random
import re

import pytest

import corpus_pipeline
from turnstore.llm import quality_classifier
from turnstore.llm.queries import table

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
RND = random.Random(21)
GOOD, BAD = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]


def text(words, n=60):
    return " ".join(f"{RND.choice(words)} v{RND.randrange(10**6)}" for _ in range(n // 2))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    item = " ".join(f"item{i}" for i in range(30))
    docs = [(i, text(BAD if i % 4 == 0 else GOOD)) for i in range(120)]
    docs += [(200 + i, docs[1][1]) for i in range(3)] + [(210, docs[2][1].replace(" v", " V", 1) + " tail"), (211, docs[3][1] + " one more")]
    docs += [(300, item), (301, text(GOOD, 10) + " " + item), (302, text(GOOD, 60) + " mail a.b@c.de " + text(GOOD, 4)), (303, None), (304, "")]
    docs += [(400, " ".join(text(GOOD, 4000) for _ in range(2)))]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 != 0), 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def contaminated(text, item):
    """Hit words are those inside any thirteen words of the item; a twentieth of all is too many."""
    words = re.findall(r"[a-z0-9]+", (text or "").lower())
    windows = {tuple(item[i:i + 13]) for i in range(len(item) - 12)}
    hit = set()
    for i in range(len(words) - 12):
        if tuple(words[i:i + 13]) in windows:
            hit |= set(range(i, i + 13))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_documents_that_reach_the_sequences(spark, folder):
    docs = table(spark, folder, "documents")
    kept = {r.doc_id: r.text for r in quality_classifier.keep_accepted(docs, table(spark, folder, "labels")).collect()}
    assert not any(i % 4 == 0 for i in kept if i < 120) and sum(i < 120 for i in kept) > 80
    sets = {i: shingles(t) for i, t in kept.items()}
    first = {}
    for i in sorted(kept):
        # Copies of one text, and texts with one word more: links do not chain here.
        same = [j for j in first if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        if not same:
            first[i] = kept[i]
    item = [f"item{i}" for i in range(30)]
    expected = {i for i, t in first.items() if not contaminated(t, item)}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == expected
    assert 1 in expected and not expected & {200, 201, 202, 300, 301}
    loads = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == loads.get(p.sequence_id, 0)
        loads[p.sequence_id] = p.offset + p.length
    assert max(loads.values()) <= 4096


def test_stages_take_and_return_documents(spark, folder):
    docs = table(spark, folder, "documents")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, folder).columns == docs.columns, name
