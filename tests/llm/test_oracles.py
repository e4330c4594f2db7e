"""Queries of the corpus operators against their SQL: the driver's tables and an awkward one."""

import collections
import os

import duckdb
import pytest

from turnstore.llm import oracles, queries

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"w{i}" for i in range(20))
DOCUMENTS = [
    (0, None, "en", "a", 0), (1, "", None, None, 0), (2, " \t\n", "en", "a", 3), (3, "one", "de", "", 3), (4, "a b c", "en", "a", 5),
    (5, "A  b\nC", "en", "b", 6), (6, "pre " + PASSAGE.upper() + " post", "en", "a", 70), (7, PASSAGE + " x", "en", "a", 70),
    (8, PASSAGE + " x", "en", "b", 70), (9, "Released under the MIT License. All rights reserved.\nall rights reserved", "en", None, 60),
    (10, "Über déjà 日本 \U0001f600 it's a short, test item!", "fr", "c", 40), (11, "long " * 9_000, "en", "a", 45_000)]
ITEMS = [(1, PASSAGE), (2, "Short TEST item"), (3, ""), (4, None), (10, "short test item"), (5, "one"), (None, PASSAGE)]

TURNS = [(c, t, r, x) for c in range(45) for t, (r, x) in enumerate([("user", "hi there"), (None, "x  y"), ("a", None), ("", "z")][:1 + c * 7 % 5])]
TURNS += [(60, None, "user", "first"), (60, 1, "user", "hi there"), (-7, 0, "user", "minus"), (None, 0, "user", "nobody's"), (2**40, 3, "u", "hi " * 900)]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(2).write.parquet(
        f"{folder}/conversations.parquet")
    return folder


def agrees(spark, folder, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        path = f"{folder}/{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' * os.path.isdir(path)}'")
    result = connection.execute(oracles.ORACLES[name])
    columns = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    got = collections.Counter(tuple(row[c] for c in columns) for row in df.collect())
    assert got == collections.Counter(result.fetchall()) and got


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data is not here")
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    agrees(spark, SF, name)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql_on_awkward_rows(spark, awkward, name):
    agrees(spark, awkward, name)
