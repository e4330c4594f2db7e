"""Tables of evaluation runs, by tag and prefix.

A *tag* names a run. Its retrieval and chunk map are folders ``tag=...``; answers and judged
answers are folders ``tag=.../prefix=...`` below that. Writing a tag (or a tag and prefix)
replaces it and leaves the others alone. Which prefixes were judged is read from the folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from turnstore.operators import evaluation
from turnstore.sources.store import read_or_empty
from turnstore.sources.tables import write_results

_TAG, _PREFIX = T.StructField("tag", T.StringType()), T.StructField("prefix", T.IntegerType())
_QUESTION = T.StructField("question_id", T.StringType())
TABLES = {
    "retrieval": T.StructType([_QUESTION, T.StructField("pos", T.IntegerType()), T.StructField("id", T.StringType()),
                               T.StructField("content", T.StringType()), _TAG]),
    "chunks": T.StructType([T.StructField("digest", T.StringType()), T.StructField("position", T.IntegerType()),
                            T.StructField("dia_id", T.StringType()), T.StructField("conv", T.IntegerType()), _TAG]),
    "answers": T.StructType([_QUESTION, T.StructField("generated_answer", T.StringType()), _TAG, _PREFIX]),
    "judged": T.StructType([_QUESTION, T.StructField("label", T.StringType()), T.StructField("judge_raw", T.StringType()),
                            _TAG, _PREFIX]),
    "sweep": T.StructType([T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in (
        "accuracy", "coverage", "accuracy_given_retrieved", "accuracy_given_missed")], _TAG, _PREFIX]),
}


@dataclass(frozen=True)
class Results:
    """Evaluation tables below *root*."""

    root: str

    def write(self, name: str, rows: DataFrame, tag: str, prefix: int | None = None) -> None:
        """Replace the rows of *tag* in table *name*; of one prefix, or of every prefix in *rows*."""
        schema = TABLES[name]
        rows = rows.withColumn("tag", F.lit(tag))
        rows = rows if prefix is None else rows.withColumn("prefix", F.lit(prefix))
        known = [F.col(f.name) if f.name in rows.columns else F.lit(None) for f in schema]
        rows = rows.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(known, schema)])
        write_results(rows, f"{self.root}/{name}", [c for c in ("tag", "prefix") if c in schema.fieldNames()])

    def read(self, spark: SparkSession, name: str, tag: str | None = None, prefix: int | None = None) -> DataFrame:
        """Table *name*, whole or of one tag and prefix: a filter on folders."""
        rows = read_or_empty(spark, TABLES[name], f"{self.root}/{name}")
        rows = rows if tag is None else rows.where(F.col("tag") == tag)
        return rows if prefix is None else rows.where(F.col("prefix") == prefix)

    def prefixes(self, spark: SparkSession, tag: str) -> DataFrame:
        """The judged prefixes of *tag* in numerical order."""
        return self.read(spark, "judged", tag).select("prefix").distinct().orderBy("prefix")

    def of_stores(self, spark: SparkSession, name: str, runs: DataFrame) -> DataFrame:
        """Table *name* of the stores that *runs* (tag, store_tag; null: its own) were retrieved from.

        Only the folders of these stores are read (a run is a row in *runs*, so their names are
        few); rows carry the tag of the run.
        """
        stores = runs.select(F.col("tag").alias("_run"), F.coalesce("store_tag", "tag").alias("tag")).distinct()
        names = sorted({r.tag for r in stores.select("tag").collect()})
        return (self.read(spark, name).where(F.col("tag").isin(names)).join(F.broadcast(stores), "tag")
                .drop("tag").withColumnRenamed("_run", "tag"))

    def sweep(self, spark: SparkSession, tag: str, questions: DataFrame, store_tag: str | None = None) -> DataFrame:
        """Accuracy and coverage at every judged prefix of *tag*, from what is stored.

        *store_tag* is the run whose memories were searched, and whose chunk map tells where they came from.
        """
        retrieval = self.read(spark, "retrieval", tag).drop("tag")
        return evaluation.answer_sweep(self.read(spark, "judged", tag), questions, retrieval, self.found(spark, tag, questions, store_tag))

    def found(self, spark: SparkSession, tag: str, questions: DataFrame, store_tag: str | None = None) -> DataFrame:
        """Where each question of *tag* first has evidence, by the chunk map of its store."""
        runs = spark.createDataFrame([(tag, store_tag)], "tag string, store_tag string")
        chunks = self.of_stores(spark, "chunks", runs).drop("tag")
        retrieval = self.read(spark, "retrieval", tag).drop("tag")
        return evaluation.first_hits(questions, evaluation.evidence_hits(retrieval, questions, chunks))
