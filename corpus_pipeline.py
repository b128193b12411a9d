"""From raw documents to a training mix: five stages, each on all its predecessor kept.

Decisions are taken for rows and brought back to them by a row number, so that rows with a
null or a repeated doc_id are judged like all others. The doc_id only says which row of a
group stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.llm.decontamination import contamination
from carryover.llm.exact_dedup import exact_dedup
from carryover.llm.jaccard_join import jaccard_groups
from carryover.llm.language_id import annotated, fold
from carryover.llm.mixing import mix_sources, word_count
from carryover.session import materialise, reachable


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with _row, the number of a row by its file and its place there: every reading gives the same."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":  # not simply files that are read
        docs = materialise(docs, "rows")
    named = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    files = sorted(r[0] for r in named.select("_file").distinct().collect())  # one row per file
    numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "_file string, _number bigint")
    return (named.join(F.broadcast(numbers), "_file")
            .select(*docs.columns, (F.shiftleft("_number", 40) + F.col("_place")).alias("_row")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The numbered ``docs`` without the rows of ``gone`` (_row)."""
    return docs.join(materialise(gone, "gone"), "_row", "left_anti").drop("_row")


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects (no letter, or far from every language) go."""
    named = annotated(docs, docs.where(F.coalesce(fold("doc_id", 5) != 0, F.lit(False))))
    return named.where("NOT _rejected").select(docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts one row with the largest doc_id stays."""
    rows = _numbered(docs)
    found = exact_dedup(rows, row_col="_row")
    return _without(rows, found.where("NOT kept").select("_row"))


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): one row with the smallest doc_id of each group stays."""
    rows = _numbered(docs)
    groups = jaccard_groups(rows, "_row", shingle=5, percent=80).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group"))
    named = materialise(groups.join(rows.select("_row", "doc_id"), "_row"), "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row"))
    kept = named.groupBy("group").agg(first.alias("first")).select("first._row")
    return _without(rows, named.select("_row").join(kept, "_row", "left_anti"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a window of a benchmark item go."""
    rows = _numbered(docs)
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_row")
    return _without(rows, found.where("contaminated").select(F.col("doc_id").alias("_row")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: how many words and copies of each document the mix takes."""
    return mix_sources(docs, word_count(F.col("text")), weights=(5, 2, 1), limit=3.0)


STAGES = [("language_id", recognised), ("exact_dedup", deduplicated), ("jaccard_join", distinct_enough),
          ("decontamination", decontaminated), ("source_mixing", mixed)]

# Language ID and the join over whole sets have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
