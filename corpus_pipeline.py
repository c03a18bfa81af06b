"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared checkpoint folder and rereads it as the
next stage's documents.  All but the last stage return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.llm import lines, packing, quality, simhash
from mixlens.llm.common import stored, table
from mixlens.llm.queries import SCORE_CUT, vocabulary_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score below the cut go.  Without a single usable
    label nothing speaks against any document, and all stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    scored = quality.score(docs.withColumnRenamed("score", "_score_in"), model)
    kept = scored.filter(F.col("score") >= SCORE_CUT).drop("score")
    return kept.withColumnRenamed("_score_in", "score").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of near-equal lines the first stays; n_chars follows the text."""
    out = lines.dedup_lines(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of linked rows the one with the smallest id stays (a
    NULL id comes last).  Rows are told apart by number, so of rows repeated with
    the same id, or without one, a single one stays too."""
    rows = stored(docs.withColumn("_near_row", F.monotonically_increasing_id()))
    found = simhash.near_duplicates(rows, words=3, max_bits=3, id_col="_near_row").select("_near_row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_near_row"))
    first = found.join(rows.select("_near_row", order.alias("order")).hint("merge"), "_near_row").groupBy("component_id").agg(
        F.min("order").alias("least")).select(F.col("least._near_row").alias("_near_row"))
    return rows.join(first, "_near_row", "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token sequences of 1024."""
    return packing.packed_documents(docs, vocabulary_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup),
          ("simhash", near_duplicates), ("packing", pack)]

#: MinHash candidates, shingle votes and tokens are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
