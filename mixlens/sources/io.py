"""File sources and sinks.

Readers find columns by each file's own header and cast them to explicit types
(no inference); records that do not hold go to a reject table with the column
and the reason.  Text dates in the driver file are day/month/year with '/' or
'-'.  Column names with spaces are snake_cased once, here, by one mapping.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlens.functions.scalar import parse_dmy
from mixlens.operators.joins import bounded_broadcast
from mixlens.session import cut_lineage

PANEL_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("sessions", T.LongType()),
    T.StructField("bookings", T.LongType()),
])

META_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("tv_ad_reach", T.DoubleType()),
    T.StructField("consumer_confidence_index", T.DoubleType()),
    T.StructField("exchange_rate", T.DoubleType()),
    T.StructField("online_visibility", T.DoubleType()),
    T.StructField("weather_index", T.StringType()),
])

GROUPINGS_SCHEMA = T.StructType([
    T.StructField("var_name", T.StringType()),
    T.StructField("grouping", T.StringType()),
])

SHEET_SCHEMA = T.StructType([T.StructField("product_id", T.StringType())])


def snake(name: str) -> str:
    """'Consumer.Confidence.Index', 'DayFriday' -> 'consumer_confidence_index', 'day_friday'."""
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^0-9a-zA-Z]+", "_", split).strip("_").lower()


def snake_col(col: Column) -> Column:
    """``snake`` of a string column."""
    split = F.regexp_replace(col, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.btrim(F.regexp_replace(split, "[^0-9a-zA-Z]+", "_"), F.lit("_")))


class Checked(NamedTuple):
    """What a checked read found: the rows that hold, and one row (file, record,
    column, reason, value) for every fault of every other record."""
    rows: DataFrame
    rejects: DataFrame


MAX_HEADERS = 1000
Parser = Callable[[Column], Column]


def _header_names(line: str) -> list[str]:
    return [snake(name) for name in next(csv.reader([line.lstrip("\ufeff")]))]


def read_checked(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                 parsers: dict[str, Parser] | None = None, required: Sequence[str] = ()) -> Checked:
    """Read CSV files whose first lines name their columns, one record a line.

    Every file is read by its own header: columns may stand in another order from
    file to file, further columns are ignored.  A record is rejected for a field
    count other than its header's, for a value its column's type cannot hold, and
    for a missing value in a ``required`` column; all records of a file that lacks
    a column are.  If every file lacks one, ValueError.  ``parsers`` replace the
    cast of a column from its text.  What was parsed is written once, so rows and
    rejects come from one pass over the files."""
    parsers = parsers or {}
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "\\r$", "").alias("record"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # a file's header is the first line of its first block
    headers = cut_lineage(lines.filter("block = 0").groupBy("file").agg(
        F.min_by("record", "id").alias("header"), F.min("id").alias("header_id")))
    kinds = [r["header"] for r in headers.select("header").distinct().limit(MAX_HEADERS + 1).collect()]
    if len(kinds) > MAX_HEADERS:
        raise ValueError(f"{path}: more than {MAX_HEADERS} different headers")
    names = {h: _header_names(h) for h in kinds}
    lacking = {h: [f.name for f in schema.fields if f.name not in names[h]] for h in kinds}
    if kinds and all(lacking.values()):
        raise ValueError(f"{path}: no column {', '.join(lacking[kinds[0]])} among {kinds[0]}")
    data = lines.join(bounded_broadcast(headers, materialise=False), "file").filter(
        ((F.col("block") != 0) | (F.col("id") != F.col("header_id"))) & (F.trim("record") != ""))
    fault = "array<struct<column: string, reason: string, value: string>>"
    parts = None
    for header in kinds:
        mine = data.filter(F.col("header") == header)
        if lacking[header]:
            faults = F.array(*[F.struct(F.lit(c).alias("column"), F.lit("missing_column").alias("reason"),
                                        F.lit(None).cast("string").alias("value")) for c in lacking[header]])
            part = mine.select("file", "record", faults.cast(fault).alias("faults"),
                               *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        else:
            fields = ", ".join(f"f{i} string" for i in range(len(names[header])))
            parsed = F.from_csv("record", F.lit(f"{fields}, _corrupt string"), {"columnNameOfCorruptRecord": "_corrupt"})
            mine = mine.withColumn("p", parsed)
            text = {f.name: F.col("p")[f"f{names[header].index(f.name)}"] for f in schema.fields}
            value = {f.name: parsers[f.name](text[f.name]) if f.name in parsers else text[f.name].try_cast(f.dataType)
                     for f in schema.fields}
            found = [F.when(F.col("p._corrupt").isNotNull(), F.struct(
                F.lit(None).cast("string").alias("column"), F.lit("field_count").alias("reason"), F.lit(None).cast("string").alias("value")))]
            for f in schema.fields:
                bad = F.when(text[f.name].isNotNull() & value[f.name].isNull(), f"not_{f.dataType.simpleString()}")
                if f.name in required:
                    bad = F.when(text[f.name].isNull(), "missing_value").otherwise(bad)
                found.append(F.when(F.col("p._corrupt").isNull() & bad.isNotNull(), F.struct(
                    F.lit(f.name).alias("column"), bad.alias("reason"), text[f.name].alias("value"))))
            part = mine.select("file", "record", F.array_compact(F.array(*found)).cast(fault).alias("faults"),
                               *[value[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
        parts = part if parts is None else parts.unionAll(part)
    if parts is None:
        return Checked(spark.createDataFrame([], schema), spark.createDataFrame(
            [], "file string, record string, column string, reason string, value string"))
    parts = cut_lineage(parts)
    rows = parts.filter(F.size("faults") == 0).select(*[f.name for f in schema.fields])
    rejects = parts.filter(F.size("faults") > 0).select("file", "record", F.explode("faults").alias("f")).select(
        "file", "record", "f.column", "f.reason", "f.value")
    return Checked(rows, rejects)


META_DATES = T.StructType([T.StructField("date", T.DateType()), *META_SCHEMA.fields[1:]])


def check_panel_csv(spark: SparkSession, path: str | Sequence[str]) -> Checked:
    """S1 product panel CSV (header; ISO dates); ids are read as text."""
    return read_checked(spark, path, PANEL_SCHEMA, required=("product_id", "date"))


def check_meta_csv(spark: SparkSession, path: str | Sequence[str]) -> Checked:
    """S2 driver series CSV; day/month/year text dates -> date (F1); snake_case names."""
    return read_checked(spark, path, META_DATES, {"date": parse_dmy}, required=("date",))


def check_groupings_csv(spark: SparkSession, path: str | Sequence[str]) -> Checked:
    """S3 term -> group dictionary; term names snake_cased to match the engine."""
    found = read_checked(spark, path, GROUPINGS_SCHEMA, required=("var_name", "grouping"))
    return Checked(found.rows.select(snake_col(F.col("var_name")).alias("var_name"), "grouping"), found.rejects)


def read_panel_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The rows of ``check_panel_csv`` that hold."""
    return check_panel_csv(spark, path).rows


def read_meta_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The rows of ``check_meta_csv`` that hold."""
    return check_meta_csv(spark, path).rows


def read_groupings_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The rows of ``check_groupings_csv`` that hold."""
    return check_groupings_csv(spark, path).rows


def write_segments_csv(groupings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S4 (product_id, product_type) with a header and no row-number column."""
    groupings.select("product_id", "product_type").write.mode(mode).option("header", True).csv(path)


def write_models(models: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S5 the model table as parquet, partitioned by target."""
    models.write.mode(mode).partitionBy("target").parquet(path)


def read_models(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """S6 reload fitted models instead of refitting (partition-pruned by target)."""
    m = spark.read.parquet(path)
    return m.filter(F.col("target") == target) if target else m


class ModelStore:
    """S5, S6 fitted models by run: ``models/run=.../target=...`` and a list of runs.

    A run counts once it is in the list, which is written after its models, so
    a reader never sees half a run; loading prunes to one run and one target."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self) -> list[str]:
        """Names of the finished runs, oldest first (one short row each)."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        return [r["run"] for r in self.spark.read.parquet(f"{self.path}/runs").orderBy("no").collect()]

    def save(self, models: DataFrame, run: str) -> None:
        done = self.runs()
        if run in done:
            raise ValueError(f"run {run!r} is in the store")
        models.write.mode("overwrite").partitionBy("target").parquet(f"{self.path}/models/run={run}")
        self.spark.createDataFrame([(len(done), run)], "no int, run string").coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def load(self, target: str, run: str | None = None) -> DataFrame:
        """One target's models of a run, the latest unless named."""
        done = self.runs()
        if not done or (run is not None and run not in done):
            raise ValueError(f"{self.path}: no run {run or ''}")
        found = self.spark.read.option("basePath", f"{self.path}/models").parquet(f"{self.path}/models")
        return found.filter((F.col("run") == (run or done[-1])) & (F.col("target") == target)).drop("run")


def answer_sheet(spark: SparkSession, sheet_path: str, groupings: DataFrame) -> DataFrame:
    """S7 complete an answer sheet CSV (product_id, blank product_type)."""
    return read_checked(spark, sheet_path, SHEET_SCHEMA).rows.join(groupings, on="product_id", how="left")
