"""JSON lines in and out: strict, counting, issue-emitting and lenient readers, and sinks.

Readers take a schema and keep where a row came from: lines are numbered split by split, and a split counts on from
those before it in its file, so a file of any size is read in as many tasks as it has splits.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import blank, strip


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_strict(spark: SparkSession, path: str, schema: T.StructType | str, required: bool = True) -> DataFrame:
    """Every line must be an object of the schema; a bad one fails the read, and so does a missing file, unless it
    isn't required."""
    if not required and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: T.StructType | str, required: bool = False) -> DataFrame:
    """Bad lines are left out; a missing file is empty unless it is required."""
    if not required and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _line, value) of the full lines, numbered from 1; blank lines count."""
    read = spark.read.option("lineSep", "\n").text(path)
    # the rows of a split follow one another, so their ids run on from the split's first
    each = read.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), "value", F.monotonically_increasing_id().alias("_at"))
    splits = each.groupBy("_file", "_from").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    starts = splits.select("_file", "_from", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = each.join(starts, ["_file", "_from"]).select("_file", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("_line"), "value")
    return numbered.where(~blank(F.col("value")))


def parsed(df: DataFrame, schema: T.StructType | str, value: Column | None = None) -> DataFrame:
    """``df`` with the fields of the schema and _error: json_decode_error, not_json_object or null."""
    value = F.col("value") if value is None else value
    variant = F.try_parse_json(strip(value))
    error = F.when(variant.isNull(), "json_decode_error").when(~F.schema_of_variant(variant).startswith("OBJECT"), "not_json_object")
    shape = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    out = df.withColumn("_error", error).withColumn("_row", F.when(F.col("_error").isNull(), F.from_json(value, shape)))
    return out.select(*df.columns, *[F.col("_row")[f.name].alias(f.name) for f in shape], "_error")


def read_counted(spark: SparkSession, path: str, schema: T.StructType | str, required: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows with _file and _line, (error, n)); a missing required file is one error."""
    if not exists(spark, path):
        rows = spark.createDataFrame([], T.StructType([T.StructField("_file", T.StringType()), T.StructField("_line", T.LongType()), *(schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))]))
        return rows, spark.createDataFrame([("missing_file", 1)] if required else [], "error string, n long")
    every = parsed(lines(spark, path), schema)
    errors = every.where("_error is not null").groupBy(F.col("_error").alias("error")).agg(F.count("*").alias("n"))
    return every.where("_error is null").drop("_error", "value"), errors


def read_issues(spark: SparkSession, path: str, schema: T.StructType | str, dataset: str, required: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, issues): each bad line an issue row with its place."""
    if not exists(spark, path):
        rows, _ = read_counted(spark, path, schema, required)
        return rows, spark.createDataFrame([("error", dataset, "missing_file", path, None)] if required else [], "severity string, dataset string, issue_type string, path string, line long")
    every = parsed(lines(spark, path), schema)
    bad = every.where("_error is not null").select(F.lit("error").alias("severity"), F.lit(dataset).alias("dataset"), F.col("_error").alias("issue_type"), F.col("_file").alias("path"), F.col("_line").alias("line"))
    return every.where("_error is null").drop("_error", "value"), bad


def read_object(path: str, default: Any = None) -> Any:
    """A small JSON file on the driver; any failure gives the default."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {} if default is None else default


def nested(value: Any, *path: str, default: Any = None) -> Any:
    """A value by path through nested objects."""
    for name in path:
        if not isinstance(value, dict) or name not in value:
            return default
        value = value[name]
    return value


def public(df: DataFrame) -> DataFrame:
    """Without internal columns (those that begin with an underscore)."""
    return df.select(*[f"`{c}`" for c in df.columns if not c.startswith("_")])


def write(df: DataFrame, path: str, overwrite: bool = True) -> None:
    public(df).write.mode("overwrite" if overwrite else "append").json(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the sink hasn't; a call repeated after a failure adds nothing twice."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    if exists(spark, path):
        fresh = fresh.join(spark.read.schema(df.schema).json(path).select(key), key, "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        public(fresh).write.mode("append").json(path)
    fresh.unpersist()
    return n


def write_object(path: str, value: Any) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def index_table(df: DataFrame, path: str) -> DataFrame:
    """Documents with their vectors as one Parquet table: nothing to pair up again on loading."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
