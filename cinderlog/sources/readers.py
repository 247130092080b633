"""Sources: files and frames of logs or parsed records, each with `ord`, the record's place, from 0 without gaps."""

from __future__ import annotations

import ast
import json
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.functions.text import strip
from cinderlog.operators.order import with_ordinal
from cinderlog.runtime import on_workers
from cinderlog.sources.schemas import LOG, conform
from cinderlog.sources.wire import decode


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of the lines of files, in the files' order: by file, by where a split starts, by line."""
    raw = spark.read.text(path)
    placed = raw.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return with_ordinal(placed, "_f", "_b", "_m").select("ord", "value")


def read_log(spark: SparkSession, path: str, source: str | None = None, host: str | None = None) -> DataFrame:
    """A text file, one record a line, blank lines too; logID is the line's place."""
    lines = _lines(spark, path)
    full = lines.select("ord", F.col("ord").cast("string").alias("logID"), strip(F.col("value")).alias("log"), F.lit(source).alias("logSource"), F.lit(host).alias("hostname"))
    return conform(full, LOG, "ord")


def read_wire(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file whose lines are the printed bytes of one message each, as write_wire makes them."""
    on_workers(spark)

    def messages(batches):
        for x in batches:
            rows = [decode(ast.literal_eval(v), schema) for v in x["value"]]
            yield pd.DataFrame({"ord": x["ord"], **{f.name: pd.Series([r[f.name] for r in rows], dtype=object) for f in schema}})

    return _lines(spark, path).mapInPandas(messages, T.StructType([T.StructField("ord", T.LongType()), *schema]))


def read_indexed_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object {"0": {...}, "1": {...}}; records by number."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), schema))).alias("k", "v"))
    return with_ordinal(entries.withColumn("k", F.col("k").cast("long")), "k").select("ord", "v.*")


def _rows(spark: SparkSession, records: list[dict[str, Any]], schema: T.StructType) -> DataFrame:
    full = T.StructType([T.StructField("ord", T.LongType()), *schema])
    return spark.createDataFrame([(i, *(r.get(f.name) for f in schema)) for i, r in enumerate(records)], full)


def read_indexed_yaml(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A YAML mapping of numbers to records. YAML is read as a whole, so this is for files that fit on the driver."""
    with open(path, encoding="utf-8") as f:
        full = yaml.safe_load(f) or {}
    return _rows(spark, [full[k] for k in sorted(full, key=int)], schema)


def from_frame(df: DataFrame, *order: str) -> DataFrame:
    """A structured frame (Content, EventIDs, Templates and, if there, ParamList) to parsed records. All other columns
    become header fields. order: columns that give the records' order; logID is the record's place."""
    renamed = df.withColumnsRenamed({"Content": "log", "ParamList": "variables", "EventIDs": "EventID", "Templates": "template"})
    if "variables" not in renamed.columns:
        renamed = renamed.withColumn("variables", F.array().cast("array<string>"))
    others = [c for c in renamed.columns if c not in ("log", "variables", "EventID", "template", "ord")]
    fields = F.create_map(*(x for c in others for x in (F.lit(c), F.col(c).cast("string")))) if others else F.create_map().cast("map<string,string>")
    new = {"Content": "log", "ParamList": "variables", "EventIDs": "EventID", "Templates": "template"}
    placed = with_ordinal(renamed, *(new.get(c, c) for c in order)) if order else renamed
    return placed.select("ord", F.col("ord").cast("string").alias("logID"), "log", F.col("EventID").cast("int").alias("EventID"), "template", "variables", F.map_filter(fields, lambda _, v: v.isNotNull()).alias("logFormatVariables"))


def normalise(spark: SparkSession, data: Any) -> DataFrame:
    """A DataFrame, pandas frame, dict of columns or list of dicts to a DataFrame; ValueError for anything else."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data)
    if isinstance(data, dict):
        return spark.createDataFrame(pd.DataFrame(data))
    if isinstance(data, list) and all(isinstance(x, dict) for x in data):
        return spark.createDataFrame(pd.DataFrame(data))
    raise ValueError(f"no frame: {type(data).__name__}")


def read_structured_csv(spark: SparkSession, path: str, content: str = "Content") -> DataFrame:
    """(ord, log) from a CSV file's content column."""
    rows = spark.read.option("header", True).option("multiLine", False).csv(path)
    placed = rows.select(F.col(content).alias("log"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return with_ordinal(placed, "_f", "_b", "_m").select("ord", "log")


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """A folder that text files arrive in, as a stream of records without an order."""
    return spark.readStream.text(path).select(strip(F.col("value")).alias("log"))


def read_any(spark: SparkSession, path: str, kind: str, schema: T.StructType = LOG) -> DataFrame:
    """By kind: log, wire, json or yaml."""
    if kind == "log":
        return read_log(spark, path)
    return {"wire": read_wire, "json": read_indexed_json, "yaml": read_indexed_yaml}[kind](spark, path, schema)


def parse_object(text: str) -> dict[str, Any]:
    return json.loads(text)
