"""Sinks: records to Parquet and JSON lines in parallel, and to the single-file forms that other programs read.

The single-file forms (an indexed JSON or YAML object, printed bytes) are written by the driver, row by row from an ordered
iterator, so that its memory holds one partition at most; they are for exchange, not for bulk.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.runtime import on_workers
from cinderlog.sources.readers import read_any
from cinderlog.sources.schemas import LOG
from cinderlog.sources.wire import encode


def write_parquet(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def _records(df: DataFrame, schema: T.StructType) -> Iterator[dict[str, Any]]:
    names = [f.name for f in schema if f.name in df.columns]
    rows = df.orderBy("ord") if "ord" in df.columns else df
    for row in rows.select(*names).toLocalIterator():
        yield {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


def _append_indexed(path: str, records: Iterator[dict[str, Any]], load: Callable, dump: Callable, key: Callable) -> None:
    full = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            full = load(f) or {}
    n = len(full)
    for i, record in enumerate(records):
        full[key(n + i)] = record
    with open(path, "w", encoding="utf-8") as f:
        dump(full, f)


def write_indexed_json(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Add records to a JSON object under the next numbers."""
    _append_indexed(path, _records(df, schema), json.load, json.dump, str)


def write_indexed_yaml(df: DataFrame, path: str, schema: T.StructType) -> None:
    _append_indexed(path, _records(df, schema), yaml.safe_load, lambda x, f: yaml.safe_dump(x, f, sort_keys=False), int)


def wire_lines(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(value): the printed bytes of each record's message, in df's own order, made side by side."""
    on_workers(df.sparkSession)
    names = [f.name for f in schema if f.name in df.columns]
    packed = df.select(F.struct(*names).alias("m"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = x.column(0).to_pylist(maps_as_pydicts="strict")
            yield pa.RecordBatch.from_arrays([pa.array([repr(encode({k: v for k, v in r.items() if v is not None}, schema)) for r in rows], pa.string())], ["value"])

    return packed.mapInArrow(lines, "value string")


def write_wire(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Add the printed bytes of each record's message, a line each."""
    with open(path, "a", encoding="utf-8") as f:
        for record in _records(df, schema):
            f.write(repr(encode(record, schema)) + "\n")


WRITERS = {"json": write_indexed_json, "yaml": write_indexed_yaml, "wire": write_wire}


def convert(spark: SparkSession, path: str, kind: str, component: Callable[[DataFrame], DataFrame] | None, out: str, out_kind: str, schema: T.StructType = LOG, out_schema: T.StructType | None = None) -> DataFrame:
    """Any source through a component to any sink: log, wire, json or yaml to wire, json, yaml or parquet. What the
    component doesn't return is filtered out."""
    read = read_any(spark, path, kind, schema)
    return sink(component(read) if component else read, out, out_kind, out_schema or schema)


def sink(df: DataFrame, out: str, out_kind: str, schema: T.StructType) -> DataFrame:
    if out_kind == "parquet":
        write_parquet(df, out)
    else:
        WRITERS[out_kind](df, out, schema)
    return df
