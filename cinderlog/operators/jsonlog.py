"""JSON logs: nested objects to flat string maps, with the time and the message taken out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.timestamps import to_seconds
from cinderlog.operators.templates import Templates, with_match
from cinderlog.runtime import on_workers


Path = tuple[str | int, ...]


def members(value: Any) -> list[tuple[str | int, Any]]:
    """What an object or a list holds, by key or place; nothing for all else."""
    if isinstance(value, dict):
        return list(value.items())
    return list(enumerate(value)) if isinstance(value, list) else []


def leaves(value: Any, path: Path = (), without: frozenset[Path] = frozenset()) -> Iterator[tuple[Path, Any]]:
    """(path, leaf) of all that is neither an object nor a list, in document order, but for what stands at the paths left out.
    Empty objects and lists have no leaves."""
    if path in without:
        return
    if isinstance(value, dict | list):
        for step, inner in members(value):
            yield from leaves(inner, (*path, step), without)
    else:
        yield path, value


def named(value: Any, part: str, path: Path = (), without: frozenset[Path] = frozenset()) -> tuple[Path, Any] | None:
    """(path, what stands there) of the key that contains part, whatever the case. An object's own keys come first, then its
    members, of which the last are looked into first."""
    inner = [(step, v) for step, v in members(value) if (*path, step) not in without]
    if isinstance(value, dict):
        for step, v in inner:
            if part in str(step).lower():
                return (*path, step), v
    return next((hit for step, v in reversed(inner) if (hit := named(v, part, (*path, step), without))), None)


def read_object(text: str | None, time_name: str, content_name: str, sep: str = ".") -> dict[str, Any] | None:
    """time, content and the other leaves as flat fields; None for what isn't JSON, or is nested too deep to be read. Of fields
    that share a flat name the first in the document counts."""
    try:
        value = json.loads(text or "")
        gone: frozenset[Path] = frozenset()
        found = []
        for name in (time_name, content_name):
            hit = named(value, name.lower(), without=gone)
            found.append(None if hit is None else _text(hit[1]))
            gone |= set() if hit is None else {hit[0]}
        fields: dict[str, str] = {}
        for path, leaf in leaves(value, without=gone):
            fields.setdefault(sep.join(map(str, path)), str(leaf))
    except (ValueError, RecursionError):
        return None
    return {"time": found[0], "content": found[1], "fields": list(fields.items())}


def _text(x: Any) -> str | None:
    return x if isinstance(x, str) or x is None else str(x)


def _reader(time_name: str, content_name: str):
    kind = pa.struct([("time", pa.string()), ("content", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([read_object(text, time_name, content_name) for text in batch.to_pylist()], kind)

    # Not deterministic to the planner, which else runs it once to filter and once more to read.
    return F.arrow_udf("struct<time:string,content:string,fields:map<string,string>>")(read).asNondeterministic()


def parse_json(df: DataFrame, templates: Templates | None = None, *, log: str = "log", time_name: str = "time", content_name: str = "message", time_format: str | None = None) -> DataFrame:
    """df with logFormatVariables (the flat fields, and Time in seconds), EventID, template and variables.

    Without a message: template '' and EventID 0; a message that no template matches: as in template parsing. Rows that
    aren't JSON are dropped.
    """
    on_workers(df.sparkSession)
    read = df.withColumn("_json", _reader(time_name, content_name)(F.col(log))).where("_json is not null")
    time = F.create_map(F.lit("Time"), to_seconds(F.col("_json.time"), time_format).cast("string"))
    fields = F.map_concat(F.map_filter("_json.fields", lambda k, _: k != "Time"), time)
    has = F.coalesce(F.col("_json.content"), F.lit("")) != ""
    out = with_match(read.withColumn("logFormatVariables", fields), F.col("_json.content"), templates or Templates([]), "_found")
    pick = lambda name, unmatched, absent: F.when(has, F.coalesce(f"_found.{name}", unmatched)).otherwise(absent)
    none = F.array().cast("array<string>")
    return out.withColumns({"EventID": pick("EventID", F.lit(-1), F.lit(0)), "template": pick("template", F.lit("<Not Found>"), F.lit("")), "variables": pick("variables", none, none)}).drop("_json", "_found")
