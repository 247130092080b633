"""The four message schemas as StructTypes, and what can be asked of a message: its version, presence, equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "1.0.0"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("__version__", T.StringType()), *(T.StructField(k, v) for k, v in fields.items())])


_S, _I, _L, _F = T.StringType(), T.IntegerType(), T.LongType(), T.FloatType()
_LIST, _LONGS, _MAP = T.ArrayType(_S), T.ArrayType(_L), T.MapType(_S, _S)

SCHEMA = _struct()
LOG = _struct(logID=_S, log=_S, logSource=_S, hostname=_S)
PARSED = _struct(parserType=_S, parserID=_S, EventID=_I, template=_S, variables=_LIST, parsedLogID=_S, logID=_S, log=_S, logFormatVariables=_MAP, receivedTimestamp=_L, parsedTimestamp=_L)
ALERT = _struct(detectorID=_S, detectorType=_S, alertID=_S, detectionTimestamp=_L, logIDs=_LIST, score=_F, extractedTimestamps=_LONGS, description=_S, receivedTimestamp=_L, alertsObtain=_MAP)
AGGREGATE = _struct(detectorIDs=_LIST, detectorTypes=_LIST, alertIDs=_LIST, outputTimestamp=_L, logIDs=_LIST, extractedTimestamps=_LONGS, description=_S, alertsObtain=_MAP)
SCHEMAS = {"schema": SCHEMA, "log": LOG, "parsed": PARSED, "alert": ALERT, "aggregate": AGGREGATE}


class FieldNotFound(KeyError):
    """A message has no field of that name."""


def field(schema: T.StructType, name: str) -> T.StructField:
    if name not in schema.fieldNames():
        raise FieldNotFound(name)
    return schema[name]


def conform(df: DataFrame, schema: T.StructType, *keep: str) -> DataFrame:
    """df's columns cast to the schema, the version set, fields that df lacks null (not present); keep: others that stay."""
    given = set(df.columns)
    as_given = lambda f: F.col(f.name).cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType)
    fields = [F.lit(VERSION).alias(f.name) if f.name == "__version__" else as_given(f).alias(f.name) for f in schema]
    return df.select(*keep, *fields)


def is_repeated(schema: T.StructType, name: str) -> bool:
    return isinstance(field(schema, name).dataType, T.ArrayType | T.MapType)


def is_complete(schema: T.StructType) -> Column:
    """Whether every field that isn't repeated is present; 0 and '' are."""
    out = F.lit(True)
    for f in schema:
        if not is_repeated(schema, f.name):
            out = out & F.col(f.name).isNotNull()
    return out


def read_field(schema: T.StructType, name: str) -> Column:
    """A field as a reader sees it: what is not present reads as '' or 0."""
    kind = field(schema, name).dataType
    if is_repeated(schema, name):
        return F.coalesce(F.col(name), (F.create_map() if isinstance(kind, T.MapType) else F.array()).cast(kind))
    return F.coalesce(F.col(name), F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind))


def same_kind(a: DataFrame, b: DataFrame) -> bool:
    plain = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
    return plain(a.schema) == plain(b.schema)


def equal_messages(a: str, b: str, schema: T.StructType) -> Column:
    """Whether the structs in columns a and b are equal messages, maps compared by their entries."""
    out = F.lit(True)
    for f in schema:
        x, y = F.col(f"{a}.`{f.name}`"), F.col(f"{b}.`{f.name}`")
        if isinstance(f.dataType, T.MapType):
            x, y = (F.array_sort(F.map_entries(z)) for z in (x, y))
        out = out & x.eqNullSafe(y)
    return out


def to_json_message(schema: T.StructType) -> Column:
    return F.to_json(F.struct(*schema.fieldNames()))


def from_json_message(text: Column, schema: T.StructType) -> Column:
    return F.from_json(text, schema)
