"""Column names that a table doesn't have, for what an operator adds on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df is called so, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def need_whole(df: DataFrame, key: str) -> None:
    """ValueError unless the key is a column of whole numbers (of a column without values, any type will do)."""
    kind = df.select(key).schema[0].dataType
    if not isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.NullType):
        raise ValueError(f"{key}: whole numbers are needed, not {kind.simpleString()}")
