"""A bounded number of rows out of a table of any size, without each task sending that many (as a sort with a limit has it)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cinderlog.runtime import durable


def frequent_and_rest(counts: DataFrame, n: str, most: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the highest counts n (1 at least), `most` at most, and all others; None if there are no others. The first
    are all whose count is in the highest eighths of powers of two that together hold no more. One row for each eighth reaches
    the driver."""
    total = durable(counts.withColumn("level", F.floor(F.log2(n) * 8).cast("int")), name)
    held, least, rest = 0, None, False
    for r in sorted(total.groupBy("level").count().collect(), reverse=True):
        if (held := held + r["count"]) > most:
            rest = True
            break
        least = r.level
    high = F.lit(False) if least is None else F.col("level") >= least
    return total.where(high).drop("level"), total.where(~high).drop("level") if rest else None


def frequent(counts: DataFrame, n: str, most: int, name: str) -> list[Row]:
    """The first of `frequent_and_rest`, on the driver, in no order."""
    return frequent_and_rest(counts, n, most, name)[0].collect()


def few(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The different rows of df with the least hashes of their keys, `most` at most.

    A bound on the hash lets through a little more than `most` rows of all, which are then sorted; where rows repeat, those
    that it lets through may be fewer than `most`."""
    n, own = df.count(), F.xxhash64(*keys)
    share = (most + 8 * math.sqrt(most) + 100) / max(n, 1)
    some = df if share >= 1 else df.where(own < F.lit(int(share * 2.0**64) - 2**63))
    return some.distinct().orderBy(own, *df.columns).limit(most)
