"""Sharding by rendezvous hashing over weighted shards, and gapless places within each shard.

A record goes to the shard whose score for its key is the highest. Scores come from a hash of key and shard number, so a
row's shard depends on its key, the weights and nothing else: one more shard takes rows into itself and moves no others.

Edge cases: null keys count as one key of their own; repeated keys share a shard, and repeated rows get places of their
own; an empty table gives an empty table; columns of other names stay, equal names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderlog.llm.names import fresh
from cinderlog.runtime import durable

#: Buckets of a shard in which places are counted side by side.
BUCKETS = 256


def _score(key: Column, shard: Column, weight: Column | None) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) * 2.0**-53
    return u if weight is None else -weight / F.ln(u)


def shard_of(key: Column, weights: list[float], equal: bool) -> Column:
    """Struct (score, shard) of the best of len(weights) shards; equal: their weights are, which saves a logarithm."""
    table = None if equal else F.array(*map(F.lit, map(float, weights)))

    def scored(s: Column) -> Column:
        return F.struct(_score(key, s, None if equal else F.get(table, s)).alias("score"), s.alias("shard"))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), scored))


def with_shards(df: DataFrame, key: str, weights: list[float], shard: str = "shard", grown: str | None = "grown_shard", more: float | None = None) -> DataFrame:
    """Add each row's shard and, as grown, its shard if there were one more (of weight `more`; the first's by default).

    weights: one number above 0 for each shard, else ValueError.
    """
    more = weights[0] if more is None and weights else more
    if not weights or min(*weights, more) <= 0:
        raise ValueError("weights: one number above 0 for each shard")
    equal = len({*weights, more}) == 1
    best, extra = fresh(df, "best", "extra")
    out = df.withColumn(best, shard_of(F.col(key), weights, equal)).withColumn(extra, _score(F.col(key), F.lit(len(weights)), None if equal else F.lit(float(more))))
    made = {shard: F.col(f"{best}.shard").cast("int")}
    if grown:
        made[grown] = F.when(F.col(extra) > F.col(f"{best}.score"), len(weights)).otherwise(F.col(f"{best}.shard")).cast("int")
    return out.withColumns(made).drop(best, extra)


def with_slots(df: DataFrame, shard: str = "shard", slot: str = "slot", buckets: int = BUCKETS) -> DataFrame:
    """Add a gapless number from 0 within each shard.

    df: narrow columns only; they alone decide the order. Equal rows are first counted, then numbered in turn, so a row
    that repeats without end doesn't gather in one task. Each shard is counted in `buckets` hash buckets side by side; only
    their counts (shards x buckets rows, however large the table) are added up and broadcast.
    """
    names = [c for c in df.columns if c.lower() != slot.lower()]
    n, b, cell, s, c, start, at, i = fresh(df, "n", "b", "cell", "s", "c", "start", "at", "i")
    units = df.groupBy(*names).agg(F.count(F.lit(1)).alias(n)).withColumn(b, F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    units = durable(units, "slots")
    before = Window.partitionBy(shard).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    cells = units.groupBy(shard, b).agg(F.sum(n).alias(cell))
    cells = cells.select(F.col(shard).alias(s), F.col(b).alias(c), F.coalesce(F.sum(cell).over(before), F.lit(0)).alias(start))
    inner = Window.partitionBy(shard, b).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn(at, F.coalesce(F.sum(n).over(inner), F.lit(0)))
    placed = placed.join(F.broadcast(cells), F.col(shard).eqNullSafe(F.col(s)) & (F.col(b) == F.col(c)))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(i)
    return placed.select(*names, start, at, copies).select(*names, (F.col(start) + F.col(at) + F.col(i)).cast("long").alias(slot))
