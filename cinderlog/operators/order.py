"""Order of records: ordinals, phases and count windows, none of which gathers a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderlog.runtime import durable

#: Places of a block that one task puts in order.
BLOCK = 1 << 14


def with_ordinal(df: DataFrame, *order: str, ordinal: str = "ord", start: int = 0) -> DataFrame:
    """df with a number from start on, without gaps, in the order of the given columns, which must be total.

    Rows are range-partitioned; each range is numbered by itself and shifted by the sizes of the ranges before it, which are
    one row a range.
    """
    parts = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordinal")
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(F.col("_part").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = parts.withColumn("_row", inner).join(F.broadcast(shift), F.col("_part") == F.col("_at"))
    return numbered.withColumn(ordinal, (F.col("_shift") + F.col("_row") - 1 + start).cast("long")).drop("_part", "_row", "_at", "_shift")


def phase(unit: Column, configure: int | None, train: int | None) -> Column:
    """What a unit of input is for: the first `configure` units configure, the next `train` train, the rest is detected.

    None stands for a phase that doesn't take place.
    """
    c, t = configure or 0, train or 0
    return F.when(unit < c, "configure").when(unit < c + t, "train").otherwise("detect")


def tumbling(df: DataFrame, size: int, *, flush: bool = False, by: tuple[str, ...] = (), ordinal: str = "ord") -> DataFrame:
    """(by, window, first_ord, last_ord, records): `size` records in a row each; flush: with what is left at the end."""
    if size < 1:
        raise ValueError("size: 1 at least")
    row = F.struct(*[c for c in (ordinal, *df.columns) if c not in by and c != ordinal] or [ordinal])
    row = F.struct(F.col(ordinal).alias("_ord"), row.alias("_row"))
    out = df.groupBy(*by, F.floor(F.col(ordinal) / size).alias("window")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return _opened(out if flush else out.where(F.size("_rows") == size), by)


def sliding(df: DataFrame, size: int, *columns: str, by: tuple[str, ...] = (), ordinal: str = "ord", block: int = BLOCK) -> DataFrame:
    """(by, window, first_ord, last_ord, records): every `size` records in a row, numbered by the last one's place less
    size - 1. records: the columns, as structs, in order. Windows that lack a place are left out.

    Places are cut into blocks, `block` records each at most to a task (or 16 windows' records, if those are more). A record
    goes to its own block, and the last size - 1 of a block to the next one too, so that little more than the table is moved.
    """
    if size < 1:
        raise ValueError("size: 1 at least")
    columns = columns or tuple(c for c in df.columns if c not in (*by, ordinal))
    block = max(block, 16 * size)
    own, place = F.floor(F.col(ordinal) / block), F.pmod(F.col(ordinal), F.lit(block))
    rows = df.select(*by, F.col(ordinal).alias("_ord"), F.struct(*columns).alias("_row"), own.alias("_own"), F.when(place > block - size, F.array(own, own + 1)).otherwise(F.array(own)).alias("_blocks"))
    rows = rows.select(*by, "_ord", "_row", "_own", F.explode("_blocks").alias("_block"))
    line = Window.partitionBy(*by, "_block").orderBy("_ord").rowsBetween(1 - size, 0)
    full = rows.withColumns({"_rows": F.collect_list("_row").over(line), "_first": F.min("_ord").over(line)})
    full = full.where((F.col("_own") == F.col("_block")) & (F.size("_rows") == size) & (F.col("_first") == F.col("_ord") - (size - 1)))
    return full.select(*by, F.col("_first").alias("window"), F.col("_first").alias("first_ord"), F.col("_ord").alias("last_ord"), F.col("_rows").alias("records"))


def _opened(out: DataFrame, by: tuple[str, ...]) -> DataFrame:
    ords = F.transform("_rows", lambda r: r["_ord"])
    return out.select(*by, "window", F.array_min(ords).alias("first_ord"), F.array_max(ords).alias("last_ord"), F.transform("_rows", lambda r: r["_row"]).alias("records"))


def runs(df: DataFrame, value: str, *by: str, ordinal: str = "ord", block: int = BLOCK) -> DataFrame:
    """(by, value, start, n): run lengths of equal values in a row.

    Places are cut into blocks; in each, runs are told by themselves, `block` records at most to a task. A block's first run
    goes on from an earlier block if that ended in the same value: this is seen on one row a block."""
    rows = df.select(*by, F.col(ordinal).alias("_ord"), F.col(value).alias("_value"), F.floor(F.col(ordinal) / block).alias("_block"))
    line = Window.partitionBy(*by, "_block").orderBy("_ord")
    same = F.col("_value").eqNullSafe(F.lag("_value").over(line)) & F.lag(F.lit(1)).over(line).isNotNull()
    marked = rows.withColumn("_run", F.sum((~same).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    parts = durable(marked.groupBy(*by, "_block", "_run").agg(F.first("_value").alias("_value"), F.min("_ord").alias("_start"), F.count(F.lit(1)).alias("_n")), "runs")

    row = F.struct("_run", "_value", "_start")
    ends = parts.groupBy(*by, "_block").agg(F.min(row).alias("_head"), F.max(row).alias("_tail"))
    before = Window.partitionBy(*by).orderBy("_block")
    prior = F.lag(F.struct(F.col("_tail._value").alias("v"))).over(before)
    goes_on = prior.isNotNull() & prior["v"].eqNullSafe(F.col("_head._value"))
    # Where the last run of a block began, unless it is a run from before the block.
    begun = F.when(~F.col("_on") | (F.col("_tail._run") > 1), F.col("_tail._start"))
    ends = ends.withColumn("_on", goes_on).withColumn("_begun", begun)
    ends = ends.withColumn("_from", F.last("_begun", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.where("_on").select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_block").alias("_b"), "_from")
    on = F.col("_block") == F.col("_b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = parts.join(ends, on & (F.col("_run") == 1), "left").withColumn("_start", F.coalesce("_from", "_start"))
    return joined.groupBy(*by, "_start").agg(F.first("_value").alias(value), F.sum("_n").alias("n")).select(*by, value, F.col("_start").alias("start"), "n")
