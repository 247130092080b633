"""Which variables settle down: change flags over a series, their means in four segments, and the class they give.

A series is one variable of one event in the order of its records. Its flags say where it changed what is known of it; the
means of the flags in four segments, of equal counts or of equal durations, are held against thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderlog.functions.text import as_number, characters
from cinderlog.plans.config import Watched, watched_variables
from cinderlog.runtime import durable

#: A segment's mean has to be below its threshold; series shorter than LEAST tell nothing.
THRESHOLDS, LEAST = (1.1, 0.3, 0.1, 0.01), 3
STATIC, RANDOM, STABLE, UNSTABLE, SHORT = "STATIC", "RANDOM", "STABLE", "UNSTABLE", "INSUFFICIENT_DATA"
SERIES = ("event", "name")


def value_changes(rows: DataFrame, *by: str, ordinal: str = "ord") -> DataFrame:
    """rows with `changed`: a value's first occurrence in its series; `kinds`: how many different values the series has.

    First occurrences are a partial aggregation, and are joined back by value and place, so a series of any length is spread
    over all tasks. A record has a variable once at most."""
    by = by or SERIES
    firsts = rows.groupBy(*by, "value").agg(F.min(ordinal).alias(ordinal)).withColumn("_first", F.lit(1))
    kinds = firsts.groupBy(*by).agg(F.count(F.lit(1)).alias("kinds"))
    marked = rows.join(firsts, [*by, "value", ordinal], "left").withColumn("changed", F.coalesce("_first", F.lit(0))).drop("_first")
    return marked.join(kinds, list(by))


def range_changes(rows: DataFrame, *by: str, ordinal: str = "ord", block: int = 1 << 16) -> DataFrame:
    """Changes of a numeric series: values outside the range so far. Other values are left out. kinds: 1 if the range is a
    point, else 2.

    Places are cut into blocks. The range before a block comes from the ranges of those before it, one row each, so that
    `block` records at most are ordered in a task."""
    by = by or SERIES
    numeric = rows.withColumns({"_x": as_number(F.col("value")), "_b": F.floor(F.col(ordinal) / block)}).where("_x is not null")
    series = Window.partitionBy(*by)
    earlier = series.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = numeric.groupBy(*by, "_b").agg(F.min("_x").alias("_l"), F.max("_x").alias("_h"))
    kinds = F.when(F.min("_l").over(series) == F.max("_h").over(series), 1).otherwise(2)
    cells = cells.select(*by, "_b", F.min("_l").over(earlier).alias("_low"), F.max("_h").over(earlier).alias("_high"), kinds.alias("kinds"))
    before = Window.partitionBy(*by, "_b").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.least("_low", F.min("_x").over(before)), F.greatest("_high", F.max("_x").over(before))
    changed = F.coalesce((F.col("_x") < low) | (F.col("_x") > high), F.lit(True))
    return numeric.join(cells, [*by, "_b"]).withColumn("changed", changed.cast("int")).drop("_x", "_b", "_low", "_high")


def charset_changes(rows: DataFrame, *by: str, ordinal: str = "ord") -> DataFrame:
    """Changes of a series' set of characters: records with a new one. kinds: how many characters it has."""
    by = by or SERIES
    chars = rows.select(*by, ordinal, F.explode_outer(F.array_distinct(characters(F.col("value")))).alias("c"))
    firsts = chars.where("c is not null").groupBy(*by, "c").agg(F.min(ordinal).alias(ordinal))
    new = firsts.groupBy(*by, ordinal).agg(F.count(F.lit(1)).alias("_new"))
    kinds = firsts.groupBy(*by).agg(F.count(F.lit(1)).alias("kinds"))
    marked = rows.join(new, [*by, ordinal], "left").withColumn("changed", F.col("_new").isNotNull().cast("int"))
    return marked.join(kinds, list(by), "left").withColumn("kinds", F.coalesce("kinds", F.lit(0))).drop("_new")


def count_cuts(flags: DataFrame, *by: str, ordinal: str = "ord", segments: int = len(THRESHOLDS), block: int = 1 << 16) -> DataFrame:
    """(by, c1, c2, ...): the place of the record that each segment after the first begins with, by equal counts.

    Places are cut into blocks; block sizes say in which block a cut is, and only those blocks are ranked, `block` records at
    most to a task."""
    cells = flags.groupBy(*by, F.floor(F.col(ordinal) / block).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    cells = cells.withColumns({"_from": F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"), "_n": F.sum("_c").over(w)})
    cuts = cells.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(segments - 1))))
    cuts = cuts.withColumn("_r", F.floor(F.col("_k") * F.col("_n") / segments) - F.col("_from")).where("_r >= 0 and _r < _c").select(*by, "_b", "_k", "_r")
    rows = flags.select(*by, ordinal, F.floor(F.col(ordinal) / block).alias("_b")).join(cuts, [*by, "_b"])
    place = F.row_number().over(Window.partitionBy(*by, "_b", "_k").orderBy(ordinal)) - 1
    found = rows.withColumn("_i", place).where("_i = _r")
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_k") == k, F.col(ordinal))).alias(f"c{k}") for k in range(1, segments)))


def time_spans(flags: DataFrame, *by: str, time: str, ordinal: str = "ord", block: int = 1 << 16) -> DataFrame:
    """(by, t0, t1, timed): the first and last stamp of each series, and whether its stamps are all there, finite, in order and
    not all the same.

    Places are cut into blocks; order is seen within each, `block` records at most to a task, and between blocks on one row
    each."""
    t = F.col(time).cast("double")
    fine = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    rows = flags.select(*by, F.col(ordinal).alias("_ord"), F.floor(F.col(ordinal) / block).alias("_b"), F.when(fine, t).alias("_t"))
    line = Window.partitionBy(*by, "_b").orderBy("_ord")
    rows = rows.withColumn("_bad", F.col("_t").isNull() | F.coalesce(F.col("_t") < F.lag("_t").over(line), F.lit(False)))
    cells = rows.groupBy(*by, "_b").agg(F.max("_bad").alias("_bad"), F.min("_t").alias("_low"), F.max("_t").alias("_high"), F.min(F.struct("_ord", "_t"))["_t"].alias("_head"), F.max(F.struct("_ord", "_t"))["_t"].alias("_tail"))
    back = F.coalesce(F.col("_head") < F.lag("_tail").over(Window.partitionBy(*by).orderBy("_b")), F.lit(False))
    cells = cells.withColumn("_bad", F.col("_bad") | back)
    spans = cells.groupBy(*by).agg(F.min("_low").alias("t0"), F.max("_high").alias("t1"), F.max("_bad").alias("_odd"))
    return spans.select(*by, "t0", "t1", (~F.col("_odd") & (F.col("t1") > F.col("t0"))).alias("timed"))


def _segments(flags: DataFrame, by: tuple[str, ...], modes: list[str], ordinal: str, time: str | None, segments: int) -> tuple[DataFrame, dict[str, Column]]:
    """Written flags with what each mode's segments are cut by, and each mode's segment of a record."""
    if odd := set(modes) - {"count", "time"}:
        raise ValueError(f"mode: {', '.join(sorted(odd))}")
    stamp = [F.col(time).alias("_t")] if "time" in modes else []
    out = durable(flags.select(*by, F.col(ordinal).alias("_ord"), "changed", "kinds", *stamp), "flags")
    cuts = count_cuts(out, *by, ordinal="_ord", segments=segments)
    if "time" in modes:
        cuts = cuts.join(time_spans(out, *by, time="_t", ordinal="_ord"), list(by))
    counted = F.greatest(F.lit(0), F.lit(0), *(F.when(F.col("_ord") >= F.col(f"c{k}"), k).otherwise(0) for k in range(1, segments)))
    found = {"count": counted}
    if "time" in modes:
        t = F.col("_t").cast("double")
        timed = F.greatest(*(F.when(t >= F.col("t0") + F.lit(k) * (F.col("t1") - F.col("t0")) / segments, k).otherwise(0) for k in range(segments)), F.lit(0))
        found["time"] = F.when(F.col("timed"), timed).otherwise(counted)
    return out.join(cuts, list(by)), found


def _mean(segment: str, k: int) -> Column:
    return F.coalesce(F.avg(F.when(F.col(segment) == k, F.col("changed"))), F.lit(0.0))


def segment_means(flags: DataFrame, *by: str, mode: str = "count", ordinal: str = "ord", time: str | None = None, segments: int = len(THRESHOLDS)) -> DataFrame:
    """(by, n, kinds, m0, m1, ...): a mean for each segment, 0 for an empty one.

    mode "time" cuts the series' time span into equal parts, and falls back to equal counts if stamps are missing, not
    finite or out of order, or all the same.
    """
    by = by or SERIES
    out, segment = _segments(flags, by, [mode], ordinal, time, segments)
    out = out.withColumn("_s", segment[mode])
    return out.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("kinds").alias("kinds"), *(_mean("_s", k).alias(f"m{k}") for k in range(segments)))


def classify(flags: DataFrame, *by: str, mode: str = "count", ordinal: str = "ord", time: str | None = None, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(by, n, kinds, class). mode "both" asks for stability by counts and by time, in one pass over the flags."""
    by = by or SERIES
    modes = ["count", "time"] if mode == "both" else [mode]
    out, segment = _segments(flags, by, modes, ordinal, time, len(thresholds))
    out = out.withColumns({f"_{m}": segment[m] for m in modes})
    means = [_mean(f"_{m}", k).alias(f"{m}{k}") for m in modes for k in range(len(thresholds))]
    out = out.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("kinds").alias("kinds"), *means)
    stable = F.expr(" and ".join(f"{m}{k} < {t}D" for m in modes for k, t in enumerate(thresholds)))
    kind = F.when(F.col("n") < LEAST, SHORT).when(F.col("kinds") == 1, STATIC).when(F.col("kinds") == F.col("n"), RANDOM).when(stable, STABLE).otherwise(UNSTABLE)
    return out.select(*by, "n", "kinds", kind.alias("class"))


def select_variables(classes: DataFrame, *, stable: bool = True, static: bool = True, instance: str = "auto", most: int = 100_000) -> list[Watched]:
    """The variables to watch: those whose class is wanted. One row a variable of a template, so a small list; more than
    `most` is an error rather than a surprise for the driver."""
    wanted = [c for c, on in ((STABLE, stable), (STATIC, static)) if on]
    chosen = durable(classes.where(F.col("class").isin(*wanted)).select("event", "name"), "chosen")
    if chosen.count() > most:
        raise ValueError(f"more than {most} variables: name the events to watch")
    return [w for r in sorted(chosen.collect()) for w in watched_variables([r.name], r.event, instance)]
