"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key (the MD5 of its id and a seed). Within a source documents stand in the order of their
keys; prefix sums of their sizes say where the source's budget ends. Keys are cut into 4096 ranges by their first three
hex digits, so that a source, however large, is sorted and summed in many tasks; only the ranges' sums are added up
serially (4096 rows a source). The budget is met exactly: whole passes over the source first, then its documents in key
order, of which the last may be taken in part.

Edge cases: null text has size 0; null sources are one source, last in order; a source of size 0 gets target 0; repeated
rows count each for itself; very long texts are counted whole; an empty table gives an empty table; other columns stay
(mixed_documents) or aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderlog.llm.names import fresh
from cinderlog.runtime import durable

#: The contract's characters of a word, weights in turn, share of all sizes, and times a source may be read.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(key: Column, seed: str) -> Column:
    return F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("-")))), 1, 16)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes: (sk, sn, source_size), one row a source. Adds target: share of all sizes dealt out by weight, at most cap
    times the source's size, the excess dealt to the others by weight. One row a source is all that this sorts."""
    turn = F.row_number().over(Window.orderBy("sn", "sk")) - 1
    weight = F.get(F.array(*map(F.lit, weights)), turn % len(weights)).cast("long")
    full = sizes.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    # The sources that reach their cap are the first in the order of most / w; `level` is what a weight of 1 gets if
    # just those before this one do.
    order = Window.orderBy(F.col("most") / F.col("w"), "sn", "sk")
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    spent = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.partitionBy()
    full = full.withColumn("rank", F.row_number().over(order)).withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - spent) / rest)
    fits = F.col("level") * F.col("w") <= F.col("most")
    first = F.min(F.when(fits, F.struct("rank", "level"))).over(every)
    full = full.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("most").cast("double")).otherwise(F.col("first.level") * F.col("w"))
    return full.select("sk", "sn", "source_size", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(key, source, size, source_size, target, taken) of every row: how many of its words the mix takes."""
    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), n_words(text).alias("size"), _hash(F.col(key), seed).alias("h"))
    units = durable(rows.groupBy("k", "source", "size", "h").agg(F.count(F.lit(1)).alias("n")), "mix")
    units = units.withColumns({"sk": F.coalesce("source", F.lit("")), "sn": F.col("source").isNull(), "b": F.substring("h", 1, 3)})

    cells = units.groupBy("sk", "sn", "b").agg(F.sum(F.col("size") * F.col("n")).alias("cell"))
    before = Window.partitionBy("sk", "sn").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.groupBy("sk", "sn").agg(F.sum("cell").alias("source_size"))
    cells = cells.withColumn("from", F.coalesce(F.sum("cell").over(before), F.lit(0))).join(targets(sizes, weights, share, cap), ["sk", "sn"])

    inner = Window.partitionBy("sk", "sn", "b").orderBy("h", F.col("k").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inner), F.lit(0))).join(cells, ["sk", "sn", "b"])
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")
    each = placed.select("k", "source", "size", "source_size", "target", (F.col("from") + F.col("at")).alias("at"), copies)
    budget = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - passes * F.col("source_size") - F.col("at") - F.col("i") * F.col("size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return each.select(F.col("k").alias(key), F.col("source").alias(source), "size", "source_size", "target", taken.cast("long").alias("taken"))


#: The same over a table `documents`, for DuckDB.
ORACLE_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size,
    substr(md5('mix' || coalesce(cast(doc_id as varchar), '-')), 1, 16) h
  from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3]::bigint w, 2 * source_size most from s),
o as (
  select *, row_number() over (order by most / w, source nulls last) rnk,
    (sum(source_size) over () * 1.5::double
      - coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
      / (sum(w) over (order by most / w, source nulls last rows between current row and unbounded following))::double lvl
  from w),
f as (select min(rnk) r, min_by(lvl, rnk) lvl from o where lvl * w <= most),
t as (select source, source_size, case when r is null or rnk < r then most::double else f.lvl * w end target from o, f),
p as (
  select d.*, t.source_size, t.target, floor(t.target + 0.5)::bigint budget,
    (sum(size) over (partition by d.source order by h, doc_id nulls last, size rows unbounded preceding) - size)::bigint pos
  from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end passes from p)
select doc_id, size, source_size, target,
  (passes * size + greatest(0, least(size, budget - passes * source_size - pos)))::bigint taken
from e
"""


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The rows of docs as often as the mix reads them, in whole documents.

    The document at a source's cut is read if the mix takes half of it or more. Texts aren't moved: a row's key is held
    against its source's cut, one row a source. Rows that repeat a key stay or go together.
    """
    columns = docs.columns
    full = mix(docs, key, source, text, seed, weights, share, cap).select(F.col(key).alias("k"), F.col(source).alias("source"), "size", "source_size", "target", "taken")
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor(F.col("target") + 0.5) / F.col("source_size"))).otherwise(F.lit(0))
    more = (F.col("size") > 0) & ((F.col("taken") - passes * F.col("size")) * 2 >= F.col("size"))
    place = lambda k: F.struct(_hash(k, seed).alias("h"), k.isNull().alias("n"), k.alias("k"))
    own, times, last, many, copy = fresh(docs, "own", "times", "last", "many", "copy")
    cuts = full.groupBy(F.col("source").alias(own)).agg(F.max(passes).cast("int").alias(times), F.max(F.when(more, place(F.col("k")))).alias(last))
    copies = F.col(times) + F.coalesce((place(F.col(key)) <= F.col(last)).cast("int"), F.lit(0))
    rows = docs.join(durable(cuts, "cuts"), F.col(source).eqNullSafe(F.col(own))).withColumn(many, copies).where(F.col(many) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*columns)
