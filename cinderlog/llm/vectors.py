"""Exact top-k search by inner product, with a pivot-distance index.

Components x become floor(256 * x). A vector x of norm n goes to the point (x, sqrt(M - n^2)), M being the largest squared
norm, and a query q to (q, 0): then |q' - x'|^2 = |q|^2 + M - 2 q.x, so the highest scores are the nearest points. Each point
is keyed by its nearest pivot and its distance from it, cut into annuli (rings) around the pivot. Of each cell (pivot, ring)
the index has the count, the greatest norm, and the least and greatest distance to every pivot. By the triangle inequality
each pivot bounds how near a query a cell's points can be; the strictest of these bounds, and the product of the norms, bound
their scores. A query visits cells in the order of these bounds: first as many as hold FIRST points, which gives its k-th
best score so far, then those, and only those, whose bound reaches it. In a cell, points stand in the order of their distance
from the pivot, and a query reads only the annulus that its k-th best distance leaves. Scores are integers and exact; bounds
are widened by rounding errors' size.

The pivots and rings are fitted on at most SAMPLE vectors, in the order of a hash of their ids; every vector is indexed. The
driver holds the pivots and the cells' figures (PIVOTS ^ 2 x RINGS numbers). Small cells of one pivot share a unit of work; a
cell of more points than a unit is dealt to several, row by row, so that equal rows are spread too. The queries that visit a
unit are cut into blocks; no task holds more than a unit's points and a batch of queries.

How much the bounds save is up to the vectors: where these lie in clusters, most pairs are never scored; where they spread
evenly over many dimensions, all distances are alike, no bound by distances holds anything off, and every pair is scored, in
blocks. `stats` tells.

Edge cases: vectors that are null, or hold a null, NaN or infinity, take no part, nor do null ids; shorter vectors count as
filled up with zeros; an empty vector is all zeros; rows that repeat an id are candidates each, and one query (the least
vector); scores beyond 64 bits become the nearest number that fits; ids are whole numbers, ValueError for others. Columns
other than the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderlog.llm.bounded import few
from cinderlog.llm.names import need_whole
from cinderlog.llm.texthash import mix
from cinderlog.runtime import durable, on_workers

PIVOTS, RINGS, SAMPLE, FIRST = 64, 8, 8192, 512
#: Of a unit of work: points and their bytes, and queries of a block.
UNIT, UNIT_BYTES, BLOCK = 8192, 16 << 20, 8192
EXACT = 2.0**53
UNIT_SCHEMA = "unit int, sub int, block int, query boolean, id long, v binary, d double"


@dataclass
class Index:
    width: int  # components of a vector
    exact: bool  # whether inner products fit in doubles without rounding
    level: float  # M
    pivots: np.ndarray  # (pivots, width + 1)
    inner: np.ndarray  # (pivots, rings): where each ring begins
    unit: int  # most points of a unit
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each cell, in the order of pivots and rings
    norms: np.ndarray = field(default_factory=lambda: np.zeros(0))  # greatest norm of each cell
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # (cells, pivots): least distance
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # and greatest
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # first cell of each unit

    @property
    def slack(self) -> float:
        return 1e-6 * math.sqrt(self.level + 1)

    @property
    def sizes(self) -> np.ndarray:
        """Points of each unit."""
        return np.add.reduceat(self.counts, self.starts)

    @property
    def subs(self) -> np.ndarray:
        return np.maximum(1, -(-self.sizes // self.unit))

    def unit_of_cell(self) -> np.ndarray:
        return np.searchsorted(self.starts, np.arange(len(self.counts)), "right") - 1


def lift(v: np.ndarray, level: float) -> np.ndarray:
    return np.concatenate((v, np.sqrt(np.maximum(level - (v * v).sum(1), 0))[:, None]), 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width) if width else np.zeros((len(column), 0))


def whole(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, norm, width): the vectors that take part, in integers held as doubles."""

    def quantize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = x.column(1).cast(pa.list_(pa.float64()))
            at = rows.offsets.to_numpy()
            # Nulls become NaN here, and so count as what they are: no finite number.
            raw = rows.values.to_numpy(zero_copy_only=False)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(raw))))
            with np.errstate(all="ignore"):
                y = np.clip(np.floor(256 * np.where(np.isfinite(raw), raw, 0.0)), -1e150, 1e150)
            has = x.column(0).is_valid().to_numpy(zero_copy_only=False) & rows.is_valid().to_numpy(zero_copy_only=False)
            some = np.flatnonzero(has & (bad[at[1:]] == bad[at[:-1]]))
            vectors = [y[at[r] : at[r + 1]] for r in some]
            columns = [x.column(0).take(pa.array(some)), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([float(v @ v) for v in vectors], pa.float64()), pa.array(at[some + 1] - at[some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "norm", "width"])

    need_whole(df, key)
    on_workers(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")).mapInArrow(quantize, "id long, v binary, norm double, width long")


def fit(vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE, unit: int = UNIT) -> Index:
    """Pivots by a few rounds of k-means on the sample, rings of equal numbers of the sample's points."""
    level, width = vectors.agg(F.max("norm"), F.max("width")).first()
    level, width = level or 0.0, int(width or 0)
    rows = few(vectors.select("id", "v"), ["id"], sample).collect()
    points = lift(np.stack([np.frombuffer(r.v.ljust(8 * width, b"\0"), "<f8") for r in rows]) if rows else np.zeros((1, width)), level)
    centres = np.unique(points[:: max(1, len(points) // pivots)][:pivots], axis=0)
    for _ in range(8):
        near = distances(points, centres).argmin(1)
        centres = np.stack([points[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
    d = distances(points, centres)
    near = d.argmin(1)
    inner = np.zeros((len(centres), rings))
    for k in range(len(centres)):
        own = d[near == k, k]
        inner[k, 1:] = np.quantile(own, np.arange(1, rings) / rings) if len(own) else 0.0
    return Index(width, level < EXACT, level, centres, inner, max(1, min(unit, UNIT_BYTES // (8 * max(width, 1)))))


def keyed(vectors: DataFrame, index: Index) -> DataFrame:
    """(cell, n, id, v, d) of every vector: n numbers the rows of a task, d is the distance from the nearest pivot."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, at = shared.value, 0
        for x in batches:
            full = pa.array([b.ljust(8 * i.width, b"\0") for b in x.column(1).to_pylist()], pa.binary())
            d = distances(lift(_stack(full, i.width), i.level), i.pivots)
            pivot = d.argmin(1) if len(x) else np.zeros(0, np.int64)
            own = d[np.arange(len(x)), pivot]
            cell = pivot * i.inner.shape[1] + np.maximum((own[:, None] >= i.inner[pivot]).sum(1) - 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.arange(at, at + len(x))), x.column(0), full, pa.array(own)], ["cell", "n", "id", "v", "d"])
            at += len(x)

    return vectors.select("id", "v").mapInArrow(key, "cell int, n long, id long, v binary, d double")


def measured(index: Index, cells: DataFrame) -> Index:
    """The index with its cells' figures, of all vectors: each task gives one row a cell, which are combined before they are
    shuffled, and one row a cell reaches the driver."""
    shared, pivots = cells.sparkSession.sparkContext.broadcast(index), len(index.pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = shared.value
        many = i.inner.size
        count, norm = np.zeros(many, np.int64), np.zeros(many)
        low, high = np.full((many, pivots), np.inf), np.full((many, pivots), -np.inf)
        for x in batches:
            cell, v = x.column(0).to_numpy(), _stack(x.column(1), i.width)
            d = distances(lift(v, i.level), i.pivots)
            count += np.bincount(cell, minlength=many)
            np.maximum.at(norm, cell, np.sqrt((v * v).sum(1)))
            np.minimum.at(low, cell, d)
            np.maximum.at(high, cell, d)
        some = np.flatnonzero(count)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(m[some].ravel()), pivots).cast(pa.list_(pa.float64())) for m in (low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(norm[some]), *lists], ["cell", "n", "norm", "low", "high"])

    rows = cells.select("cell", "v").mapInArrow(measure, "cell int, n long, norm double, low array<double>, high array<double>")
    of = lambda f, name: F.array(*(f(F.get(name, F.lit(p))) for p in range(pivots))).alias(name)
    many = index.inner.size
    index.counts, index.norms = np.zeros(many, np.int64), np.zeros(many)
    index.low, index.high = np.full((many, pivots), np.inf), np.full((many, pivots), -np.inf)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"), of(F.min, "low"), of(F.max, "high")).collect():
        index.counts[r.cell], index.norms[r.cell], index.low[r.cell], index.high[r.cell] = r.n, r.norm, r.low, r.high
    # Rings of one pivot share a unit as long as their points fit in it.
    starts, held = [], 0
    for c in range(many):
        if c % index.inner.shape[1] == 0 or held + index.counts[c] > index.unit:
            starts.append(c)
            held = 0
        held += index.counts[c]
    index.starts = np.array(starts, np.int64)
    return index


def _bounds(index: Index, q: np.ndarray) -> np.ndarray:
    """(queries, cells): a score that no point of the cell exceeds; -inf for empty cells."""
    d = distances(np.concatenate((q, np.zeros((len(q), 1))), 1), index.pivots)
    near = np.zeros((len(q), len(index.counts)))
    for p in range(len(index.pivots)):
        np.maximum(near, d[:, p, None] - index.high[None, :, p], out=near)
        np.maximum(near, index.low[None, :, p] - d[:, p, None], out=near)
    square = (q * q).sum(1)[:, None]
    near = np.where(np.isfinite(near), np.maximum(near - index.slack, 0), 0)
    best = np.minimum((square + index.level - near * near) / 2, np.sqrt(square) * index.norms) + 1e-9 * (square + index.level + 1)
    best[:, index.counts == 0] = -np.inf
    return best


def chosen(index: Index, q: np.ndarray, first: int, kth: np.ndarray | None) -> np.ndarray:
    """(queries, units): whether a query visits a unit: one of the cells with the best bounds, up to `first` points, or, with
    kth (each query's k-th best score so far), one of the others whose bound reaches that."""
    best = _bounds(index, q)
    order = np.argsort(-best, 1, kind="stable")
    held = np.cumsum(index.counts[order], 1) - index.counts[order]
    early = np.zeros(best.shape, bool)
    np.put_along_axis(early, order, held < first, 1)
    early = np.logical_or.reduceat(early & np.isfinite(best), index.starts, 1)
    if kth is None:
        return early
    return ~early & np.logical_or.reduceat(np.isfinite(best) & (best >= kth[:, None]), index.starts, 1)


def _kth(column: pa.Array) -> np.ndarray:
    """Scores as doubles; -inf for none, and for the least number, which may stand for any below."""
    kth = column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    return np.where(np.isnan(kth) | (kth <= -(2.0**63)), -np.inf, kth)


def _batches(x: pa.RecordBatch, width: int, size: int = 256):
    for at in range(0, len(x), size):
        part = x.slice(at, size)
        yield part, _stack(part.column(1), width)


def visit_counts(queries: DataFrame, shared, first: int, second: bool) -> np.ndarray:
    """How many queries visit each unit."""
    units = len(shared.value.starts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, n = shared.value, np.zeros(units, np.int64)
        for x in batches:
            for part, q in _batches(x, i.width):
                n += chosen(i, q, first, _kth(part.column(2)) if second else None).sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["unit", "n"])

    out = np.zeros(units, np.int64)
    for r in queries.select("id", "v", "kth").mapInArrow(count, "unit int, n long").groupBy("unit").agg(F.sum("n").alias("n")).collect():
        out[r.unit] = r.n
    return out


def visits(queries: DataFrame, shared, first: int, second: bool, blocks: np.ndarray) -> DataFrame:
    """Each query once for each part of a unit that it visits, with the distance beyond which nothing concerns it."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = shared.value
        subs = i.subs
        for x in batches:
            for part, q in _batches(x, i.width):
                kth = _kth(part.column(2)) if second else np.full(len(q), -np.inf)
                far = np.sqrt(np.maximum((q * q).sum(1) + i.level - 2 * kth, 0)) + i.slack
                row, unit = np.nonzero(chosen(i, q, first, kth if second else None))
                block = mix(part.column(0).to_numpy().astype(np.uint64))[row] % blocks[unit].astype(np.uint64)
                n = subs[unit]
                row, unit, block = np.repeat(row, n), np.repeat(unit, n), np.repeat(block, n)
                sub = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                columns = [pa.array(unit.astype(np.int32)), pa.array(sub.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.ones(len(row), bool)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(far[row])]
                yield pa.RecordBatch.from_arrays(columns, ["unit", "sub", "block", "query", "id", "v", "d"])

    return queries.select("id", "v", "kth").mapInArrow(route, UNIT_SCHEMA)


def scores(q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (q @ v.T).astype(np.int64)
    whole_ = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
    return np.clip(whole_(q) @ whole_(v).T, -(2**63), 2**63 - 1).astype(np.int64)


def _scan(shared, k: int):
    def best(unit: int, data: list[pa.RecordBatch], asked: pa.RecordBatch) -> pa.RecordBatch:
        i = shared.value
        t = pa.Table.from_batches(data)
        ids, v, d = t.column("id").to_numpy(), _stack(t.column("v").combine_chunks(), i.width), t.column("d").to_numpy()
        order = np.lexsort((ids, d))
        ids, v, d = ids[order], v[order], d[order]
        q, own, far = _stack(asked.column("v"), i.width), asked.column("id").to_numpy(), asked.column("d").to_numpy()
        from_pivot = distances(np.concatenate((q, np.zeros((len(q), 1))), 1), i.pivots[i.starts[unit] // i.inner.shape[1]][None])[:, 0]
        # Scores below a query's k-th best so far, less what rounding may have moved it, needn't leave the task.
        least = ((q * q).sum(1) + i.level - far * far) / 2 - 1
        found: list[list] = [[], [], []]
        # Queries of like distance from the pivot read one slice of the points.
        for some in np.array_split(np.argsort(from_pivot, kind="stable"), -(-len(own) // 128)):
            lo = np.searchsorted(d, (from_pivot[some] - far[some]).min() - i.slack)
            hi = np.searchsorted(d, (from_pivot[some] + far[some]).max() + i.slack, "right")
            for r, row in zip(some, scores(q[some], v[lo:hi], i.exact), strict=True):
                here = np.flatnonzero((ids[lo:hi] != own[r]) & (row >= least[r]))
                if len(here) > k:
                    kth = np.partition(row[here], len(here) - k)[len(here) - k]
                    here = here[row[here] >= kth]
                here = here[np.lexsort((ids[lo:hi][here], ~row[here]))][:k]
                found[0] += [own[r]] * len(here)
                found[1] += ids[lo:hi][here].tolist()
                found[2] += row[here].tolist()
        return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["query_id", "vec_id", "score"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit, each unit's points before its queries."""
        data, now = [], None
        for x in batches:
            key = np.stack([x.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("unit", "sub", "block", "query")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(x)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if tuple(key[lo][:3]) != now:
                    data, now = [], tuple(key[lo][:3])
                part = x.slice(lo, hi - lo)
                if not key[lo][3]:
                    data.append(part)
                elif data:
                    yield best(int(key[lo][0]), data, part)

    return scan


def _lookup(values: np.ndarray, at: Column) -> Column:
    """A number for each of the index's cells or units: a table of a fixed size."""
    return F.get(F.array(*(F.lit(int(x)) for x in values)), at)


def search(df: DataFrame, asked: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", index: Index | None = None, first: int = FIRST, block: int = BLOCK, stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector of asked, the k of df, but for those of its own id, with the
    highest scores, ties to the smaller id; fewer if df has fewer.

    stats: gets `pairs`, of queries and vectors, and `met`, those that meet in a unit, at most which are scored."""
    spark = df.sparkSession
    points = durable(whole(df, key, vector), "vectors")
    index = index or fit(points)
    cells = durable(keyed(points, index), "cells")
    index = measured(index, cells)
    unit = _lookup(index.unit_of_cell(), F.col("cell")).cast("int")
    data = cells.select(unit.alias("unit"), "n", "id", "v", "d")
    queries = whole(asked, key, vector).groupBy("id").agg(F.min(F.struct("v", "norm")).alias("q")).select("id", "q.*")
    queries = durable(queries.select("id", F.unhex(F.rpad(F.hex("v"), 16 * index.width, "0")).alias("v"), "norm", F.lit(None).cast("long").alias("kth")), "queries")
    many, most = queries.agg(F.count(F.lit(1)), F.max("norm")).first()
    index.exact = max(index.level, most or 0.0) < EXACT
    shared = spark.sparkContext.broadcast(index)
    if stats is not None:
        stats |= {"pairs": many * int(index.counts.sum()), "met": 0}

    def scanned(some: DataFrame, second: bool, name: str) -> DataFrame:
        count = visit_counts(some, shared, first, second)
        if stats is not None:
            stats["met"] += int(count @ index.sizes)
        blocks = -(-count // block)
        sub = F.pmod(F.col("n"), _lookup(index.subs, F.col("unit"))).cast("int").alias("sub")
        copies = F.explode(F.sequence(F.lit(0), _lookup(blocks, F.col("unit")).cast("int") - 1)).alias("block")
        visited = data.where(_lookup(blocks, F.col("unit")) > 0).select("unit", sub, copies, F.lit(False).alias("query"), "id", "v", "d")
        part = ["unit", "sub", "block"]
        units = visited.union(visits(some, shared, first, second, np.maximum(blocks, 1))).repartition(*part).sortWithinPartitions(*part, "query")
        return durable(units.mapInArrow(_scan(shared, k), "query_id long, vec_id long, score long"), name)

    early = scanned(queries, False, "early")
    kth = ranked(early, k).where(F.col("rank") == k).select(F.col("query_id").alias("kq"), F.col("score").alias("s"))
    late = scanned(queries.join(kth, F.col("id") == F.col("kq"), "left").select("id", "v", F.col("s").alias("kth")), True, "late")
    return ranked(early.union(late), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
