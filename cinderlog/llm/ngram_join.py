"""Similarity self-join of documents on their sets of word n-grams (Jaccard likeness), by MinHash banding.

Bands and rows a band are chosen for a target recall at the threshold. Documents with equal n-gram sets are one class; one
row a class goes on. Classes are shuffled on their band hashes; buckets with one class, or with the same classes as an
earlier band's bucket, go. What remains is verified on full n-gram sets, each pair in the first band that its two
signatures share. A large bucket is cut into blocks by a hash and every pair of blocks is a unit of its own, so that no
task holds more than two blocks; a unit returns one row a class (its number of links, and one class of its connected part),
never pairs. A class's copies count towards links but aren't compared.

Edge cases: a text with fewer than n words has one n-gram, all of its words; texts without words (null, empty) form one
class and have no links outside it; rows of the same key and text are two documents; null keys are allowed, and a group's
class_id is its least key that isn't null, if it has any. Words are runs of bytes other than space and \\t to \\r, as they
stand. Keys are whole numbers, ValueError for others; very long texts are compared whole; columns of other names, whatever
they are, stay (one_of_each) or aren't read.

A group of m different near copies in one bucket costs m * m / 2 comparisons, for the number of links asks for every pair, and
m / BLOCK_ROWS copies of each text on their way to them. Pairs whose n-gram sets differ too much in size to reach the
threshold are told by their sizes alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.names import fresh, need_whole
from cinderlog.llm.texthash import U, buffers, mix, portions, shingle_hashes
from cinderlog.runtime import durable, on_workers

THRESHOLD, WORDS, RECALL, MOST_HASHES = 0.8, 5, 0.999, 128
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
LOWEST = -(2**63)


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows a band): the most rows, so the fewest false candidates, with which a pair at the threshold shares a
    band with probability recall at least, from `most` hashes at most; ValueError if there are none."""
    for rows in range(most, 0, -1):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach that recall")


def _signatures(n: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(8)
        factor, shift = (rng.integers(0, 2**64, bands * rows, U) for _ in range(2))
        factor |= U(1)
        for x in batches:
            at = 0
            for part in portions(x.column(2)):
                h, count = shingle_hashes(part, n)
                ends = np.cumsum(count)
                digest = [hashlib.blake2b(np.unique(h[e - c : e]).tobytes(), digest_size=16).digest() for e, c in zip(ends, count, strict=True)]
                some = count > 0
                lows = np.empty((bands * rows, some.sum()), U)
                for i in range(bands * rows if some.any() else 0):
                    lows[i] = np.minimum.reduceat(h * factor[i] + shift[i], (ends - count)[some])
                band = np.arange(bands, dtype=U)[:, None]
                for r in range(rows):
                    band = mix(band * U(31) + lows[r::rows])
                offsets = np.concatenate(([0], np.cumsum(some) * bands)).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.T.ravel().view(np.int64)))
                n_bytes = pa.array(np.diff(buffers(part)[1]))
                here = x.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array(digest, pa.binary()), n_bytes, hashes], ["ik", "th", "c", "n_bytes", "bands"])
                at += len(part)

    return sign


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members the sets of each pair (a, b) share. a ascends."""
    every, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(size) - size
    mark, out = np.zeros(len(every), bool), np.zeros(len(a), np.int64)
    firsts, at = np.unique(a, return_index=True)
    for i, lo, hi in zip(firsts, at, [*at[1:], len(a)], strict=True):
        own = flat[start[i] : start[i] + size[i]]
        mark[own] = True
        n = size[b[lo:hi]]
        ends = np.cumsum(n)
        hits = mark[flat[np.repeat(start[b[lo:hi]] - (ends - n), n) + np.arange(ends[-1])]]
        total = np.concatenate(([0], np.cumsum(hits)))
        out[lo:hi] = total[ends] - total[ends - n]
        mark[own] = False
    return out


def _verify(n: int, threshold: float):
    def unit(x: pa.Table) -> pa.RecordBatch | None:
        band, low, high = (x.column(k)[0].as_py() for k in ("band", "low", "high"))
        if len(x) < 2:
            return None
        block = x.column("block").to_numpy()
        sign = x.column("bands").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        pairs = []
        for s in range(0, len(x), 64):
            equal = sign[s : s + 64, None, :] == sign[None, :, :]
            pair = equal.any(2) & (equal.argmax(2) == band)
            i, j = np.nonzero(pair)
            i += s
            ok = i < j if low == high else (block[i] == low) & (block[j] == high)
            pairs.append((i[ok], j[ok]))
        i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
        if not len(i):
            return None
        sets = []
        for part in portions(x.column("text").combine_chunks()):
            h, count = shingle_hashes(part, n)
            sets += [np.unique(p) for p in np.split(h, np.cumsum(count)[:-1])]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
        i, j = i[fits], j[fits]
        if not len(i):
            return None
        shared = shared_counts(sets, i, j)
        near = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
        i, j = i[near], j[near]
        if not len(i):
            return None
        copies = x.column("n").to_numpy()
        links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        part, before = np.arange(len(x)), None
        while before is None or (part != before).any():
            before = part.copy()
            np.minimum.at(part, i, before[j])
            np.minimum.at(part, j, before[i])
            part = part[part]
        some = np.flatnonzero(links)
        c = x.column("c").combine_chunks()
        return pa.RecordBatch.from_arrays([c.take(pa.array(some)), pa.array(links[some].astype(np.int64)), c.take(pa.array(part[some]))], ["c", "links", "peer"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; a unit is held until the next one begins."""
        held, now = [], None
        for x in batches:
            key = np.stack([x.column(k).to_numpy() for k in ("band", "hash", "low", "high")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(x)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and tuple(key[lo]) != now:
                    if (out := unit(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(x.slice(lo, hi - lo))
                now = tuple(key[lo])
        if held and (out := unit(pa.Table.from_batches(held))) is not None:
            yield out

    return verify


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (a, b): root is the least node of its connected component.

    Each round passes the least label to neighbours and then follows labels of labels; rounds grow with the logarithm of
    the longest path. Tables of the rounds are written, not kept in executors.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        step = labels.join(heard, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("heard", "root")).alias("next"))
        over = labels.select(F.col("node").alias("via"), F.col("root").alias("further"))
        step = durable(step.join(over, F.col("next") == F.col("via"), "left").select("node", "was", F.least("next", F.coalesce("further", "next")).alias("root")), "step")
        if step.where("was != root").isEmpty():
            return labels
        labels = step.select("node", "root")


def signed(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(ik, th, c, n_bytes, bands): (ik, th) tells rows by key and text, null keys included; c is the n-gram set's digest."""
    return _keyed(docs, key, text).select("ik", "th", "body").mapInArrow(_signatures(n, bands, rows), "ik long, th long, c binary, n_bytes long, bands array<long>")


def _identity(key: str, text: str) -> tuple[Column, Column, Column]:
    """A row's key without nulls, a hash of its text whose last bit tells a null key from the lowest number, its text."""
    body = F.coalesce(F.col(text), F.lit(""))
    th = F.xxhash64(body).bitwiseAND(F.lit(-2)).bitwiseOR(F.col(key).isNull().cast("long"))
    return F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)), th, body


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    ik, th, body = _identity(key, text)
    return docs.select(ik.alias("ik"), th.alias("th"), body.alias("body"))


def _key() -> Column:
    return F.when(F.col("th").bitwiseAND(F.lit(1)) == 0, F.col("ik"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(ik, th, n_links, first_ik, first_th) of every row: itself, its links, and the first row of its group."""
    need_whole(docs, key)
    on_workers(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    sig = durable(signed(docs, key, text, n, bands, rows), "signatures")
    first = F.struct((F.col("th").bitwiseAND(F.lit(1)) == 1).alias("null"), "ik", "th", "n_bytes", "bands")
    classes = sig.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("f"))
    classes = durable(classes.select("c", "n", "f.*"), "classes")

    slots = classes.select("c", "n_bytes", F.posexplode("bands").alias("band", "hash"))
    buckets = slots.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("m"), F.sum("n_bytes").alias("bytes"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
    unique = buckets.where("m > 1").groupBy("m", "x", "y").agg(F.min(F.struct("band", "hash", "bytes")).alias("u"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("u.bytes") / BLOCK_BYTES, F.lit(1))).cast("int")
    unique = unique.select(F.col("u.band").alias("band"), F.col("u.hash").alias("hash"), blocks.alias("blocks"))
    members = slots.join(unique, ["band", "hash"]).withColumn("block", F.pmod(F.xxhash64("c", F.lit(2)), F.col("blocks")).cast("int"))
    members = durable(members.select("band", "hash", "block", "blocks", "c"), "members")
    units = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("band", "hash", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "c")

    wanted = classes.join(members.select("c").distinct(), "c", "left_semi").select("c", "n", F.col("ik").alias("w_ik"), F.col("th").alias("w_th"), "bands")
    # wanted grows with the corpus: at no size is it broadcast, so that the plan is one and the same.
    texts = _keyed(docs, key, text).join(wanted.hint("merge"), (F.col("ik") == F.col("w_ik")) & (F.col("th") == F.col("w_th")))
    texts = texts.groupBy("ik", "th").agg(F.first("c").alias("c"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("body").alias("text")).drop("ik", "th")
    unit = ["band", "hash", "low", "high"]
    rows_of = units.join(texts, "c").select(*unit, "block", "c", "n", "bands", "text").repartition(*unit).sortWithinPartitions(*unit)
    found = durable(rows_of.mapInArrow(_verify(n, threshold), "c binary, links long, peer binary"), "links")

    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(found.where("c != peer").select(F.col("c").alias("a"), F.col("peer").alias("b")))
    some = classes.join(links, "c", "left").join(roots, F.col("c") == F.col("node"), "left").where("n > 1 or links is not null")
    some = durable(some.select("c", "n", "null", "ik", "th", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "c").alias("root")), "grouped")
    firsts = some.groupBy("root").agg(F.min(F.struct("null", "ik", "th")).alias("first"))
    info = some.join(firsts, "root").select("c", (F.col("links") + F.col("n") - 1).alias("n_links"), F.col("first.ik").alias("first_ik"), F.col("first.th").alias("first_th"))
    out = sig.select("ik", "th", "c").join(info, "c", "left")
    return out.select("ik", "th", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first_ik", "ik").alias("first_ik"), F.coalesce("first_th", "th").alias("first_th"))


def similarity_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(key, class_id, n_links) of every row: the least key of its group of linked documents, and how many other documents
    have likeness threshold or more with it."""
    full = near_groups(docs, key, text, threshold, n, recall)
    least = F.when(F.col("first_th").bitwiseAND(F.lit(1)) == 0, F.col("first_ik"))
    return full.select(_key().alias(key), least.alias("class_id"), "n_links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """docs with one row, that of the least key, of each group of linked documents."""
    full = durable(near_groups(docs, key, text, threshold, n, recall), "groups")
    other = full.where("ik != first_ik or th != first_th").select("ik", "th").distinct()
    again = full.where("ik = first_ik and th = first_th and n_links > 0").groupBy("ik", "th").count().where("count > 1").select("ik", "th")
    ik, th, _ = _identity(key, text)
    own_ik, own_th = fresh(docs, "own_ik", "own_th")
    keyed = docs.withColumns({own_ik: ik, own_th: th})
    on = lambda t: (keyed[own_ik] == t["ik"]) & (keyed[own_th] == t["th"])
    marks = other.union(again)
    single = keyed.join(marks.hint("merge"), on(marks), "left_anti")
    repeated = keyed.join(again, on(again), "left_semi").dropDuplicates([own_ik, own_th])
    return single.union(repeated).select(*docs.columns)
