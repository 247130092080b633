"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (one, two and three words), one of target text (documents labelled good) and
one of all text, give each document the mean, over its n-grams, of log(target probability / raw probability): a mean, so
that a long text outweighs no better one. A logistic regression of that mean on labelled rows which the models haven't seen
puts it on the scale of log importance weights (the odds that a document is good). Adding standard Gumbel noise to the log
weights and keeping the k largest sums samples k documents without replacement in proportion to their weights: documents far
above the cut always stay, others at a rate that falls with their weight, and another seed draws others of them.

k is a budget: a number of documents, or by default the expected size of a sample, from this corpus, that holds a stated
share of unseen documents labelled good.

The raw model counts every document. The target model, the scale and the default budget use at most label_rows labelled
keys, each half of them, in the order of a hash of their keys: a documented parameter, and the only bound.

Edge cases: null and empty texts have mean 0, as a text has whose n-grams tell nothing; without good labels nothing tells
documents apart, so all have weight 1 and, without a budget, stay; without bad ones a unit of the scale is the deviation of
good ones; rows equal in key and weight stay or go together, so that the sample may exceed k by their copies; labels that
are null are ignored, and of a key's repeated labels the lowest counts; the lowest of a repeated key's weights sets the
scale. Other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.bounded import few
from cinderlog.llm.names import fresh
from cinderlog.llm.texthash import portions, word_grams
from cinderlog.runtime import durable, on_workers

LABEL_ROWS, ORDERS, BITS, PRIOR, SURE, KEEP_GOOD = 20_000, (1, 2, 3), 17, 1.0, 3.0, 0.998
#: Of the logistic regression, on slopes per deviation of good documents.
RIDGE = 1.0


@dataclass
class Importance:
    """log_ratio: of each bucket; a document's log weight is slope times its mean plus shift; level: what log weight plus
    noise has to reach for the default budget, -inf if all documents stay."""

    log_ratio: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    level: float = -math.inf
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS


def labelled(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """At most `rows` keys: (label_key, good, fit), fit being the half that the target model is made of."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(F.min(label).alias("good"))
    return few(durable(one, "label-keys"), ["label_key"], rows).withColumn("fit", F.xxhash64(F.lit("half"), "label_key") % 2 == 0)


def _bucket_counts(orders: tuple[int, ...], bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for x in batches:
            target = x.column(1).to_numpy(zero_copy_only=False)
            at = 0
            for part in portions(x.column(0)):
                for b, n in word_grams(part, orders, bits):
                    total[0] += np.bincount(b, minlength=1 << bits)
                    total[1] += np.bincount(b[np.repeat(target[at : at + len(part)], n)], minlength=1 << bits)
                at += len(part)
        bucket = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(total[0][bucket]), pa.array(total[1][bucket])], ["bucket", "raw", "target"])

    return count


def scale(mean: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the log odds that a document with this mean is good, by Newton's method."""
    own = mean[good]
    centre, unit = float(np.median(own)), float(own.std()) or 1.0
    if good.all():
        return 1 / unit, -centre / unit
    x = np.stack(((mean - centre) / unit, np.ones(len(mean))), 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        s = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(x.T @ (x * s[:, None]) + np.diag([RIDGE, 1e-6]), x.T @ (good - p) - np.array([RIDGE, 1e-6]) * w)
        w += step / max(1.0, float(np.abs(step).max()))
    slope = max(float(w[0]), 0.0) / unit
    return slope, float(w[1]) - slope * centre


def level_for(log_weights: np.ndarray, share: float) -> float:
    """The level that log weight plus Gumbel noise reaches with probability `share`, on the mean of these documents."""
    low, high = float(log_weights.min()) - 50, float(log_weights.max()) + 50
    for _ in range(100):
        level = (low + high) / 2
        if -np.expm1(-np.exp(np.minimum(log_weights - level, 50))).mean() >= share:
            low = level
        else:
            high = level
    return low


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", label_rows: int = LABEL_ROWS, orders: tuple[int, ...] = ORDERS, bits: int = BITS, keep_good: float = KEEP_GOOD) -> Importance:
    """Learn the models, the scale and the level. What reaches the driver: 2 ** bits counts and one row for each of half of
    label_rows keys."""
    on_workers(docs.sparkSession)
    sample = durable(labelled(labels, key, label, label_rows), "labels")
    target = F.broadcast(sample.where("fit and good = 1").select("label_key", F.lit(True).alias("target")))
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    tagged = narrow.join(target, F.col("k") == F.col("label_key"), "left").select("t", F.coalesce("target", F.lit(False)).alias("g"))
    counts = tagged.mapInArrow(_bucket_counts(orders, bits), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in counts.collect():
        raw[r.bucket], good[r.bucket] = r.raw, r.target
    model = Importance(np.zeros(1 << bits), orders=orders, bits=bits)
    if not good.sum():
        return model
    # What the target text would hold if it were like the raw text. Where it differs by chance, as in rare n-grams it does,
    # it tells nothing: only differences of SURE standard deviations count.
    expected = good.sum() * raw / raw.sum()
    model.log_ratio = np.where(np.abs(good - expected) < SURE * np.sqrt(expected + 1), 0.0, np.log((good + PRIOR) / (expected + PRIOR)))
    unseen = F.broadcast(sample.where("not fit").select("label_key", "good"))
    held = narrow.join(unseen, F.col("k") == F.col("label_key")).select("k", "good", mean_ratio(model, F.col("t")).alias("m"))
    rows = held.groupBy("k").agg(F.min("m").alias("m"), F.min("good").alias("good")).collect()
    mean, is_good = np.array([r.m for r in rows]), np.array([r.good == 1 for r in rows], bool)
    if is_good.any():
        model.slope, model.shift = scale(mean, is_good)
        model.level = level_for(model.slope * mean[is_good] + model.shift, keep_good)
    return model


def mean_ratio(model: Importance, text: Column) -> Column:
    """Double: the mean, over a text's n-grams, of the models' log ratio."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)

    def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for x in it:
            out = [np.zeros(0)]
            for part in portions(x):
                total, size = np.zeros(len(part)), np.zeros(len(part))
                for b, n in word_grams(part, m.orders, m.bits):
                    sums, ends = np.concatenate(([0.0], np.cumsum(m.log_ratio[b]))), np.cumsum(n)
                    total += sums[ends] - sums[ends - n]
                    size += n
                out.append(total / np.maximum(size, 1))
            yield pa.array(np.concatenate(out).round(9), pa.float64())

    return F.arrow_udf("double")(batches)(text)


def log_weight(model: Importance, text: Column) -> Column:
    """Double: the log importance weight of a text."""
    return F.round(mean_ratio(model, text) * model.slope + model.shift, 6)


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on key and seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) * 2.0**-53
    return -F.ln(-F.ln(u))


def kth_largest(df: DataFrame, value: str, k: int, bins: int = 1024) -> float:
    """The k-th largest of a column of doubles, exactly, by histograms of ever narrower ranges (`bins` rows each)."""
    n, low, high = df.agg(F.count(value), F.min(value), F.max(value)).first()
    if k <= 0 or not n:
        return math.inf
    if k >= n:
        return low
    while low < high:
        width = (high - low) / bins
        if width <= 0 or math.isinf(width):
            break
        b = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width)).alias("b")
        rows = df.where(F.col(value).between(low, high)).groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        for r in sorted(rows, reverse=True):
            if k <= r.n:
                break
            k -= r.n
        if (low, high) == (r.low, r.high):
            break
        low, high = r.low, r.high
    return low


def expected_size(log_weights: DataFrame, name: str, level: float) -> int:
    """How many documents' log weight plus noise reaches the level, on the mean. Summed in whole millionths, so that the order
    of addition changes nothing."""
    if level == -math.inf:
        return log_weights.count()
    stays = -F.expm1(-F.exp(F.least(F.col(name) - level, F.lit(50.0))))
    return round((log_weights.agg(F.sum(F.round(stays * 1e6).cast("long"))).first()[0] or 0) / 1e6)


def resample(docs: DataFrame, model: Importance, key: str = "doc_id", text: str = "text", seed: int = 9, budget: int | None = None, names: tuple[str, str, str] = ("log_weight", "sort_key", "keep")) -> tuple[DataFrame, float]:
    """docs with its log weight, its sort key (log weight plus noise) and whether it stays, under `names`; and the sort key
    of the last one kept. Columns of these names are replaced. budget: how many documents stay.

    Scores are computed twice, once for the cut and once here: that is less work than to move whole texts to a score
    computed elsewhere.
    """
    weight, order, keep = names
    if clash := {key.lower(), text.lower()} & {n.lower() for n in names}:
        raise ValueError(f"names: {clash} are read")
    on_workers(docs.sparkSession)
    scored = docs.drop(*names).withColumn(weight, log_weight(model, F.col(text))).withColumn(order, F.round(F.col(weight) + gumbel(F.col(key), seed), 6))
    narrow = durable(scored.select(F.col(weight).alias("log_weight"), F.col(order).alias("sort_key")), "importance")
    cut = kth_largest(narrow, "sort_key", expected_size(narrow, "log_weight", model.level) if budget is None else budget)
    return scored.withColumn(keep, F.col(order) >= cut), cut


def resampled(docs: DataFrame, model: Importance, key: str = "doc_id", text: str = "text", seed: int = 9, budget: int | None = None) -> DataFrame:
    """The rows of docs that stay, with the columns that docs has, whatever their names."""
    names = fresh(docs, "log_weight", "sort_key", "keep")
    return resample(docs, model, key, text, seed, budget, tuple(names))[0].where(F.col(names[2])).select(*docs.columns)
