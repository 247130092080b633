"""URL filters: rules for hosts and paths, and for all other URLs a logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table (a list of (url, label) that the caller passes), by
Newton's method on n-grams of host and path, and broadcast: 2 ** BITS weights, whatever the corpus. labelled_urls.txt beside
this module is such a table: sites of many kinds, countries and tongues on one side, gambling, adult, pills, pirated software,
swindles, trackers and link farms on the other, with words that look alike on both.

A table holds as many URLs to block as others, a crawl doesn't: the intercept is shifted so that a URL whose n-grams tell
nothing is blocked with probability `prior`.

Edge cases: a null URL, or one without `://`, has empty host and path; no rule fits an empty host; the model judges it as
any other. Equal URLs get equal verdicts, and repeated rows stay. Very long URLs are read whole. Columns of other names stay,
equal names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.names import fresh
from cinderlog.llm.texthash import byte_grams
from cinderlog.runtime import on_workers

GRAMS, BITS, PENALTY, PRIOR = (3, 4, 5), 16, 0.01, 0.1


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block, 0 to allow) of the table beside this module."""
    text = Path(__file__).with_name("labelled_urls.txt").read_text(encoding="utf-8")
    rows = (line.split() for line in text.splitlines() if line and line[0] in "+-")
    return [(url, int(sign == "-")) for sign, url in rows]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    big = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), big, big.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. rules: ("host/path start", verdict), a small list."""

    def fits(rule: str) -> Column:
        name, slash, start = rule.partition("/")
        return ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))

    order = sorted(rules, key=lambda r: -len(r[0]))
    if not order:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    case = reduce(lambda c, r: (F if c is None else c).when(fits(r[0]), F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("verdict"))), order, None)
    return case


def _features(host: pa.Array, path: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, number of each URL's) for each kind of n-gram. ^ and $ mark where the parts begin and
    end; which number stands in a URL tells nothing, so each is 0."""
    for k, part in enumerate((host, path)):
        text = pc.binary_join_element_wise("^", pc.replace_substring_regex(pc.fill_null(part, ""), "[0-9]+", "0"), "$", "")
        for n in GRAMS:
            bucket, count = byte_grams(text, n, BITS)
            yield (bucket * 31 + 7 * n + k * 4099) & ((1 << BITS) - 1), count


def logits(weights: np.ndarray, host: pa.Array, path: pa.Array) -> np.ndarray:
    total, size = np.full(len(host), weights[-1]), np.zeros(len(host))
    own = np.zeros(len(host))
    for bucket, count in _features(host, path):
        sums, ends = np.concatenate(([0.0], np.cumsum(weights[bucket]))), np.cumsum(count)
        own += sums[ends] - sums[ends - count]
        size += count
    return total + own / np.sqrt(np.maximum(size, 1))


def train(labelled: list[tuple[str, int]], prior: float = PRIOR) -> np.ndarray:
    """Weights of the buckets, then the intercept. ValueError unless both labels occur."""
    import re

    if {y for _, y in labelled} != {0, 1}:
        raise ValueError("labelled: URLs of both labels")
    rest = [u.partition("://")[2] for u, _ in labelled]
    host = pa.array([re.match("[^/?#]*", r)[0].lower() for r in rest])
    path = pa.array([re.match("[^/?#]*([^?#]*)", r)[1] for r in rest])
    parts, size = [], np.zeros(len(rest))
    for bucket, count in _features(host, path):
        parts.append((np.repeat(np.arange(len(rest)), count), bucket))
        size += count
    row, bucket = (np.concatenate(p) for p in zip(*parts, strict=True))
    # Only the n-grams that the table has: those are few beside 2 ** BITS.
    used, column = np.unique(bucket, return_inverse=True)
    x = np.zeros((len(rest), len(used) + 1))
    np.add.at(x, (row, column), 1.0)
    x[:, :-1] /= np.sqrt(np.maximum(size, 1))[:, None]
    x[:, -1] = 1.0
    y = np.array([label for _, label in labelled], float)
    # In the span of the rows: w = x' a, so Newton's steps solve systems as large as the table, not as the n-grams.
    k, a = x @ x.T, np.zeros(len(y))
    for _ in range(30):
        p = 1 / (1 + np.exp(-k @ a))
        s = np.maximum(p * (1 - p), 1e-6)
        a = np.linalg.solve(k + PENALTY * np.diag(1 / s), k @ a + (y - p) / s)
    weights, own = np.zeros((1 << BITS) + 1), x.T @ a
    weights[used], weights[-1] = own[:-1], own[-1]
    weights[-1] += math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
    return weights


def judge(df: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[str, int]], url: str = "url", cut: float = 0.5, prior: float = PRIOR) -> DataFrame:
    """df with host, path, rule, verdict (the rule's, else block where the model's probability is cut or more) and
    block_probability. Equal names are replaced, save for url itself, which is read first."""
    on_workers(df.sparkSession)
    weights = df.sparkSession.sparkContext.broadcast(train(labelled, prior))

    def batches(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for host, path in it:
            yield pa.array(1 / (1 + np.exp(-logits(weights.value, host, path))), pa.float64())

    names = ["host", "path", "rule", "verdict", "block_probability"]
    kept = [c for c in df.columns if c.lower() not in names]
    h, p, r, b = fresh(df, "h", "p", "r", "b")
    host, path = host_and_path(F.col(url))
    out = df.withColumns({h: host, p: path})
    out = out.withColumn(r, rule_of(F.col(h), F.col(p), rules)).withColumn(b, F.arrow_udf("double")(batches)(h, p))
    learnt = F.when(F.col(b) >= cut, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(F.col(f"{r}.verdict"), learnt)
    return out.select(*kept, F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{r}.rule").alias("rule"), verdict.alias("verdict"), F.col(b).alias("block_probability"))
