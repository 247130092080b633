import math
import random

import pytest

from cinderlog.llm import vectors
from cinderlog.llm.registry import op10_vector_search

SCHEMA = "vec_id long, embedding array<double>, rank string, cell int"


def brute(rows, asked, k):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({x: v for x, v in sorted(kept, key=lambda y: y[1], reverse=True) if x in asked}.items()):
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=False)))), j) for j, v in kept if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def check(spark, rows, k=5, block=8192, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.where("vec_id % 5 = 0")
    index = vectors.fit(vectors.whole(df, "vec_id", "embedding"), **options) if options else None
    stats = {}
    got = sorted(map(tuple, vectors.search(df, asked, k, index=index, first=16, block=block, stats=stats).collect()))
    assert got == brute(rows, {i for i, *_ in rows if i is not None and i % 5 == 0}, k)
    assert stats["met"] <= stats["pairs"]
    return stats["met"] / max(stats["pairs"], 1)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e9])
def test_exact_with_ties_copies_and_odd_vectors(spark, scale):
    rng = random.Random(3)
    rows = [(i, [scale * rng.gauss(i % 4, 1) for _ in range(6)], "x", 1) for i in range(300)]
    rows += [(1000 + i, list(rows[7][1]), None, None) for i in range(40)]  # copies: ties
    rows += [(2000, None, "a", 1), (2005, [1.0, None], "a", 1), (2010, [math.nan], "a", 1), (2015, [math.inf, 1.0], "a", 1), (None, [1.0] * 6, "a", 1), (2020, [], "a", 1), (2025, [1.0, 2.0], "a", 1), (2030, [-1e-9] * 6, "a", 1)]
    check(spark, rows, pivots=7, rings=3, sample=64, unit=16, block=10)


def test_few_pairs_meet_where_vectors_lie_in_clusters(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 20]], "x", 1) for i in range(2000)]
    share = check(spark, rows, pivots=32, rings=4, sample=512, unit=64)
    print("clustered: share of pairs that meet", share)
    assert share < 0.15
    # Vectors of all lengths: long ones win, and the product of the norms holds the others off.
    rows = [(i, [rng.gauss(0, 1) * 0.8 ** (i % 40) for _ in range(16)], "x", 1) for i in range(2000)]
    share = check(spark, rows, pivots=32, rings=4, sample=512, unit=64)
    print("of all lengths: share of pairs that meet", share)
    assert share < 0.5


def test_one_row_that_repeats_is_spread_over_tasks(spark):
    rows = [(7, [0.5, 0.25], "x", 1)] * 500 + [(i, [0.1 * i, 1.0], "x", 1) for i in range(10, 40)]
    check(spark, rows, pivots=2, rings=2, sample=64, unit=32)
    df = spark.createDataFrame(rows, SCHEMA)
    index = vectors.fit(vectors.whole(df, "vec_id", "embedding"), pivots=2, rings=2, sample=64, unit=32)
    cells = vectors.keyed(vectors.whole(df, "vec_id", "embedding"), index)
    index = vectors.measured(index, cells)
    assert index.subs.max() >= 500 // 32 and index.sizes.sum() == 530
    assert cells.groupBy("n", "cell").count().agg({"count": "max"}).first()[0] <= df.rdd.getNumPartitions()


def test_few_and_no_vectors(spark):
    check(spark, [(0, [0.5, -0.5], "", 0), (5, [0.25, 1.0], "", 0)])
    check(spark, [(0, [0.5], "", 0)])
    check(spark, [])
    check(spark, [(0, [1e30, 1e30], "", 0), (1, [1e30, -1e30], "", 0), (2, [3e38, 3e38], "", 0)])


def test_query_over_the_table(spark):
    from conftest import SF

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(map(tuple, op10_vector_search(spark, SF).collect()))
    assert got == brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
