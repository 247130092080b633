"""What is told in blocks of places is the same whatever their size."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from cinderlog.functions.text import groups
from cinderlog.operators import stability as st
from cinderlog.operators.order import runs, sliding
from cinderlog.operators.templates import parse_tree
from cinderlog.runtime import spread


@pytest.mark.parametrize("size", [1, 2, 5])
def test_windows_cross_blocks_and_stop_at_gaps(spark, size):
    ords = [o for o in range(300) if o not in (7, 8, 100, 160, 161)]
    df = spark.createDataFrame([(o, f"v{o}", "k") for o in ords], "ord long, v string, other string")
    got = {r.window: (r.first_ord, r.last_ord, [x.v for x in r.records]) for r in sliding(df, size, "v", block=32).collect()}
    want = {o: (o, o + size - 1, [f"v{x}" for x in range(o, o + size)]) for o in ords if all(x in set(ords) for x in range(o, o + size))}
    assert got == want


def test_windows_by_key(spark):
    df = spark.createDataFrame([(o, k, o * 10) for k in "ab" for o in range(100 if k == "a" else 40)], "ord long, k string, v int")
    got = sliding(df, 3, "v", by=("k",), block=48).collect()
    assert len(got) == 98 + 38 and all([x.v for x in r.records] == [10 * (r.window + i) for i in range(3)] for r in got)


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_runs_cross_blocks(spark, block):
    rng = random.Random(block)
    rows = []
    for k in ("a", "b", None):
        value = None
        for o in range(120):
            if rng.random() < 0.2:
                value = rng.choice(["x", "y", None])
            if rng.random() < 0.8:
                rows.append((o, k, value))
    want = []
    for k in ("a", "b", None):
        own = [(o, v) for o, x, v in rows if x == k]
        for v, run in groupby(own, key=lambda r: r[1]):
            run = list(run)
            want.append((k, v, run[0][0], len(run)))
    df = spark.createDataFrame(rows, "ord long, k string, v string")
    got = [(r.k, r.v, r.start, r.n) for r in runs(df, "v", "k", block=block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert runs(df.limit(0), "v", "k").count() == 0


def test_order_of_stamps_is_seen_between_blocks(spark):
    inf = float("inf")
    series = {"up": [1, 2, 2, 5, 6, 7, 8, 9], "in block": [1, 3, 2, 4, 5, 6, 7, 8], "between": [1, 2, 3, 9, 4, 5, 6, 7], "same": [4] * 8, "none": [1, None, 3, 4, 5, 6, 7, 8], "infinite": [1, 2, inf, 4, 5, 6, 7, 8]}
    rows = [(o, k, "n", None if t is None else float(t)) for k, ts in series.items() for o, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "ord long, event string, name string, t double")
    for block in (1, 2, 4, 100):
        got = {r.event: r.timed for r in st.time_spans(df, "event", "name", time="t", block=block).collect()}
        assert got == {k: k == "up" for k in series}


def test_both_modes_are_read_off_one_pass(spark):
    rows = [(o, "e", "n", "ab"[o % 2] if o < 4 else "a", float(o * o)) for o in range(64)]
    flags = st.value_changes(spark.createDataFrame(rows, "ord long, event string, name string, value string, t double"))
    count, time = (st.segment_means(flags, mode=m, time="t").first() for m in ("count", "time"))
    assert (count.m0, count.m1) == (2 / 16, 0.0) and (time.m0, time.m1) == (2 / 32, 0.0) and count.n == time.n == 64
    stable = all(x < y for r in (count, time) for x, y in zip((r.m0, r.m1, r.m2, r.m3), st.THRESHOLDS, strict=True))
    assert (st.classify(flags, mode="both", time="t").first()["class"] == st.STABLE) == stable
    with pytest.raises(ValueError):
        st.segment_means(flags, mode="other")


def test_groups_are_cut_whatever_the_text_holds(spark):
    texts = ["a=1 b=2", "a= b=", "a=\x01 b=x\x01y", "a=$1 b=\\", "a=1\x01 b="]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.g for r in df.select("i", groups(F.col("t"), r"^a=(.*?) b=(.*?)\z", 2).alias("g")).orderBy("i").collect()]
    assert got == [["1", "2"], ["", ""], ["\x01", "x\x01y"], ["$1", "\\"], ["1\x01", ""]]


def test_tree_matching_sees_letters_and_digits_only(spark):
    df = spark.createDataFrame([(0, "User: bob-1 logged IN"), (1, "user bob in"), (2, None), (3, "job 7; (done)")], "i int, content string")
    got = [(r.EventID, r.template, r.variables) for r in parse_tree(df, ["User <*> logged IN", "job <*>: done", "<*>"][:2]).orderBy("i").collect()]
    assert got == [(0, "User <*> logged IN", ["bob1"]), (-1, "template not found", []), (-1, "template not found", []), (1, "job <*>: done", ["7"])]
    assert parse_tree(df, []).first().EventID == -1


def test_spread_leaves_tables_of_many_splits(spark):
    few, many = spark.range(100, numPartitions=1), spark.range(100, numPartitions=16)
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(few, "id").count() == 100
    assert spread(many, "id").rdd.getNumPartitions() == 16
