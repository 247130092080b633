from pyspark.sql import functions as F

from cinderlog.llm.bounded import few, frequent, frequent_and_rest


def test_frequent_rows_are_bounded_whatever_the_counts(spark):
    df = spark.createDataFrame([(f"w{i}", 1 + 5000 // (i + 1)) for i in range(2000)], "w string, n long")
    got = frequent(df, "n", 100, "t")
    assert 50 < len(got) <= 100 and min(r.n for r in got) > max(1 + 5000 // (i + 1) for i in range(2000) if f"w{i}" not in {r.w for r in got})
    assert frequent(df.withColumn("n", F.lit(7)), "n", 100, "t") == [] and len(frequent(df, "n", 5000, "t")) == 2000
    assert frequent(df.limit(0), "n", 100, "t") == []


def test_frequent_rows_and_the_rest_are_all_rows(spark):
    df = spark.createDataFrame([(f"w{i}", 1 + 5000 // (i + 1)) for i in range(2000)], "w string, n long")
    for most in (0, 100, 1999):
        high, rest = frequent_and_rest(df, "n", most, "t")
        assert high.count() <= most and high.union(rest).exceptAll(df).isEmpty() and high.count() + rest.count() == 2000
    assert frequent_and_rest(df, "n", 2000, "t")[1] is None and frequent_and_rest(df.limit(0), "n", 0, "t")[1] is None


def test_few_rows_by_hash(spark):
    df = spark.range(50_000).select(F.col("id"), F.lit("x").alias("v"))
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    assert [r.id for r in few(df, ["id"], 300).collect()] == want
    # One row that repeats is one; null keys are keys.
    hot = df.union(spark.range(30_000).select(F.lit(None).cast("long"), F.lit("x")))
    got = few(hot, ["id"], 300).collect()
    assert 200 < len(got) <= 300 and len(set(got)) == len(got)
    assert few(df.limit(10), ["id"], 300).count() == 10 and few(df.limit(0), ["id"], 300).count() == 0
