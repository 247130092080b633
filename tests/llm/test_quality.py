import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import quality, texthash


def grams(text, orders=quality.ORDERS, bits=quality.BITS):
    """Buckets of a text's n-grams, one by one, from the hashes of its words."""
    words = [int(h) for h in texthash.word_hashes(pa.array([text]))[0]]
    out = []
    for n in orders:
        for k in range(len(words) - n + 1):
            x = (n + sum(w * int(texthash._PLACE[i]) for i, w in enumerate(words[k : k + n]))) % 2**64
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> shift)) * factor % 2**64
            out.append((x ^ (x >> 31)) >> (64 - bits))
    return out


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out, cut = quality.resample(docs, quality.fit(docs, labels))
    half = quality.labelled(labels, "doc_id", "quality", quality.LABEL_ROWS).where("not fit")
    got = out.join(half, F.col("doc_id") == F.col("label_key")).select("good", "keep").collect()
    kept = {g: np.mean([r.keep for r in got if r.good == g]) for g in (0, 1)}
    assert kept[1] >= 0.99 and kept[0] <= 0.05
    # The noise matters near the cut: it isn't a plain threshold.
    assert out.where(F.col("keep") != (F.col("log_weight") >= cut)).count() >= 5


def test_mean_ratio_is_the_mean_over_all_word_grams(spark):
    rng = np.random.default_rng(1)
    model = quality.Importance(rng.normal(size=1 << quality.BITS), 3.0, -1.0)
    texts = ["", None, " \n", "abc", "abc d", "é🎉 abcé x\ty", "long words " * 150_000, "x" * 300_000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, log_weight string")
    got = {r.doc_id: r for r in df.select("doc_id", quality.mean_ratio(model, F.col("text")).alias("m"), quality.log_weight(model, F.col("text")).alias("w")).collect()}
    for i, t in enumerate(texts):
        ratios = [model.log_ratio[g] for g in grams(t or "")]
        want = sum(ratios) / max(len(ratios), 1)
        assert math.isclose(got[i].m, want, abs_tol=1e-6) and math.isclose(got[i].w, 3 * want - 1, abs_tol=1e-5)


def one_word_model(weights):
    """A model by which each of these words, as a text, has its log weight."""
    model = quality.Importance(np.zeros(1 << quality.BITS))
    for word, w in weights.items():
        model.log_ratio[grams(word)[0]] = w
    return model


def test_inclusion_follows_the_weights_and_seeds_change_the_sample(spark):
    weights = {"low": 0.0, "mid": 1.5, "high": 3.0, "sure": 30.0}
    n, budget = 4000, 5600
    docs = spark.range(len(weights) * n).select(F.col("id").alias("doc_id"), F.get(F.array(*map(F.lit, weights)), (F.col("id") % len(weights)).cast("int")).alias("text"))
    model = one_word_model(weights)
    samples = []
    for seed in (1, 2):
        out, _ = quality.resample(docs, model, seed=seed, budget=budget)
        rows = out.where("keep").select("doc_id", "text").collect()
        assert len(rows) == budget
        # What reaches the level t: 1 - exp(-w / e^t), for the t at which the classes' sizes add up to the budget.
        t = quality.level_for(np.repeat(list(weights.values()), n), budget / (len(weights) * n))
        for word, w in weights.items():
            p = -math.expm1(-math.exp(w - t))
            got = sum(r.text == word for r in rows) / n
            assert abs(got - p) < 4 * math.sqrt(p * (1 - p) / n) + 2e-3
        samples.append({r.doc_id for r in rows})
    both = len(samples[0] & samples[1])
    assert both < 0.9 * budget and {4 * k + 3 for k in range(n)} <= samples[0] & samples[1]


def test_scale_and_level():
    rng = np.random.default_rng(3)
    mean = np.concatenate((rng.normal(0, 1, 4000), rng.normal(-2, 1, 4000)))
    good = np.arange(8000) < 4000
    slope, shift = quality.scale(mean, good)
    # Two normal distributions of one deviation: the log odds are 2 (x + 1).
    assert abs(slope - 2) < 0.2 and abs(shift - 2) < 0.2
    assert quality.scale(mean[:4000], good[:4000])[0] == pytest.approx(1, abs=0.05)
    assert quality.scale(np.zeros(3), np.array([True] * 3)) == (1.0, 0.0)
    assert quality.scale(-mean, good)[0] == 0
    w = np.array([0.0, 2.0, 5.0])
    level = quality.level_for(w, 0.9)
    assert np.mean(1 - np.exp(-np.exp(w - level))) == pytest.approx(0.9, abs=1e-6)


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1e6), 1.0, 1.0 + 1e-9, -5.0]) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 100, 350, 351, 699, 700, 900):
        assert quality.kth_largest(df, "v", k, bins=8) == order[min(k, 700) - 1]
    assert quality.kth_largest(df, "v", 0) == math.inf and quality.kth_largest(df.limit(0), "v", 3) == math.inf


def test_no_labels_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, keep string, label_key long"
    docs = spark.createDataFrame([(1, "some text", "a", 1), (1, "some text", "a", 1), (None, None, None, None), (2, "", "", 2)], schema)
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    out, _ = quality.resample(docs, quality.fit(docs, labels))
    assert [r.keep for r in out.collect()] == [True] * 4
    none, _ = quality.resample(docs.limit(0), quality.fit(docs.limit(0), labels))
    assert none.count() == 0
    some = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert quality.resample(docs, quality.fit(docs, some))[0].count() == 4
    # A held-out key whose rows repeat is one row of what the driver gets.
    many = docs.union(spark.createDataFrame([(7, "some text", "", 7)] * 50, schema))
    every = spark.createDataFrame([(k, 1) for k in range(1, 9)], "doc_id long, quality int")
    assert quality.resample(many, quality.fit(many, every))[0].count() == 54


def test_rows_keep_their_columns_whatever_their_names(spark):
    docs = spark.createDataFrame([(1, "low", "k1", 0.5, "s1", True), (2, "high", None, None, None, None)], "doc_id long, text string, Keep string, log_weight double, sort_key string, _keep boolean")
    got = quality.resampled(docs, one_word_model({"high": 9.0}), budget=1)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "high", None, None, None, None)]
    with pytest.raises(ValueError):
        quality.resample(docs, one_word_model({}), text="Keep")


def test_byte_grams_do_not_cross_texts():
    b, n = texthash.byte_grams(pa.array(["abcdef", "", None, "xyz", "wxyz"]), 4, 16)
    assert n.tolist() == [3, 0, 0, 0, 1] and len(b) == 4


def test_word_grams_do_not_cross_texts():
    texts = ["a b c d", "", None, "e", "f g"]
    for bits in (16, 17):
        flat = [(b.tolist(), n.tolist()) for b, n in texthash.word_grams(pa.array(texts), (1, 2, 3), bits)]
        assert [n for _, n in flat] == [[4, 0, 0, 1, 2], [3, 0, 0, 0, 1], [2, 0, 0, 0, 0]]
        assert sorted(sum((b for b, _ in flat), [])) == sorted(sum((grams(t or "", bits=bits) for t in texts), []))
