import hashlib
import struct
from collections import Counter

import numpy as np
import public_tokenizers
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline as cp
from cinderlog.llm import quality
from test_mixing import brute as brute_mix
from test_ngram_join import brute as brute_groups
from test_quality import grams


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    kept = cp.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    half = {r.label_key: (r.good, r.fit) for r in quality.labelled(labels, "doc_id", "quality", 10**6).collect()}
    own = {i: np.array(grams(r.text), int) for i, r in rows.items()}
    raw = np.bincount(np.concatenate(list(own.values())), minlength=1 << quality.BITS)
    good = np.bincount(np.concatenate([own[i] for i, (g, f) in half.items() if g and f]), minlength=1 << quality.BITS)
    expected = good.sum() * raw / raw.sum()
    ratio = np.where(abs(good - expected) < 3 * np.sqrt(expected + 1), 0, np.log((good + 1) / (expected + 1)))
    mean = {i: ratio[g].mean() if len(g) else 0.0 for i, g in own.items()}
    held = [(mean[i], g == 1) for i, (g, f) in half.items() if not f]
    slope, shift = quality.scale(np.array([m for m, _ in held]), np.array([g for _, g in held]))
    weight = {i: slope * m + shift for i, m in mean.items()}
    level = quality.level_for(np.array([slope * m + shift for m, g in held if g]), quality.KEEP_GOOD)
    k = round(sum(1 - np.exp(-np.exp(min(w - level, 50))) for w in weight.values()))
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(F.col("doc_id"), 9).alias("g")).collect()}
    first = sorted(rows, key=lambda i: -(weight[i] + noise[i]))[:k]
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(first)

    single = cp.near_duplicates(spark, kept, SF)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({g for _, g, _ in brute_groups([(i, rows[i].text) for i in ids])})

    mixed = cp.source_mix(spark, single, SF)
    assert mixed.columns == docs.columns
    left = [(r.doc_id, r.text, r.source) for r in single.collect()]
    copies = {i: (taken * 2 + n) // (2 * n) if n else None for i, n, _, _, taken in brute_mix(left)}
    count = Counter(r.doc_id for r in mixed.collect())
    assert all(count[i] == c for i, c in copies.items() if c is not None) and max(count.values()) == 2

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in mixed.collect():
        got = t.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, r.source, len(got), hashlib.sha256(struct.pack(f"<{len(got)}I", *got)).hexdigest(), hashlib.sha256(t.decode(got, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, cp.token_ids(spark, mixed, SF).collect())) == want
    assert Counter(map(tuple, cp.run(spark, SF).collect())) == want


def test_clashing_columns_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, source string, size string, taken int, k int"
    docs = spark.createDataFrame([(1, "a b c", None, "s", 1, 2), (None, None, "x", None, None, None), (2, "", "x", None, None, None), (3, "one two", "x", "", 0, 0)], schema)
    got = cp.source_mix(spark, docs, SF)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} >= {1}
    assert cp.source_mix(spark, docs.limit(0), SF).count() == 0
    assert cp.near_duplicates(spark, docs, SF).count() == 3
