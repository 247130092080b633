import hashlib
import random

import xxhash
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import fingerprints as fp
from cinderlog.llm.registry import op6_fingerprints


def h(seed, data):
    return xxhash.xxh64_intdigest(data, seed)


def brute(text):
    """The sketch, from Spark's published definition of xxhash64 (seed 42; each further column is hashed with the last hash as seed)."""
    w = [x for x in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    w = [h(42, x.encode()).to_bytes(8, "little") for x in w]
    found = set()
    for part in [w[i : i + 5] for i in range(len(w) - 4)] or ([w] if w else []):
        x = 42
        for y in part:
            x = h(x, y)
        found.add((x >> 32) - (1 << 32 if x >> 63 else 0))
    return sorted(found)[:128], len(found)


def test_edited_texts_and_sketches(spark):
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(["ab", "cd", "é", "f\n", "🎉g", "hh"]) for _ in range(n))
    rows = [(i * 7 % 50 if i != 9 else None, some(rng.choice([0, 3, 5, 40, 300])), "x", "y") for i in range(40)]
    rows += [(1000, None, None, None), (1000, "", None, None), (2000, "one two three", "s", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sketch string, need string")
    got = {r.doc_id: r for r in fp.edited_fingerprints(df).collect()}
    assert fp.edited_fingerprints(df).count() == len(rows)
    order = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda x: -(x[0] if x[0] is not None else -1))
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        m = len(text) // 3
        r = got[i]
        assert (r.n_chars, r.edited) == (len(text), text[: len(text) - m] + after[:m])
        assert (r.sketch, r.edited_sketch) == (brute(text)[0], brute(r.edited)[0])


def test_query_over_the_table(spark):
    from conftest import SF

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})(t.split())
    far = []
    for r in op6_fingerprints(spark, SF).collect():
        t, u = texts[r.doc_id], texts[after[r.doc_id]]
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x & 0xFFFFFFFF:08X}" for x in brute(t)[0])
        for other, near in ((edited, r.near_edited), (u, r.near_next)):
            a, b = grams(t), grams(other)
            if a and b:
                far.append(abs(len(a & b) / len(a | b) - near))
    assert max(far) < 0.2 and sum(far) / len(far) < 0.03


def test_estimates(spark):
    word = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(word), " ".join(word[:1000]), ""), ("a b", "a b", None)], "a string, b string, c string")
    s = df.select(*(fp.sketch(F.col(c)).alias(c) for c in "abc"))
    both = s.select(fp.distinct_shingles(F.col("a")).alias("n"), fp.containment(F.col("b"), F.col("a")).alias("in_a"), fp.containment(F.col("a"), F.col("b")).alias("in_b"), fp.likeness(F.col("c"), F.col("c")).alias("none"), (fp.merge(F.col("a"), F.col("b")) == F.col("a")).alias("merged")).collect()
    assert abs(both[0].n / 2996 - 1) < 0.3 and both[0].in_a > 0.8 and abs(both[0].in_b - 1 / 3) < 0.12
    assert both[1].n == 1 and all(r.none == 1 and r.merged for r in both)
    assert fp.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fp.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited == "abcdab"


def test_long_texts_and_keys_that_are_no_numbers(spark):
    a, b = "word " * 200_000, " ".join(f"w{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, a, 1), (2, b, 2)], "doc_id int, text string, ik int")
    got = {r.doc_id: r for r in fp.edited_fingerprints(docs).collect()}
    assert got[2].edited == b[: len(b) - len(b) // 3] + a[: len(b) // 3] and got[1].n_chars == len(a) and got[2].near_next < 0.05
    assert got[2].near_edited > 0.5 and len(got[2].sketch) == fp.K
    with pytest.raises(ValueError):
        fp.edited_fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("string")))
