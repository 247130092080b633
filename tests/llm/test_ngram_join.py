import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cinderlog.llm import ngram_join as nj
from cinderlog.llm import texthash


def grams(text):
    w = [x for x in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t, *_ in rows]
    near = lambda a, b: a == b or (a and b and len(a & b) >= threshold * len(a | b))
    links = [[j for j in range(len(rows)) if j != i and near(sets[i], sets[j])] for i in range(len(rows))]
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            if (k := todo.pop()) not in group:
                group.add(k)
                todo += links[k]
        seen |= group
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out |= {k: (rows[k][0], min(ids) if ids else None, len(links[k])) for k in group}
    return [out[i] for i in range(len(rows))]


def corpus(rng, n):
    word = [f"w{i}" for i in range(400)] + ["é🎉", "x\n"]
    rows = []
    for i in range(n):
        base = [rng.choice(word) for _ in range(rng.choice([1, 3, 8, 30, 80]))]
        rows.append((len(rows), " ".join(base), "s", 7))
        for _ in range(rng.choice([0, 0, 1, 3, 12 if i % 9 == 0 else 0])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(word)
            rows.append((len(rows), rng.choice([" ", "  ", "\t"]).join(copy), None, None))
    return rows


SCHEMA = "doc_id long, text string, c string, links int"


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_ROWS", 4)  # so that buckets are cut into blocks
    rng = random.Random(4)
    rows = corpus(rng, 120) + [(None, None, None, None), (None, "", "a", 1), (3000, " \n", "a", 1)] + [(3001, "same row", "a", 1)] * 3
    rng.shuffle(rows)
    got = nj.similarity_join(spark.createDataFrame(rows, SCHEMA), recall=0.999999, threshold=0.8).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))
    assert nj.similarity_join(spark.createDataFrame([], SCHEMA)).count() == 0
    one = nj.one_of_each(spark.createDataFrame(rows, SCHEMA), recall=0.999999)
    assert one.columns == ["doc_id", "text", "c", "links"]
    want = Counter({g for _, g, _ in brute(rows)})
    assert Counter(r.doc_id for r in one.collect()) == want


def test_recall_of_the_banding_that_the_query_uses(spark):
    rng = random.Random(8)
    rows = corpus(rng, 150)
    got = nj.similarity_join(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert sum(r.n_links for r in got) >= 0.99 * sum(x[2] for x in want)
    assert sum(r.n_links for r in got) <= sum(x[2] for x in want)


def test_choice_of_bands():
    for t, recall in ((0.8, 0.999), (0.5, 0.95), (0.95, 0.99)):
        b, r = nj.choose_bands(t, recall)
        assert 1 - (1 - t**r) ** b >= recall and b * r <= nj.MOST_HASHES
    with pytest.raises(ValueError):
        nj.choose_bands(0.01, 0.9999)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60) if i % 20] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, i) for i in range(501, 560)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = nj.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in parent}


def test_shingle_hashes_are_equal_where_words_are():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, "", " ", "a", "x" * 3_000_000]
    seen, back = {}, {}
    for part in texthash.portions(pa.array(texts), 300):
        h, n = texthash.shingle_hashes(part)
        for text, own in zip(part.to_pylist(), np.split(h, np.cumsum(n)[:-1]), strict=True):
            w = [x for x in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
            want = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
            assert len(want) == len(own)
            for g, x in zip(want, own.tolist(), strict=True):
                assert seen.setdefault(g, x) == x and back.setdefault(x, g) == g


def test_long_texts_clashing_names_and_keys_that_are_no_numbers(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long, 7, 8, "x"), (2, long + " more", 7, 8, "y"), (3, "w " * 300_000, None, None, None), (4, "w " * 300_001, 1, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ik long, own_ik int, _own_th string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.similarity_join(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1)}
    one = nj.one_of_each(docs)
    assert one.columns == docs.columns and sorted(map(tuple, one.collect())) == [rows[0], rows[2]]
    with pytest.raises(ValueError):
        nj.similarity_join(docs.withColumn("doc_id", docs.doc_id.cast("string")))
    assert nj.similarity_join(docs.withColumn("doc_id", docs.doc_id.cast("int"))).where("n_links = 1").count() == 4
