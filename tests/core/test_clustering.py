import random

import numpy as np
import pytest

from cinderlog.operators import clustering as cl


def dense(texts):
    start, term, weight = cl.tfidf(texts)
    x = np.zeros((len(texts), (term.max() + 1) if len(term) else 1))
    x[np.repeat(np.arange(len(texts)), np.diff(start)), term] = weight
    return x


def test_neighbours_are_those_at_that_distance():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "x"]) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    x = dense(texts)
    near = cl.neighbours(*cl.tfidf(texts), 0.5)
    for i in range(len(texts)):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert near[i].tolist() == np.flatnonzero(far <= 0.5 + 1e-9).tolist()
    assert all(abs(np.linalg.norm(r) - 1) < 1e-9 or not r.any() for r in x)


def test_clusters_and_noise():
    texts = ["open file now"] * 6 + ["close door fast"] * 5 + ["rare thing"] * 2 + ["other"]
    got = cl.cluster_texts(texts)
    assert got == [0] * 6 + [1] * 5 + [2, 2, 3]
    assert cl.cluster_texts([]) == [] and cl.cluster_texts([""]) == [0]


def test_chunks_of_lines(spark):
    df = spark.createDataFrame([(i, f"open file {i}" if i % 2 else f"close door /x{i}") for i in range(40)], "ord long, log string")
    got = cl.cluster_lines(df, chunk=20).collect()
    assert len(got) == 40
    for chunk in (0, 1):
        here = {r.ord % 2: {x.cluster for x in got if x.chunk == chunk and x.ord % 2 == r.ord % 2} for r in got}
        assert all(len(x) == 1 for x in here.values()) and here[0] != here[1]


def test_samples():
    texts = ["aa bb", "aa bb", "aa cc", "dd ee", "aa bb cc"]
    assert set(cl.sample_texts(texts, 2)) >= {"dd ee"} or "dd ee" in cl.sample_texts(texts, 2)
    assert len(cl.sample_texts(texts, 3, "random")) == 3 and cl.sample_texts(texts, 9) == ["aa bb", "aa cc", "dd ee", "aa bb cc"]
    assert "dd ee" not in cl.sample_texts(texts, 2, "similar")
    with pytest.raises(ValueError):
        cl.sample_texts(texts, 1, "none")
