"""Clustering of log lines by their words, a chunk of lines at a time, and choice of samples from a cluster.

Within a chunk (lines in a row, `chunk` at most, so what a task holds is bounded) different word lists are weighed by
TF-IDF, those at cosine distance eps-equivalent or less are neighbours, and density-based clustering joins them; noise with
equal words shares a cluster. Chunks are clustered side by side.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.operators.mining import words
from cinderlog.runtime import on_workers

CHUNK, EPS, LEAST = 30_000, 0.5, 5
_TOKEN = re.compile(r"(?u)\b\w\w+\b")


def tfidf(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, term, weight) of unit vectors, row by row: counts times ln((1 + n) / (1 + df)) + 1, words of two or more
    characters, lower case."""
    ids: dict[str, int] = {}
    rows = []
    for text in texts:
        count: dict[int, int] = {}
        for w in _TOKEN.findall(text.lower()):
            t = ids.setdefault(w, len(ids))
            count[t] = count.get(t, 0) + 1
        rows.append(count)
    df = np.bincount([t for r in rows for t in r], minlength=len(ids))
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    start = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    term = np.fromiter((t for r in rows for t in r), np.int64, start[-1])
    weight = np.fromiter((c for r in rows for c in r.values()), float, start[-1]) * idf[term]
    norm = np.sqrt(np.bincount(np.repeat(np.arange(len(rows)), np.diff(start)), weight**2, len(rows)))
    return start, term, weight / np.repeat(np.maximum(norm, 1e-300), np.diff(start))


def neighbours(start: np.ndarray, term: np.ndarray, weight: np.ndarray, eps: float) -> list[np.ndarray]:
    """For each row, the rows at Euclidean distance eps or less, itself included; found through shared terms."""
    n = len(start) - 1
    order = np.argsort(term, kind="stable")
    row = np.repeat(np.arange(n), np.diff(start))[order]
    at = np.searchsorted(term[order], np.arange((term.max() if len(term) else -1) + 2))
    w = weight[order]
    empty = np.flatnonzero(np.diff(start) == 0)
    out = []
    for i in range(n):
        dot = np.zeros(n)
        for k in range(start[i], start[i + 1]):
            lo, hi = at[term[k]], at[term[k] + 1]
            dot[row[lo:hi]] += weight[k] * w[lo:hi]
        near = empty if start[i] == start[i + 1] else np.flatnonzero(2 - 2 * dot <= eps * eps + 1e-12)
        out.append(near)
    return out


def dbscan(near: list[np.ndarray], copies: np.ndarray, least: int) -> np.ndarray:
    """Cluster of each row, -1 for noise. A row counts as often as it occurs."""
    dense = np.array([copies[x].sum() >= least for x in near], bool)
    label = np.full(len(near), -1)
    made = 0
    for i in range(len(near)):
        if label[i] >= 0 or not dense[i]:
            continue
        label[i], todo = made, [i]
        while todo:
            for j in near[todo.pop()]:
                if label[j] < 0:
                    label[j] = made
                    if dense[j]:
                        todo.append(j)
        made += 1
    return label


def cluster_texts(texts: list[str], eps: float = EPS, least: int = LEAST) -> list[int]:
    """Cluster of each text; texts that are noise share one with equal texts, numbered after the others."""
    first: dict[str, int] = {}
    place = [first.setdefault(t, len(first)) for t in texts]
    copies = np.bincount(place, minlength=len(first))
    label = dbscan(neighbours(*tfidf(list(first)), eps), copies, least)
    made = label.max() + 1 if len(label) else 0
    for i in range(len(label)):
        if label[i] < 0:
            label[i] = made
            made += 1
    return [int(label[p]) for p in place]


def vectors(texts: list[str]) -> np.ndarray:
    """The TF-IDF vectors, one a row."""
    start, term, weight = tfidf(texts)
    x = np.zeros((len(texts), (term.max() + 1) if len(term) else 1))
    x[np.repeat(np.arange(len(texts)), np.diff(start)), term] = weight
    return x


def mean_shift(texts: list[str], width: float = EPS, rounds: int = 300) -> list[int]:
    """Cluster of each text by mean shift with a flat kernel: each different text climbs to the mean of all texts within
    `width` of it; ends nearer than `width` are one, the one with the most texts about it."""
    first: dict[str, int] = {}
    place = [first.setdefault(t, len(first)) for t in texts]
    x, copies = vectors(list(first)), np.bincount(place, minlength=len(first))
    if not len(x):
        return []

    def about(points: np.ndarray) -> np.ndarray:
        return ((points * points).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * points @ x.T <= width * width + 1e-12) * copies

    ends = x.copy()
    for _ in range(rounds):
        near = about(ends)
        moved = near @ x / near.sum(1, keepdims=True)
        if np.abs(moved - ends).max() < 1e-3 * width:
            break
        ends = moved
    weight, peaks = about(ends).sum(1), []
    for k in np.lexsort((np.arange(len(x)), -weight)):
        if all(np.linalg.norm(ends[k] - ends[p]) >= width for p in peaks):
            peaks.append(k)
    label = ((x * x).sum(1)[:, None] - 2 * x @ ends[peaks].T + (ends[peaks] ** 2).sum(1)[None]).argmin(1)
    return [int(label[p]) for p in place]


def cluster_lines(lines: DataFrame, line: str = "log", ordinal: str = "ord", chunk: int = CHUNK, eps: float = EPS, least: int = LEAST, method: str = "dbscan") -> DataFrame:
    """(ord, chunk, cluster) of every line. method: dbscan, or mean_shift, whose vectors are held in full: a chunk of some
    thousand different lines at most."""
    if method not in ("dbscan", "mean_shift"):
        raise ValueError(f"method: {method}")
    on_workers(lines.sparkSession)

    def chunks(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        texts = frame["text"].tolist()
        return pd.DataFrame({"ord": frame["ord"], "chunk": frame["chunk"], "cluster": cluster_texts(texts, eps, least) if method == "dbscan" else mean_shift(texts, eps)})

    rows = lines.select(F.col(ordinal).cast("long").alias("ord"), F.floor(F.col(ordinal) / chunk).alias("chunk"), F.array_join(words(F.coalesce(F.col(line), F.lit(""))), " ").alias("text"))
    return rows.groupBy("chunk").applyInPandas(chunks, "ord long, chunk long, cluster int")


def diverse(texts: list[str], k: int) -> list[int]:
    """Places of k texts that differ the most: greedily, the one whose vector has the largest part outside the span of those
    chosen (the determinant of their similarities grows the most). Ties to the first."""
    x = vectors(texts)
    left, chosen = (x * x).sum(1), []
    basis = np.zeros((0, x.shape[1]))
    for _ in range(min(k, len(texts))):
        left[chosen] = -1.0
        best = int(np.argmax(left.round(12)))
        chosen.append(best)
        v = x[best] - basis.T @ (basis @ x[best])
        if (norm := np.linalg.norm(v)) > 1e-9:
            basis = np.vstack((basis, v / norm))
            left = left - (x @ (v / norm)) ** 2
    return chosen


def balanced_groups(x: np.ndarray, size: int, rounds: int = 20) -> list[list[int]]:
    """Rows in groups of `size` at most that lie together: means that start at rows far from each other, then places given out
    by nearness, so that a row whose mean has no place left goes to the next nearest that has."""
    k = -(-len(x) // size)
    seeds = [0]
    for _ in range(k - 1):
        seeds.append(int(((x[:, None] - x[seeds][None]) ** 2).sum(2).min(1).argmax()))
    means = x[seeds]
    for _ in range(rounds):
        near = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
        moved = np.stack([x[near == g].mean(0) if (near == g).any() else means[g] for g in range(k)])
        if np.allclose(moved, means):
            break
        means = moved
    d = ((x[:, None] - means[None]) ** 2).sum(2)
    groups: list[list[int]] = [[] for _ in range(k)]
    placed = np.zeros(len(x), bool)
    for at in np.argsort(d.round(12), axis=None, kind="stable"):
        row, group = divmod(int(at), k)
        if not placed[row] and len(groups[group]) < size:
            groups[group].append(row)
            placed[row] = True
    return groups


def sample_texts(texts: list[str], k: int, method: str = "dpp", seed: int = 0) -> list[str]:
    """k different texts of a cluster: dpp (the most different), random, or similar (a group of texts that lie together)."""
    once = list(dict.fromkeys(texts))
    if len(once) <= k:
        return once
    if method == "dpp":
        chosen = diverse(once, k)
    elif method == "random":
        chosen = np.random.default_rng(seed).permutation(len(once))[:k].tolist()
    elif method == "similar":
        chosen = balanced_groups(vectors(once), k)[0]
    else:
        raise ValueError(f"method: {method}")
    return [once[i] for i in chosen]


def examples(groups: dict[str, list[str]], most: int, seed: int = 0) -> list[tuple[str, str]]:
    """(line, template) pairs to show a model: of each template's lines one by chance, in turn from the largest group on, until
    there are `most` or no lines are left."""
    rng = np.random.default_rng(seed)
    order = sorted(groups, key=lambda t: (-len(groups[t]), t))
    mixed = {t: [groups[t][i] for i in rng.permutation(len(groups[t]))] for t in order}
    turns = max(map(len, mixed.values()), default=0)
    return [(mixed[t][n], t) for n in range(turns) for t in order if n < len(mixed[t])][:most]


def nearest_examples(line: str, pairs: list[tuple[str, str]], k: int) -> list[tuple[str, str]]:
    """The k pairs whose lines are the most like this one, by TF-IDF; ties to the first."""
    x = vectors([line, *(p[0] for p in pairs)])
    order = np.argsort(-(x[1:] @ x[0]).round(12), kind="stable")
    return [pairs[i] for i in order[:k]]
