import re
from collections import defaultdict
from hashlib import md5

import duckdb
import pytest

from cinderlog.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size string"


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, text, source, *_ in rows:
        by[source].append((md5(("mix" + ("-" if i is None else str(i))).encode()).hexdigest()[:16], i is None, i or 0, size(text)))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(x[3] for x in by[s]) for s in order}
    left, capped = 1.5 * sum(total.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = left / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2.0 * total[s]
            left -= capped[s]
    out = []
    for s in order:
        target = capped.get(s, level * weight[s])
        budget, at = int(target + 0.5), 0
        passes, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for _, null, i, n in sorted(by[s]):
            out.append((None if null else i, n, total[s], round(target, 6), passes * n + max(0, min(n, rest - at))))
            at += n
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_against_brute_force(spark, n):
    names = ["b", "a", None, "é", "", "z"]
    rows = [(i if i % 11 else None, None if i % 13 == 5 else "w\tx " * (i * i % 29), names[(i * i) % 6 if i % 2 else 0], "en", 1, "s") for i in range(n)] + [(5, "one two", "a", None, None, None)] * (n // 3)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute(rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 0.5 for r in got)


def test_oracle(spark):
    from conftest import SF

    got = sorted(map(tuple, mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken").collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as from '{SF}/documents.parquet'")
    assert got == sorted(con.execute(mixing.ORACLE_SQL).fetchall())


def test_long_texts_and_clashing_names(spark):
    schema = "doc_id string, text string, source string, own string, times int, last string, many int, copy int, _copy int"
    rows = [("k" * 100_000, "w " * 500_000, "a", "o", 1, "l", 2, 3, 4), ("b", "one two", "b", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == set(rows)
    # The small source is read twice; the large one has the rest of 150 %.
    assert {r["size"]: r.taken for r in mixing.mix(docs).collect()} == {500_000: round(1.5 * 500_002) - 4, 2: 4}
