"""Stability by ranges, and auto-configuration, over all variables: held against plain Python over the same tables."""

import random

import duckdb
import pytest
from conftest import SF

from cinderlog.operators import stability as st
from cinderlog.plans import catalog


def log():
    """(event, {variable: value}) of each line, in order."""
    rows = duckdb.sql(f"""select event_type, user_id::varchar, cast(cast("value" as decimal(18,2)) as varchar), regexp_extract(props, '([0-9]+)', 1),
      epoch(date_trunc('second', ts))::bigint::varchar, event_id::varchar from '{SF}/events.parquet' order by event_id""").fetchall()
    return [(str(catalog.TYPES.index(t)), {"var_0": u, "var_1": v, "var_2": k, "Type": t, "Time": s, "Line": n}) for t, u, v, k, s, n in rows]


def verdict(flags, kinds):
    n = len(flags)
    parts = [flags[k * n // 4 : (k + 1) * n // 4] for k in range(4)]
    stable = all((sum(p) / len(p) if p else 0) < t for p, t in zip(parts, st.THRESHOLDS, strict=True))
    return st.SHORT if n < 3 else st.STATIC if kinds == 1 else st.RANDOM if kinds == n else st.STABLE if stable else st.UNSTABLE


def outside(xs):
    return [int(i == 0 or not min(xs[:i]) <= x <= max(xs[:i])) for i, x in enumerate(xs)]


def gathered(rows):
    out = {}
    for event, fields in rows:
        for name, value in fields.items():
            out.setdefault((event, name), []).append(value)
    return out


def test_range_changes_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, e, "a", str(rng.choice([rng.gauss(0, i + 1), 3]))) for i in range(200) for e in "xy" if rng.random() < 0.7]
    df = spark.createDataFrame([*rows, (7, "z", "a", "no"), (8, "z", "a", "1"), (99, "z", "a", "1")], "ord long, event string, name string, value string")
    got = {}
    for r in st.range_changes(df, block=16).orderBy("ord").collect():
        got.setdefault(r.event, []).append((r.changed, r.kinds))
    want = {e: [(c, 2) for c in outside([float(v) for _, x, _, v in rows if x == e])] for e in "xy"}
    assert got == want | {"z": [(1, 1), (0, 1)]}


def test_stability_range_classifies_all_numeric_series(spark):
    want = {}
    for (event, name), values in gathered(log()).items():
        if name != "Type":
            xs = [float(v) for v in values]
            want[event, name] = (len(xs), verdict(outside(xs), 1 if min(xs) == max(xs) else 2))
    assert {(r.event, r.name): (r.n, r["class"]) for r in catalog.stability_range(spark, SF).collect()} == want


def test_auto_new_value_watches_all_variables_chosen(spark):
    rows = log()
    n = len(rows)
    rows = [(e, f | {"Epoch": f"v{i * 4 // n}"}) for i, (e, f) in enumerate(rows)]
    watched = {s for s, v in gathered(rows[: n // 2]).items() if verdict([int(x not in v[:i]) for i, x in enumerate(v)], len(set(v))) in (st.STABLE, st.STATIC)}
    known = gathered(rows[: n // 2 + n // 4])
    want = {}
    for i in range(n // 2 + n // 4, n):
        event, fields = rows[i]
        if new := sorted(f"EventID {event} - {k}=Unknown value: '{v}'" for k, v in fields.items() if (event, k) in watched and v not in known[event, k]):
            want[i] = "; ".join(new)
    assert {r.ord: r.found for r in catalog.auto_new_value(spark, SF).collect()} == want
    assert watched - {s for s in watched if s[1] in ("Epoch", "Type", "Line")}


def test_auto_new_value_alerts_on_any_variable(spark, tmp_path):
    """User, value and k change by quarters, so they are as stable, and as new at the end, as the Epoch field."""
    duckdb.sql(f"""copy (select i event_id, timestamp '2024-01-01' + to_seconds(i) ts, 'view' event_type, i * 4 // 400 user_id, (i * 4 // 400)::double "value",
      '{{"k": ' || (i * 4 // 400) || '}}' props from range(400) t(i)) to '{tmp_path}/events.parquet'""")
    names = {"var_0": "3", "var_1": "3.00", "var_2": "3", "Epoch": "v3"}
    found = "; ".join(sorted(f"EventID 4 - {k}=Unknown value: '{v}'" for k, v in names.items()))
    assert {r.ord: r.found for r in catalog.auto_new_value(spark, str(tmp_path)).collect()} == {i: found for i in range(300, 400)}
