import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import detectors as d
from cinderlog.operators import sequences as s
from cinderlog.operators import stability as st
from cinderlog.operators.aggregation import concatenate
from cinderlog.operators.order import runs, sliding, tumbling, with_ordinal
from cinderlog.plans import lifecycle
from cinderlog.plans.config import ANY_EVENT, watched_variables

SCHEMA = "ord long, logID string, EventID int, template string, variables array<string>, logFormatVariables map<string,string>, log string"


def records(spark, rows):
    """rows: (EventID, variables, header)"""
    return spark.createDataFrame([(i, str(i), e, f"t{e}", v, h, f"log {i} Failed") for i, (e, v, h) in enumerate(rows)], SCHEMA)


def some(seed, n, letters="abcd"):
    rng = random.Random(seed)
    return [(rng.randint(0, 2), [rng.choice(letters) * rng.randint(1, 2) for _ in range(rng.randint(0, 3))], {"Level": rng.choice("xyz"), "Time": str(rng.randint(1, 9))} if rng.random() < 0.9 else {}) for _ in range(n)]


WATCH = [w for e in (0, 1, 2) for w in watched_variables(["var_0", "var_1", "Level"], e)] + watched_variables(["Level"], ANY_EVENT)


def picked(e, v, h):
    out = [(str(e), f"var_{i}", v[i]) for i in (0, 1) if i < len(v)]
    if "Level" in h:
        out += [(str(e), "Level", h["Level"]), (ANY_EVENT, "Level", h["Level"])]
    return out


def key(event, name):
    return f"Global - {name}" if event == ANY_EVENT else f"EventID {event} - {name}"


def found(alerts):
    return {r.ord: (r.score, r.alertsObtain) for r in alerts.collect()}


def expected(test, message):
    out = {}
    for i, row in enumerate(test):
        hits = {key(e, n): m for e, n, v in picked(*row) if (m := message(e, n, v))}
        if hits:
            out[i] = (float(len(hits)), hits)
    return out


def test_values_charsets_and_ranges_against_a_sequential_rule(spark):
    train, test = some(1, 60, "ab"), some(2, 80, "abcde")
    seen = defaultdict(set)
    for row in train:
        for e, n, v in picked(*row):
            seen[e, n].add(v)
    a, b = records(spark, train), records(spark, test)
    got = found(d.NewValue("N", WATCH).fit(a).transform(b))
    assert got == expected(test, lambda e, n, v: f"Unknown value: '{v}'" if (e, n) in seen and v not in seen[e, n] else None)
    chars = {k: set("".join(v)) for k, v in seen.items()}
    unknown = lambda e, n, v: sorted(set(v) - chars[e, n]) if (e, n) in chars else []
    got = found(d.Charset("C", WATCH).fit(a).transform(b))
    assert got == expected(test, lambda e, n, v: "Unknown character(s): " + ", ".join(f"'{c}'" for c in u) if (u := unknown(e, n, v)) else None)

    numbers = [(e, [str(len(x) * 3) if i else x + "1" for i, x in enumerate(v)], h) for e, v, h in train]
    more = [(e, [str(len(x) * 4.5) if i else x for i, x in enumerate(v)], h) for e, v, h in test]
    got = found(d.ValueRange("R", WATCH).fit(records(spark, numbers)).transform(records(spark, more)))
    ranges = defaultdict(list)
    for row in numbers:
        for e, n, v in picked(*row):
            if v.isdigit():
                ranges[e, n].append(float(v))
    text = lambda x: str(int(x)) if x == int(x) else str(x)

    def outside(e, n, v):
        r = ranges.get((e, n))
        if r and v.replace(".", "").isdigit() and not min(r) <= float(v) <= max(r):
            return f"Out of range value: '{text(float(v))}' ({text(min(r))} - {text(max(r))})"
        return None

    assert got == expected(more, outside)
    with pytest.raises(Exception, match="not a number"):
        d.ValueRange("R", WATCH, strict=True).fit(records(spark, train)).model.collect()


def test_bigrams(spark):
    watch = watched_variables(["var_0"], 0)
    det = d.BigramFrequency("B", watch).fit(records(spark, [(0, [x], {}) for x in ("ab", "ac", "ad", "ab")]))
    assert {(r.a, r.b): r.n for r in det.model.collect() if r.a == "a"} == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 1}
    twice = d.BigramFrequency("B", watch, double=True).fit(records(spark, [(0, [x], {}) for x in ("ab", "ac", "ad")]))
    assert {(r.a, r.b): r.n for r in twice.model.collect() if r.a == "a"} == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 2}
    got = found(det.transform(records(spark, [(0, ["ab"], {}), (0, ["zz"], {}), (1, ["zz"], {})])))
    assert list(got) == [1] and got[1][0] == 1.0 and "critical_val 0.0 and threshold 0.05" in got[1][1]["EventID 0 - var_0"]
    usual = spark.createDataFrame([("z", "z", 1), ("", "z", 1), ("z", "", 1)], "a string, b string, n long")
    det.defaults = usual
    assert found(det.transform(records(spark, [(0, ["zz"], {})]))) == {}


def test_events_combinations_rules_and_chance(spark):
    train, test = some(3, 30, "ab"), some(4, 60, "abc") + [(7, ["x"], {"Level": "ERROR"})]
    a, b = records(spark, train), records(spark, test)
    got = found(d.NewEvent("E", watched_variables(["var_0"], 7)).fit(a).transform(b))
    assert got == {60: (1.0, {"EventID 7 - {'var_0': 'x'}": "Unknown event ID: '7'"})}
    assert len(found(d.NewEvent("E", watched_variables(["Level"], ANY_EVENT), compat_global=True).fit(a).transform(b))) == 61
    watch = watched_variables(["var_0", "var_1"], 0)
    pairs = {tuple(v[:2]) for e, v, _ in train if e == 0 and len(v) > 1}
    got = found(d.NewValueCombo("K", watch).fit(a).transform(b))
    single = {tuple(v[:1]) for e, v, _ in train if e == 0 and len(v) == 1}
    want = {i for i, (e, v, _) in enumerate(test) if e == 0 and (len(v) > 1 and tuple(v[:2]) not in pairs or len(v) == 1 and tuple(v) not in single)}
    assert set(got) == want
    rules = found(d.Rules("R", []).transform(b.withColumn("EventID", F.when(F.col("ord") == 0, -1).otherwise(F.col("EventID")))))
    assert rules[0][0] == 2.0 and rules[1] == (1.0, {"R003 - CheckForExceptions": "Found word 'fail' in the logs"}) and rules[60][0] == 2.0
    with pytest.raises(d.RuleNotFound):
        d.Rules("R", [], rules=(("R999", ()),)).transform(b)
    assert found(d.Random("X", WATCH, threshold=1.0).transform(b)) == {} and len(found(d.Random("X", WATCH, threshold=-1.0).transform(b))) > 50
    assert d.coverage(d.NewValue("N", watch).fit(a).model, watched_variables(["var_9"], 9) + watch, a) == (["9"], [])


def test_alert_envelope(spark):
    rows = records(spark, [(0, ["a"], {"Time": "2026-03-04T00:00:00Z"}), (0, ["b"], {}), (0, ["c"], {})])
    alerts = d.NewValue("N", watched_variables(["var_0"], 0)).fit(rows.limit(1)).transform(rows.where("ord > 0")).orderBy("ord").collect()
    assert [(r.alertID, r.logIDs, r.extractedTimestamps, r.detectorType) for r in alerts] == [("N_10", ["1"], [0], "new_value_detector"), ("N_11", ["2"], [0], "new_value_detector")]


def test_windows(spark):
    df = spark.range(23).withColumnRenamed("id", "ord").withColumn("x", F.col("ord") * 2)
    got = {r.window: [y.x for y in r.records] for r in sliding(df, 4, "x").collect()}
    assert got == {k: [2 * i for i in range(k, k + 4)] for k in range(20)}
    assert {r.window: len(r.records) for r in tumbling(df, 5).collect()} == dict.fromkeys(range(4), 5)
    assert {r.window: len(r.records) for r in tumbling(df, 5, flush=True).collect()} == {**dict.fromkeys(range(4), 5), 4: 3}
    with pytest.raises(ValueError):
        sliding(df, 0)
    placed = with_ordinal(df.select((-F.col("ord")).alias("k")), "k").collect()
    assert {r.k: r.ord for r in placed} == {-i: 22 - i for i in range(23)}
    series = spark.createDataFrame([(i, v) for i, v in enumerate("aabbbac")], "ord long, v string")
    assert sorted((r.start, r.v, r.n) for r in runs(series, "v").collect()) == [(0, "a", 2), (2, "b", 3), (5, "a", 1), (6, "c", 1)]


def test_sequence_detectors(spark):
    cycle = records(spark, [([0, 1, 4, 0][i % 4], [], {}) for i in range(60)])
    odd = records(spark, [([0, 1, 4, 0][i % 4] if i < 20 else 3, [], {}) for i in range(24)])
    for det in (s.EventSequence("S", 3), s.CountVectors("V", 3), s.NearCountVectors("N", 3), s.NextEvent("D", 3), s.MaskedEvents("M", 3, share=1.0)):
        got = {r.ord for r in det.fit(cycle).transform(odd).collect()}
        assert got and min(got) >= 20, det
        assert det.transform(cycle).count() == 0
    assert s.choose_length(records(spark, [(5, [], {})] * 30)) == 10
    assert s.choose_length(records(spark, [(i, [], {}) for i in range(30)])) is None
    assert s.grid_search(lambda size: s.EventSequence("S", size), {"size": [3, 4]}, cycle, cycle) == ({"size": 3}, 0.0)


def test_count_vectors_and_their_threshold(spark):
    events = spark.createDataFrame([([0, 1, 4, 0],), ([-1, 2],)], "e array<int>")
    assert [r.v for r in events.select(s.count_vector(F.col("e")).alias("v")).collect()] == [[0, 2, 1, 0, 0, 1], [1, 0, 0, 1]]
    det = s.NearCountVectors("N", 3)
    det.model = spark.createDataFrame([([1, 0, 2, 1],), ([1, 2, 1, 0],), ([0, 1, 4, 0],)], "vector array<int>")
    got = det.distances(spark.createDataFrame([([1, 1, 1, 1],), ([0, 0, 0, 1],)], "vector array<int>")).collect()
    assert round(sum(r.distance for r in got) / 2, 6) == 0.575


def series(spark, values, times=None):
    times = times or list(range(len(values)))
    return spark.createDataFrame([("0", "v", i, v, float(t)) for i, (v, t) in enumerate(zip(values, times, strict=True))], "event string, name string, ord long, value string, t double")


def test_stability_of_known_series(spark):
    cases = {
        "divergent": ([*"abc"] + ["c"] * 37, [0, 30, 60] + [90 + 0.001 * i for i in range(37)], [0.3, 0, 0, 0], [1, 1, 1, 0]),
        "churn": ([str(i) for i in range(30)] + ["29"] * 10, [*range(30)] + [100 + 100 * i for i in range(10)], [1, 1, 1, 0], [0.9375, 0, 0, 0]),
        "agree": (["a", "b"] + ["b"] * 38, [*range(40)], [0.2, 0, 0, 0], [0.2, 0, 0, 0]),
    }
    for name, (values, times, count, time) in cases.items():
        flags = st.value_changes(series(spark, values, times))
        for mode, want in (("count", count), ("time", time)):
            r = st.segment_means(flags, mode=mode, time="t").first()
            assert [round(r[f"m{k}"], 4) for k in range(4)] == want, (name, mode)
    late = st.segment_means(st.value_changes(series(spark, list("abcd") * 3, [5, 4] + [9] * 10)), mode="time", time="t").first()
    assert [late[f"m{k}"] for k in range(4)] == [1, 1 / 3, 0, 0]
    kinds = {"aa": st.SHORT, "aaa": st.STATIC, "abc": st.RANDOM, "a" * 40 + "b": st.UNSTABLE}
    for values, want in kinds.items():
        assert st.classify(st.value_changes(series(spark, list(values)))).first()["class"] == want
    assert st.classify(st.range_changes(series(spark, ["1", "x", "3", "2", "2", "2", "2", "2", "2"]))).first()["class"] == st.STABLE
    assert st.classify(st.charset_changes(series(spark, ["ab", "c", "ba", "ab", "a", "a", "a", "a"]))).first()["class"] == st.STABLE


def test_cuts_of_equal_counts_in_blocks(spark):
    rng = random.Random(5)
    rows = [("0", name, o, "v") for name in "pqr" for o in rng.sample(range(500), {"p": 1, "q": 7, "r": 333}[name])]
    df = spark.createDataFrame(rows, "event string, name string, ord long, value string")
    got = {r.name: (r.c1, r.c2, r.c3) for r in st.count_cuts(df, "event", "name", block=16).collect()}
    for name in "pqr":
        own = sorted(o for _, x, o, _ in rows if x == name)
        assert got[name] == tuple(own[k * len(own) // 4] for k in (1, 2, 3))


def test_lifecycle_and_auto_configuration(spark):
    rows = [(0, ["k" if i < 90 else f"n{i}", str(i)], {"Level": "ab"[i % 2]}) for i in range(100)]
    parsed = records(spark, rows)
    det = d.NewValue("A", [])
    got = found(lifecycle.run(det, parsed, configure=40, train=40, auto=lifecycle.choose_variables))
    assert {w.name for w in det.watched} >= {"var_0", "Level"} and "var_1" not in {w.name for w in det.watched}
    assert set(got) == set(range(90, 100))
    phases = {r.phase: r.n for r in lifecycle.with_phase(parsed, 10, 20, size=3).groupBy("phase").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert phases == {None: 2, "configure": 10, "train": 20, "detect": 68}
    windowed = lifecycle.run(s.EventSequence("S", 3), records(spark, [(i % 3 if i < 50 else 9, [], {}) for i in range(60)]), train=20)
    assert {r.ord for r in windowed.collect()} == set(range(50, 60))
    assert lifecycle.run(d.NewValue("N", WATCH), parsed).count() == 0
    pairs = records(spark, [(0, ["ab"[i % 2], "cd"[i % 2], str(i)], {}) for i in range(40)])
    chosen = lifecycle.choose_combinations(pairs, 3)
    assert {(w.instance, w.name) for w in chosen} == {("var_0_var_1", "var_0"), ("var_0_var_1", "var_1")}


def test_aggregation_slides(spark):
    rows = records(spark, [(0, [x], {"Time": "7"}) for x in "abcde"])
    alerts = d.NewValue("N", watched_variables(["var_0"], 0)).fit(rows.limit(1)).transform(rows.where("ord > 0"))
    got = concatenate(alerts, 3, clock=F.lit(0)).orderBy("window").collect()
    assert [r.logIDs for r in got] == [["1", "2", "3"], ["2", "3", "4"]] and got[0].alertIDs == ["N_10", "N_11", "N_12"]
    assert got[0].extractedTimestamps == [7, 7, 7] and got[0].alertsObtain == {}
    assert concatenate(alerts, 2, slide=False).count() == 2
