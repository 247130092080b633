import random

import pytest

from cinderlog.operators import asking, clustering
from cinderlog.operators.asking import TemplateCache


def test_cache_finds_the_template_that_says_the_most():
    c = TemplateCache()
    for t, line in (("user <*> in", "user bob in"), ("user <*>", "user bob"), ("user root in", "user root in"), ("job <*> took <*> ms", "job a took 5 ms")):
        c.add(t, line)
    find = lambda line: None if (k := c.match(line)) is None else c.templates[k]
    assert find("user eve in") == "user <*> in" and find("user root in") == "user root in"
    assert find("user eve") == "user <*>" and find("job x took 17 ms") == "job <*> took <*> ms"
    assert find("job x y took 17 ms") == "job <*> took <*> ms" and find("job x y z took 17 ms") is None  # one word more
    assert find("else") is None and find("") is None
    assert c.add("<*>") == -1 and c.add("") == -1 and c.add("user <*>") == 1


def test_cache_merges_templates_that_are_alike():
    c = TemplateCache()
    a = c.add("the link to host alpha port <*> is now up again today", "")
    assert c.add("the link to host beta port <*> is now up again today", "") == a
    assert c.templates == ["the link to host <*> port <*> is now up again today"]
    assert c.match("the link to host gamma port 9 is now up again today") == a
    assert c.add("the link is up", "") == 1 and c.add("quite another one", "") == 2


def test_many_wildcards_take_linear_time():
    c = TemplateCache()
    c.add(" ".join(["a <*>"] * 40) + " z")
    assert c.match(" ".join(["a b"] * 2000)) is None


def test_variables_to_show():
    assert asking.variables_of("a 1 b (c)", "a <*> b <*>") == ["1", "(c)"] and asking.variables_of("x", "a <*>") == []
    known = asking.remembered(["12", "abc", "(x-1)", "[a9]", "a b c d", "x-1", ""], [])
    assert known == ["x-1", "a9"]
    assert asking.shown_variables(known) == known
    many = [f"h{i}.org" for i in range(9)] + ["a-1", "1:2", "x@y", "/a/b", "7%"]
    assert len(asking.shown_variables(many)) == 5


def test_asks_again_until_it_works():
    calls, waits = [], []

    def flaky(lines, variables):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "`x`"

    assert asking.patient(flaky, wait=lambda n: waits.append(n) or 0)([], []) == "`x`" and waits == [0, 1]
    with pytest.raises(OSError):
        asking.patient(lambda a, b: (_ for _ in ()).throw(OSError), attempts=2, wait=lambda n: 0)([], [])


LINES = [f"user u{i % 7} logged in from 10.0.0.{i}" for i in range(60)] + [f"disk sd{c} is full" for c in "abcdefgh"] + [f"fan {i} stopped" for i in range(9)] + [None, "", "lonely line"]


@pytest.mark.parametrize("method", ["dbscan", "mean_shift", "hierarchical"])
def test_mining_by_asking(spark, method):
    asked = []

    def model(lines, variables):
        asked.append(lines)
        words = [x.split() for x in lines]
        if len({len(w) for w in words}) > 1:
            raise RuntimeError("mixed")
        return "It is `" + " ".join(a if len({w[k] for w in words}) == 1 and not any(c.isdigit() for c in a) else "{{x}}" for k, a in enumerate(words[0])) + "`."

    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "id long, log string")
    out, counts, cache, metrics = asking.mine_by_asking(df, model, method=method)
    got = {r.id: r.template for r in out.collect()}
    assert len(got) == len(LINES) and len({got[i] for i in range(60)}) == 1 and "<*>" in got[0]
    assert got[len(LINES) - 1] == "lonely line" and got[len(LINES) - 2] == got[len(LINES) - 3] == ""
    assert all(got[i] == "fan <*> stopped" for i in range(68, 77))
    assert sum(r.occurrences for r in counts.collect()) == len(LINES) == metrics.lines
    assert metrics.questions == len(asked) and metrics.templates == counts.count() and metrics.describe()["keys"] == metrics.keys
    # Lines that known templates fit need no question.
    asked.clear()
    again = asking.mine_by_asking(df.where("id < 60"), model, known=cache, method=method)[3]
    assert not asked and again.hits == again.keys


def test_answers_that_fail_or_do_not_fit_leave_lines_to_the_rules(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "id long, log string")
    for answer in (lambda a, b: "`no such line`", lambda a, b: "", lambda a, b: 1 / 0):
        out, _, _, metrics = asking.mine_by_asking(df, answer, rounds=2)
        assert out.count() == len(LINES)
    assert asking.mine_by_asking(df, lambda a, b: "", most_asked=0)[3].by_rules > 0
    assert asking.mine_by_asking(df.limit(0), lambda a, b: "")[3].lines == 0


def test_mean_shift_and_samples():
    rng = random.Random(1)
    texts = [" ".join(["red", "green", "blue", rng.choice(["one", "two"])]) for _ in range(10)] + ["quite other words here"] * 4
    labels = clustering.mean_shift(texts, 1.0)
    assert len(set(labels[:10])) == 1 and len(set(labels)) == 2 and clustering.mean_shift([]) == []
    groups = clustering.balanced_groups(clustering.vectors(list(dict.fromkeys(texts)) + [f"w{i} x{i}" for i in range(8)]), 3)
    assert sorted(sum(groups, [])) == list(range(11)) and max(map(len, groups)) <= 3
    pairs = clustering.examples({"a <*>": ["a 1", "a 2", "a 3"], "b <*>": ["b 1"]}, 3)
    assert [t for _, t in pairs] == ["a <*>", "b <*>", "a <*>"] and len(set(pairs)) == 3
    assert clustering.nearest_examples("disk full again", [("user in", "u"), ("disk full", "d"), ("fan", "f")], 1) == [("disk full", "d")]
