import json
import random
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from cinderlog.functions.text import as_number, number_text, ruzicka
from cinderlog.functions.timestamps import to_seconds
from cinderlog.operators import header as h
from cinderlog.operators import jsonlog, mining
from cinderlog.operators.templates import TemplateError, Templates, parse_templates, parse_tree


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def utc(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


def test_timestamps(spark):
    cases = {
        None: 0,
        "": 0,
        "nonsense": 0,
        "1642723741": 1642723741,
        "1642723741.072": 1642723741,
        "1642723741072": 1642723741,
        "1642723741072000": 1642723741,
        "1642723741072000123": 1642723741,
        "100000000000": 100000000000,
        "20260304": 20260304,
        "2026-03-04": utc(2026, 3, 4),
        "2026-03-04T14:18:00": utc(2026, 3, 4, 14, 18),
        "2026-03-04T14:18:00Z": utc(2026, 3, 4, 14, 18),
        "2026-03-04T14:18:00.123456+02:00": utc(2026, 3, 4, 12, 18),
        "2026-03-04 14:18:00,123": utc(2026, 3, 4, 14, 18),
        "2026/03/04 14:18:00": utc(2026, 3, 4, 14, 18),
        "10/Oct/2000:13:55:36 -0700": utc(2000, 10, 10, 20, 55, 36),
        "10/Oct/2000:13:55:36": utc(2000, 10, 10, 13, 55, 36),
        "Mar  4 14:18:00": utc(2020, 3, 4, 14, 18),
        "10:39:55": utc(1900, 1, 1, 10, 39, 55),
        "Wednesday, March 4, 2026 14:18:00": utc(2026, 3, 4, 14, 18),
        "2026-13-04": 0,
    }
    got = column(spark, list(cases), lambda x: to_seconds(x, year=F.lit(2020)))
    assert dict(zip(cases, got, strict=True)) == cases


def test_an_explicit_format_comes_first_and_falls_through(spark):
    got = column(spark, ["04.03.26 14:18", "1642723741", "x"], lambda x: to_seconds(x, "%d.%m.%y %H:%M"))
    assert got == [utc(2026, 3, 4, 14, 18), 1642723741, 0]


def test_numbers(spark):
    assert column(spark, ["1", " 2.5 ", "1d", "1_0", "1e3", "", "inf", None, "-.5", "5."], as_number) == [1.0, 2.5, None, None, 1000.0, None, float("inf"), None, -0.5, 5.0]
    assert column(spark, [1.0, 2.5, -3.0], number_text, "double") == ["1", "2.5", "-3"]


def test_headers(spark):
    rows = ["type=A msg=audit(12.5:7): k=(v) [x]", "other", "type=é msg=audit(1): "]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "ord long, log string")
    got = [r.asDict() for r in h.parse_header(df, h.FORMATS["audit"], clock=F.lit(0)).orderBy("ord").collect()]
    assert got[0]["logFormatVariables"] == {"Type": "A", "Time": "12.5:7", "Content": "k=(v) [x]"}
    assert (got[1]["logFormatVariables"], got[1]["content"]) == ({"Time": "0"}, "other")
    assert (got[2]["logFormatVariables"]["Type"], got[2]["content"], got[2]["parsedLogID"]) == ("é", "", "CoreParser_12")
    assert h.parse_header(df, None).first().logFormatVariables == {"Time": "0"}
    timed = h.parse_header(df, "type=<Type> msg=audit(<Time>:<L>): <Content>", "%Y-%m-%d").orderBy("ord").first()
    assert timed.logFormatVariables["Time"] == "12"


def brute_match(line, t):
    squeezed = re.sub(r"\s+", " ", line.strip())
    plain = t.plain(squeezed)
    last = t.last()
    for i, start, least in t.order():
        m = re.match("(.*?)".join(map(re.escape, t.raw[i].split("<*>"))) + r"\Z", squeezed)
        if plain.startswith(start) and len(plain) >= least and m:
            return last[t.raw[i]], t.raw[i], list(m.groups())
    return -1, "<Not Found>", []


@pytest.mark.parametrize("options", [{}, {"remove_spaces": False}, {"remove_punctuation": False, "lowercase": False}])
def test_templates_native_udf_and_brute_force_agree(spark, options):
    rng = random.Random(1)
    t = Templates.of(["open <*> by <*>", "<*> done", "open <*>", "a.b[<*>] é=<*>", "open <*>", "x"], **options)
    parts = ["open ", "done", " by ", "a.b[", "] é=", "Q", " ", "\t", "7", "x", "Open "]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(300)] + ["open f by me", "a.b[1] é=2"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "ord long, content string")
    want = [brute_match(x, t) for x in lines]
    for native in (True, False):
        got = parse_templates(df, t, native=native).orderBy("ord").collect()
        assert [(r.EventID, r.template, r.variables) for r in got] == want
    assert parse_tree(df, ["nothing"]).first().template == "template not found"


def test_named_templates_and_files(tmp_path):
    t = Templates.of(["user <name> from <ip>", "x <*>"], ["login", None])
    assert t.raw == ["user <*> from <*>", "x <*>"] and t.event("login") == 0 and t.position(0, "ip") == 1 and t.event("3") == 3
    for bad in (lambda: t.event("no"), lambda: t.position(0, "no"), lambda: Templates.of(["<*> <a>"])):
        with pytest.raises(TemplateError):
            bad()
    (tmp_path / "t.txt").write_text("a <*>\n\n b\n")
    (tmp_path / "t.csv").write_text("EventId,EventTemplate\nE,a <x>\n")
    (tmp_path / "bad.csv").write_text("a\nb\n")
    assert Templates.load(str(tmp_path / "t.txt")).raw == ["a <*>", "b"]
    assert Templates.load(str(tmp_path / "t.csv")).events == {"E": 0}
    for name in ("bad.csv", "t.xml"):
        (tmp_path / "t.xml").touch()
        with pytest.raises(TemplateError):
            Templates.load(str(tmp_path / name))
    with pytest.raises(FileNotFoundError):
        Templates.load(str(tmp_path / "none.txt"))


def test_json(spark):
    read = lambda value, time="time", content="message": jsonlog.read_object(json.dumps(value), time, content)
    assert read({"a": {"b": 1}, "c": [1, {"d": None}], "e": {}, "f": []})["fields"] == [("a.b", "1"), ("c.0", "1"), ("c.1.d", "None")]
    # Keys: an object's own first, then the last member's.
    assert jsonlog.named({"a": {"Time": 1}, "b": [{"mytime": 2}]}, "time") == (("b", 0, "mytime"), 2)
    assert jsonlog.named({"x": {"time": 1}, "UpTime": 2}, "time") == (("UpTime",), 2)
    assert read({"times": {"message": "m", "x": 1}, "y": [{"message": "n"}]}) == {"time": "{'message': 'm', 'x': 1}", "content": "n", "fields": []}
    assert read({"a.b": 1, "a": {"b": 2}})["fields"] == [("a.b", "1")]
    assert jsonlog.read_object("[" * 100_000, "time", "message") is None and jsonlog.read_object(None, "time", "message") is None
    assert read("text") == {"time": None, "content": None, "fields": [("", "text")]}
    logs = [json.dumps({"ts_time": "2026-03-04T00:00:00Z", "message": "user bob in", "a": {"b": True, "n": None}}), json.dumps({"q": 1}), "broken", json.dumps({"message": "zzz", "time": 5})]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "ord long, log string")
    got = jsonlog.parse_json(df, Templates.of(["user <*> in"])).orderBy("ord").collect()
    assert [(r.EventID, r.template, r.variables) for r in got] == [(0, "user <*> in", ["bob"]), (0, "", []), (-1, "<Not Found>", [])]
    assert got[0].logFormatVariables == {"a.b": "True", "a.n": "None", "Time": str(utc(2026, 3, 4))}
    assert got[1].logFormatVariables == {"q": "1", "Time": "0"} and got[2].logFormatVariables == {"Time": "5"}


def test_mining(spark):
    cases = {
        "open /var/log/x.txt by root": "open <*> by <*>",
        "took 1234 ms, 5.6 KB": "took <*> ms, <*>",
        "conn 10.0.0.1:80 to host.a.b.com": "conn <*> to <*>",
        "x=true y=False": "x=<*> y=False",
        "plain text": "plain text",
    }
    assert column(spark, list(cases), mining.generalise, "string") == list(cases.values())
    answers = {"It is `user {{name}} on ${x}` I think `no`": "user <*> on <*>", "no ticks": "", "`<*> <*>`": "", "`a {{x}}\n b`": "a <*> b"}
    assert column(spark, list(answers), mining.answer_template, "string") == list(answers.values())
    lines = [f"user {i} logged in from 10.0.0.{i}" for i in range(1000, 1060)] + ["disk full"] * 3
    df = spark.createDataFrame([(x,) for x in lines], "log string")
    got = mining.mine(df).orderBy("EventId").collect()
    assert [(r.template, r.occurrences, r.EventId) for r in got] == [("user <*> logged in from <*>", 60, "E1"), ("disk full", 3, "E2")]
    nulls = mining.with_templates(spark.createDataFrame([(None,), ("",), ("17",)], "log string")).collect()
    assert [r.template for r in nulls] == [""] * 3
    assert column(spark, ["a=1 b c2 /x y(z)|Q", "12 3.5"], mining.words, "string") == [["a", "b", "y", "Q"], ["0 0"]]
    assert column(spark, ["<*> .", "a <*>"], mining.is_template) == [False, True]


def test_distance_of_count_vectors(spark):
    df = spark.createDataFrame([([1, 0, 2, 1], [1, 1, 1, 1]), ([], []), ([2], [0, 0, 1])], "a array<int>, b array<int>")
    assert [round(r.d, 6) for r in df.select(ruzicka(F.col("a"), F.col("b")).alias("d")).collect()] == [0.4, 0.0, 1.0]
