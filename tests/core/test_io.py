import json
import warnings

import pandas as pd
import pytest
import yaml
from pyspark.sql import functions as F

from cinderlog.operators import history
from cinderlog.operators.detectors import NewValue
from cinderlog.operators.templates import TemplateError, Templates
from cinderlog.plans import config as c
from cinderlog.plans.lifecycle import chain
from cinderlog.sources import readers, schemas, wire, writers
from cinderlog.streaming import scoring

ALERT = {"__version__": "1.0.0", "detectorID": "é", "alertID": "", "detectionTimestamp": 2**40, "logIDs": ["1", "2"], "score": 0.5, "extractedTimestamps": [0, 300, -1], "alertsObtain": {"a": "b", "": "c"}}


def test_wire_round_trip_and_public_format():
    got = wire.decode(wire.encode(ALERT, schemas.ALERT), schemas.ALERT)
    assert {k: v for k, v in got.items() if v is not None} == ALERT
    assert wire.encode({"__version__": "1.0.0", "logID": "7"}, schemas.LOG) == b"\n\x051.0.0\x12\x017"
    assert wire.decode(b"", schemas.LOG)["log"] is None and wire.decode(b"\x98\x06\x01", schemas.LOG)["logID"] is None
    assert wire.decode(wire.encode({"EventID": -1}, schemas.PARSED), schemas.PARSED)["EventID"] == -1
    for broken in (b"\n\x05a", b"\x80"):
        with pytest.raises(ValueError):
            wire.decode(broken, schemas.LOG)


def test_the_wire_form_is_what_protobuf_writes():
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    from google.protobuf import descriptor_pool, message_factory

    f = pb.FileDescriptorProto(name="x.proto", package="x", syntax="proto3")
    kinds = {"StringType()": (9, 1), "LongType()": (3, 1), "FloatType()": (2, 1)}
    m = f.message_type.add(name="M")
    plain = [x for x in schemas.ALERT if x.name != "alertsObtain"]
    for number, x in enumerate(schemas.ALERT, 1):
        if x in plain:
            kind, label = (9 if "String" in str(x.dataType) else 3, 3) if x.name.endswith("s") and x.name != "description" else kinds[str(x.dataType)]
            m.field.add(name=x.name.strip("_"), number=number, type=kind, label=label)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    given = {k: v for k, v in ALERT.items() if k != "alertsObtain"}
    theirs = message_factory.GetMessageClass(pool.FindMessageTypeByName("x.M"))(**{k.strip("_"): v for k, v in given.items()}).SerializeToString(deterministic=True)
    got = wire.decode(theirs, schemas.ALERT)
    assert {k: v for k, v in got.items() if v not in (None, {})} == {k: v for k, v in given.items() if v != ""}
    assert wire.encode({k: v for k, v in given.items() if v != ""}, schemas.ALERT) == theirs


def test_schemas(spark):
    df = spark.createDataFrame([("1", "x", 5)], "logID string, log string, other int")
    log = schemas.conform(df, schemas.LOG, "other")
    assert log.columns == ["other", "__version__", "logID", "log", "logSource", "hostname"] and log.first()["__version__"] == "1.0.0"
    assert log.select(schemas.is_complete(schemas.LOG).alias("c"), schemas.read_field(schemas.LOG, "hostname").alias("h")).first() == (False, "")
    full = schemas.conform(df.withColumns({"logSource": F.lit(""), "hostname": F.lit("")}), schemas.LOG)
    assert full.select(schemas.is_complete(schemas.LOG).alias("c")).first().c
    assert schemas.same_kind(full, schemas.conform(df, schemas.LOG)) and not schemas.same_kind(full, df)
    with pytest.raises(schemas.FieldNotFound):
        schemas.field(schemas.LOG, "nope")
    text = full.select(schemas.to_json_message(schemas.LOG).alias("j")).select("j", schemas.from_json_message(F.col("j"), schemas.LOG).alias("m"))
    assert text.select("m.*").first() == full.first()
    pair = full.select(F.struct("*").alias("a"), F.struct("*").alias("b"))
    assert pair.select(schemas.equal_messages("a", "b", schemas.LOG).alias("e")).first().e
    assert schemas.is_repeated(schemas.ALERT, "alertsObtain") and not schemas.is_repeated(schemas.ALERT, "score")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.log").write_text("  one \n\ntwo\nthree")
    logs = readers.read_log(spark, str(tmp_path / "a.log"), "src")
    assert [(r.ord, r.logID, r.log, r.logSource) for r in logs.orderBy("ord").collect()] == [(0, "0", "one", "src"), (1, "1", "", "src"), (2, "2", "two", "src"), (3, "3", "three", "src")]
    for kind in ("json", "yaml", "wire"):
        out = str(tmp_path / f"out.{kind}")
        writers.convert(spark, str(tmp_path / "a.log"), "log", lambda d: d.where("log <> ''"), out, kind)
        back = readers.read_any(spark, out, kind).orderBy("ord").collect()
        assert [(r.ord, r.logID, r.log) for r in back] == [(0, "0", "one"), (1, "2", "two"), (2, "3", "three")]
        writers.sink(logs.limit(1), out, kind, schemas.LOG)
        assert readers.read_any(spark, out, kind).count() == 4
    assert list(json.loads((tmp_path / "out.json").read_text())) == ["0", "1", "2", "3"]
    writers.sink(logs, str(tmp_path / "p"), "parquet", schemas.LOG)
    writers.write_json_lines(logs, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.json(str(tmp_path / "j")).count() == 4


def test_frames(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, "t2", ["x"], "host"), ("a", 1, "t1", [], None)], "Content string, EventIDs int, Templates string, ParamList array<string>, Node string")
    got = readers.from_frame(df, "Content").orderBy("ord").collect()
    assert [(r.ord, r.logID, r.log, r.EventID, r.variables, r.logFormatVariables) for r in got] == [(0, "0", "a", 1, [], {}), (1, "1", "b", 2, ["x"], {"Node": "host"})]
    assert readers.from_frame(df.drop("ParamList"), "Content").first().variables == []
    for data in (pd.DataFrame({"a": [1]}), {"a": [1]}, [{"a": 1}], df.select(F.lit(1).alias("a")).limit(1)):
        assert [r.a for r in readers.normalise(spark, data).collect()] == [1]
    with pytest.raises(ValueError):
        readers.normalise(spark, "text")
    (tmp_path / "s.csv").write_text("LineId,Content\n1,hello\n2,there\n")
    assert [r.log for r in readers.read_structured_csv(spark, str(tmp_path / "s.csv")).orderBy("ord").collect()] == ["hello", "there"]


CONFIG = """
detectors:
  N:
    method_type: new_value_detector
    params: {a: 1}
    events:
      login:
        one:
          variables: [{pos: who, name: user}, {pos: 1}]
          header_variables: [{pos: Level, params: {x: 2}}]
    global:
      g: {header_variables: [{pos: Type}]}
"""


def test_config():
    t = Templates.of(["user <who> from <ip>"], ["login"])
    got = c.component(c.load(CONFIG), "detectors", "N", "new_value_detector", {"a"}, t)
    assert got.params == {"a": 1}
    assert [(w.event, w.name, w.position) for w in got.watched] == [("0", "user", 0), ("0", "var_1", 1), ("0", "Level", None), ("*", "Type", None)]
    again = c.component(yaml.safe_load(c.dump(got)), "detectors", "N", "new_value_detector", {"a"})
    assert again == got
    for kind, name, method, error in (("x", "N", None, c.TypeNotFound), ("detectors", "M", None, c.MethodNotFound), ("detectors", "N", "other", c.MethodTypeMismatch)):
        with pytest.raises(error):
            c.component(c.load(CONFIG), kind, name, method, templates=t)
    with pytest.raises(c.ConfigError):
        c.component(c.load(CONFIG), "detectors", "N", allowed=set(), templates=t)
    with pytest.raises(TemplateError):
        c.component(c.load(CONFIG.replace("who", "whom")), "detectors", "N", templates=t)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        c.component({"d": {"a": {"method_type": "m"}}}, "d", "a")
        c.component({"d": {"a": {"method_type": "m", "auto_config": True, "params": {}}}}, "d", "a")
    assert len(seen) == 2
    assert not c.configured(got, []).watched


SCHEMA = "ord long, logID string, EventID int, template string, variables array<string>, logFormatVariables map<string,string>"


def test_saved_models_and_history(spark, tmp_path):
    rows = spark.createDataFrame([(i, str(i), i % 2, f"t{i}", [str(i % 3)], {}) for i in range(20)], SCHEMA)
    det = NewValue("N", c.watched_variables(["var_0"], 0)).fit(rows)
    history.save(spark, str(tmp_path / "m"), {"values": det.model}, {"name": "N"})
    tables, about = history.load(spark, str(tmp_path / "m"))
    assert about == {"name": "N"} and sorted(tables["values"].collect()) == sorted(det.model.collect())
    with pytest.raises(history.LoadError):
        history.load(spark, str(tmp_path / "none"))
    assert history.load_if_saved(spark, history.Saving(str(tmp_path / "none"), auto_load=True)) is None
    assert history.load_if_saved(spark, history.Saving(str(tmp_path / "m"), auto_load=True))[1] == {"name": "N"}
    assert history.Saving().describe()["interval_s"] == 300
    history.append(str(tmp_path / "h"), rows)
    history.append(str(tmp_path / "h"), rows.where("ord < 2").withColumn("ord", F.col("ord") + 20))
    full = spark.read.parquet(str(tmp_path / "h"))
    assert sorted(r.ord for r in history.retained(full, 5).collect()) == [12, 13, 14, 15, 16, 17, 18, 19, 20, 21]
    history.compact(spark, str(tmp_path / "h"), str(tmp_path / "h2"))
    assert spark.read.parquet(str(tmp_path / "h2")).count() == 22
    assert {r.EventID: r.template for r in history.last_templates(rows).collect()} == {0: "t18", 1: "t19"}


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, str(i), i % 2, "t", ["abc"[i % 3] if i < 30 else "z"], {}) for i in range(40)], SCHEMA)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    det = NewValue("N", [w for e in (0, 1) for w in c.watched_variables(["var_0"], e)]).fit(rows.where("ord < 20"))
    want = {r.ord for r in det.transform(rows).collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "alerts")
    scoring.score_stream(stream, det.transform, lambda a, n: a.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "ck")).awaitTermination(120)
    assert {r.ord for r in spark.read.parquet(out).collect()} == want == set(range(30, 40))

    def collected(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    values = stream.select(F.lit("0").alias("event"), F.lit("v").alias("name"), F.get("variables", F.lit(0)).alias("value"))
    assert sorted(r.value for r in collected(scoring.first_occurrences(values), "firsts")) == ["a", "b", "c", "z"]
    got = collected(scoring.key_windows(stream.withColumn("key", F.lit("k")), 3), "windows")
    assert sorted((r.last_ord, r.events) for r in got) == [(i, [(i - 2) % 2, (i - 1) % 2, i % 2]) for i in range(2, 40)]
    scoring.snapshot(det.model, str(tmp_path / "snap"))(spark.createDataFrame([("0", "var_0", "new")], det.model.schema), 1)
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 1


def test_a_chain_of_components(spark):
    assert chain(spark.range(5), [lambda d: d.where("id > 1"), lambda d: d.select((F.col("id") * 2).alias("x"))]).agg(F.sum("x")).first()[0] == 18
