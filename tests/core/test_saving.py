import logging
import time

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import history
from cinderlog.operators.history import Saver, Saving
from cinderlog.streaming.scoring import Learned, learn_stream


def rows(spark, n=4):
    return spark.createDataFrame([("0", "a", str(i)) for i in range(n)], "event string, name string, value string")


def test_history_keeps_the_last_records_of_each_event(spark):
    """Event 1 is rare and early: it stays, although many later records of event 0 go."""
    data = [(i, 1 if i in (1, 3, 5) else 0 if i != 7 else None) for i in range(200)]
    df = spark.createDataFrame(data, "ord long, EventID int")
    for most in (1, 3, 5, 196, 197, 500):
        for block in (1, 7, 1 << 16):
            want = []
            for event in (0, 1, None):
                want += [o for o, e in data if e == event][-most:]
            assert sorted(r.ord for r in history.retained(df, most, block=block).collect()) == sorted(want)
    assert history.retained(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        history.retained(df, 0)


def test_saves_by_count_and_by_time(spark, tmp_path):
    state = {"n": 1}
    saver = Saver(spark, Saving(str(tmp_path / "s"), interval_s=3600, events_until_save=10), lambda: ({"values": rows(spark, state["n"])}, {"n": state["n"]}))
    assert saver.status()["last_saved_at"] is None and not saver.ingested(9)
    with pytest.raises(history.LoadError):
        saver.load()
    state["n"] = 3
    assert saver.ingested(1) and saver.since == 0
    tables, about = saver.load()
    assert about == {"n": 3} and tables["values"].count() == 3 and saver.status()["last_saved_at"] <= time.time()
    assert not saver.ingested(5)
    saver.saving.interval_s = 0
    assert saver.ingested(1) and saver.saves == 2


def test_saves_in_the_background_and_at_the_end(spark, tmp_path):
    path = str(tmp_path / "s")
    with Saver(spark, Saving(path, interval_s=0.2), lambda: ({"values": rows(spark)}, {})) as saver:
        until = time.monotonic() + 60
        while not saver.saves and time.monotonic() < until:
            time.sleep(0.1)
        assert saver.saves
        held = saver.saves
        saver.saving.interval_s = 3600
    assert saver.saves > held and history.load(spark, path)[0]["values"].count() == 4


def test_a_failed_save_is_logged_and_counted_on(spark, tmp_path, caplog):
    def fails():
        raise RuntimeError("no state")

    saver = Saver(spark, Saving(str(tmp_path / "s"), events_until_save=2), fails)
    with caplog.at_level(logging.WARNING):
        assert not saver.ingested(2) and saver.since == 2
    assert "isn't saved" in caplog.text


def test_a_loaded_model_can_be_saved_where_it_came_from(spark, tmp_path):
    path = str(tmp_path / "m")
    history.save(spark, path, {"values": rows(spark)}, {"k": 1})
    tables, _ = history.load(spark, path)
    history.save(spark, path, {"values": tables["values"].union(rows(spark, 1))}, {"k": 2})
    tables, about = history.load(spark, path)
    assert about == {"k": 2} and tables["values"].count() == 5


def test_state_in_memory(spark):
    tables, about = history.undump(spark, history.dump({"values": rows(spark), "none": rows(spark, 4).limit(0)}, {"name": "N"}))
    assert about == {"name": "N"} and sorted(tables["values"].collect()) == sorted(rows(spark).collect()) and tables["none"].count() == 0
    with pytest.raises(history.LoadError):
        history.undump(spark, b"no archive")


def test_state_directory(monkeypatch):
    monkeypatch.delenv("STATE_DIRECTORY", raising=False)
    assert Saving().path == "./state"
    monkeypatch.setenv("STATE_DIRECTORY", ":/var/lib/a:/b")
    assert Saving().path == "/var/lib/a" and Saving("/c").path == "/c"


def test_a_stream_learns_saves_and_goes_on_after_a_restart(spark, tmp_path):
    source, kind = str(tmp_path / "in"), "event string, name string, value string"
    saving = Saving(str(tmp_path / "state"), events_until_save=3, auto_load=True)
    for k, part in enumerate(([("0", "a", "x"), ("0", "a", "x"), ("0", "a", "y")], [("0", "a", "y"), ("1", "a", "x")])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        learned = Learned(spark, str(tmp_path / f"run{k}"), ["event", "name", "value"], saving, kind)
        assert (learned.start is None) == (k == 0)
        stream = spark.readStream.schema(kind).parquet(source)
        learn_stream(stream, learned, str(tmp_path / "checkpoint")).awaitTermination(120)
        learned.saver.save()
    tables, _ = history.load(spark, saving.path)
    assert sorted(map(tuple, tables["values"].collect())) == [("0", "a", "x"), ("0", "a", "y"), ("1", "a", "x")]
    # A batch that comes again, as after a failure, is learned once.
    learned.add(spark.createDataFrame([("9", "a", "x")], kind), 7)
    learned.add(spark.createDataFrame([("9", "a", "x")], kind), 7)
    assert learned.table().where(F.col("event") == "9").count() == 1
