"""What is kept of records: their history per event, and what was learned, as Parquet tables with a JSON sidecar."""

from __future__ import annotations

import atexit
import io
import json
import logging
import os
import signal
import sys
import threading
import time
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window



log = logging.getLogger(__name__)


class LoadError(RuntimeError):
    """Saved state can't be read."""


def append(history: str, parsed: DataFrame) -> None:
    """Add records to a history table, a folder for each event."""
    parsed.write.mode("append").partitionBy("EventID").parquet(history)


def retained(history: DataFrame, most: int = 10_000_000, by: str = "EventID", ordinal: str = "ord", block: int = 1 << 16) -> DataFrame:
    """The last `most` records of each event.

    Places are cut into blocks. The counts of an event's blocks, one row each, say in which block the first record that stays
    is; only that block's records are ranked, so an event of any length is spread over all tasks."""
    if most < 1:
        raise ValueError("most: 1 at least")
    rows = history.select(F.col(by).alias("_by"), F.col(ordinal).alias("_ord"), F.floor(F.col(ordinal) / block).alias("_block"))
    cells = rows.groupBy("_by", "_block").agg(F.count(F.lit(1)).alias("_c"))
    later = F.sum("_c").over(Window.partitionBy("_by").orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    cuts = cells.withColumn("_drop", F.col("_c") - (F.lit(most) - later)).where("_drop >= 0 and _drop < _c")
    cuts = cuts.select(F.col("_by").alias("_event"), F.col("_block").alias("_b"), "_drop")
    inside = rows.join(cuts, F.col("_by").eqNullSafe(F.col("_event")) & (F.col("_block") == F.col("_b")))
    place = F.row_number().over(Window.partitionBy("_by", "_block").orderBy("_ord")) - 1
    firsts = inside.withColumn("_i", place).where("_i = _drop").select("_event", F.col("_ord").alias("_first"))
    # One row an event that has more than `most` records.
    full = history.join(firsts, F.col(by).eqNullSafe(F.col("_event")), "left")
    return full.where(F.col("_first").isNull() | (F.col(ordinal) >= F.col("_first"))).select(*history.columns)


def compact(spark: SparkSession, history: str, into: str, files: int = 1) -> None:
    """Rewrite a history in few files for each event."""
    spark.read.parquet(history).repartition(files, "EventID").write.mode("overwrite").partitionBy("EventID").parquet(into)


def last_templates(parsed: DataFrame) -> DataFrame:
    """(EventID, template): the last template of each event whose records have variables."""
    return parsed.where(F.size("variables") > 0).groupBy("EventID").agg(F.max_by("template", "ord").alias("template"))


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], about: dict[str, Any], options: dict[str, Any] | None = None) -> str:
    """Write a model's tables, and what else describes it as one line of JSON, to any file system that Spark writes to.

    Each save is a folder of its own, whose name is returned; the line of JSON that names it is written last. So a save that
    is broken off leaves the one before it as it was, and a model that was loaded from here can be saved here again."""
    version = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.options(**(options or {})).parquet(f"{path}/{version}/{name}")
    line = json.dumps({"version": version, "tables": sorted(tables), "about": about, "saved_at": time.time()})
    sidecar = spark.createDataFrame([(line,)], "value string")
    sidecar.coalesce(1).write.mode("overwrite").options(**(options or {})).text(f"{path}/metadata")
    return version


def _sidecar(spark: SparkSession, path: str, options: dict[str, Any] | None) -> dict[str, Any]:
    return json.loads(spark.read.options(**(options or {})).text(f"{path}/metadata").first()[0])


def load(spark: SparkSession, path: str, options: dict[str, Any] | None = None) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """What save wrote last; LoadError if it isn't there or isn't whole."""
    try:
        meta = _sidecar(spark, path, options)
        return {n: spark.read.options(**(options or {})).parquet(f"{path}/{meta['version']}/{n}") for n in meta["tables"]}, meta["about"]
    except Exception as e:
        raise LoadError(f"{path}: {e}") from e


def dump(tables: dict[str, DataFrame], about: dict[str, Any]) -> bytes:
    """The same in memory, as a zip archive of Parquet files and a line of JSON: for models that the driver can hold."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            sink = pa.BufferOutputStream()
            pq.write_table(df.toArrow(), sink)
            z.writestr(f"tables/{name}.parquet", sink.getvalue().to_pybytes())
        z.writestr("metadata.json", json.dumps({"tables": sorted(tables), "about": about}))
    return buffer.getvalue()


def undump(spark: SparkSession, data: bytes) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """What dump made; LoadError for anything else."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            meta = json.loads(z.read("metadata.json"))
            read = {n: pq.read_table(pa.BufferReader(z.read(f"tables/{n}.parquet"))) for n in meta["tables"]}
        return {n: spark.createDataFrame(t) for n, t in read.items()}, meta["about"]
    except Exception as e:
        raise LoadError(str(e)) from e


def state_folder() -> str:
    """The first folder of $STATE_DIRECTORY, else ./state."""
    return next((p for p in os.environ.get("STATE_DIRECTORY", "").split(":") if p.strip()), "./state")


@dataclass
class Saving:
    """When state is saved: every so many seconds or records; whether a start takes up what is saved; and options for the file
    system."""

    path: str = field(default_factory=state_folder)
    interval_s: float = 300
    events_until_save: int | None = None
    auto_load: bool = False
    storage_options: dict[str, Any] = field(default_factory=dict)

    def describe(self) -> dict[str, Any]:
        return asdict(self)


def load_if_saved(spark: SparkSession, saving: Saving) -> tuple[dict[str, DataFrame], dict[str, Any]] | None:
    """Saved state if auto_load is on and there is any, else None: a fresh start."""
    if not saving.auto_load:
        return None
    try:
        return load(spark, saving.path, saving.storage_options)
    except LoadError as e:
        log.info("nothing is saved, starting afresh: %s", e)
        return None


class Saver:
    """Saves state as `saving` says.

    state: gives the tables and the description as they are now. `ingested` counts records, between micro-batches or calls, and
    saves when enough of them or enough time has passed; `start` saves by time alone too, in the background, until `stop`,
    which saves a last time, as does the end of the process. A save that fails is logged, and tried again when the next is
    due."""

    def __init__(self, spark: SparkSession, saving: Saving, state: Callable[[], tuple[dict[str, DataFrame], dict[str, Any]]]):
        self.spark, self.saving, self.state = spark, saving, state
        self.since, self.saves, self.last = 0, 0, time.monotonic()
        self._lock, self._ended, self._timer = threading.RLock(), threading.Event(), None

    def ingested(self, n: int) -> bool:
        """Count n more records; whether that made a save."""
        with self._lock:
            self.since += n
            enough = self.saving.events_until_save is not None and self.since >= self.saving.events_until_save
            if not enough and time.monotonic() - self.last < self.saving.interval_s:
                return False
        return self.save()

    def save(self) -> bool:
        with self._lock:
            held, self.since, self.last = self.since, 0, time.monotonic()
            try:
                save(self.spark, self.saving.path, *self.state(), self.saving.storage_options)
                self.saves += 1
                return True
            except Exception:
                self.since += held
                log.warning("state isn't saved", exc_info=True)
                return False

    def load(self) -> tuple[dict[str, DataFrame], dict[str, Any]]:
        with self._lock:
            return load(self.spark, self.saving.path, self.saving.storage_options)

    def status(self) -> dict[str, Any]:
        try:
            saved_at = _sidecar(self.spark, self.saving.path, self.saving.storage_options).get("saved_at")
        except Exception:
            saved_at = None
        return {**self.saving.describe(), "events_since_save": self.since, "saves": self.saves, "last_saved_at": saved_at}

    def _run(self) -> None:
        while not self._ended.wait(self.saving.interval_s):
            self.save()

    def start(self) -> Saver:
        self._ended.clear()
        self._timer = threading.Thread(target=self._run, daemon=True, name="saver")
        self._timer.start()
        atexit.register(self.stop)
        if threading.current_thread() is threading.main_thread():
            signal.signal(signal.SIGTERM, lambda *_: (self.stop(), sys.exit(143)))
        return self

    def stop(self) -> None:
        if self._timer is None:
            return
        self._ended.set()
        self._timer.join(timeout=60)
        self._timer = None
        atexit.unregister(self.stop)
        self.save()

    def __enter__(self) -> Saver:
        return self.start()

    def __exit__(self, *_: object) -> None:
        self.stop()
