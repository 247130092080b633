"""Detectors on streams: models are fitted in batch and score each micro-batch; novelty and windows are kept per key.

State that grows with the stream's different values is a key of its own for each value, so it spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinderlog.operators.history import Saver, Saving, load_if_saved
from cinderlog.runtime import on_workers


def score_stream(parsed: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger: Any):
    """Start a query that scores each micro-batch by a fitted detector's transform and hands alerts to sink(alerts, batch).

    A sink that writes by batch number makes a batch that is repeated after a failure harmless."""

    def batch(df: DataFrame, number: int) -> None:
        sink(transform(df), number)

    return parsed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def learn_stream(values: DataFrame, learned: Learned, checkpoint: str, **trigger: Any):
    """Start a query that adds each micro-batch's new values to what is learned."""
    return values.writeStream.foreachBatch(learned.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Learned:
    """Different values that a stream has had, in a table that grows by a folder a batch, and is saved as a Saver says.

    A batch's folder bears its number, so a batch that is repeated after a failure is learned once. The table is anti-joined
    against before it grows; it is as large as the number of different values."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], saving: Saving, kind: str):
        self.spark, self.path, self.columns, self.kind = spark, path, columns, kind
        self.start = load_if_saved(spark, saving)
        self.batches: set[int] = set()
        self.saver = Saver(spark, saving, lambda: ({"values": self.table()}, {"columns": columns}))

    def table(self) -> DataFrame:
        parts = [self.spark.read.schema(self.kind).parquet(f"{self.path}/batch={n}") for n in sorted(self.batches)]
        if self.start is not None:
            parts.append(self.start[0]["values"].select(*self.columns))
        empty = self.spark.createDataFrame([], self.kind)
        return reduce(DataFrame.unionByName, parts, empty)

    def add(self, batch: DataFrame, number: int) -> None:
        batch = batch.select(*self.columns)
        self.batches.discard(number)
        batch.distinct().join(self.table(), self.columns, "left_anti").write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        self.batches.add(number)
        self.saver.ingested(batch.count())


def first_occurrences(values: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """The rows whose (event, name, value) the stream didn't have before. watermark: (column, delay), to forget old ones."""
    key = ["event", "name", "value"]
    if watermark:
        return values.withWatermark(*watermark).dropDuplicatesWithinWatermark(key)
    return values.dropDuplicates(key)


def key_windows(rows: DataFrame, size: int, key: str = "key", ordinal: str = "ord", event: str = "EventID") -> DataFrame:
    """(key, last_ord, events): each key's sliding count windows, over micro-batches. Rows of a batch are put in order; rows
    that come in a later batch than they should are taken as they come."""
    on_workers(rows.sparkSession)
    kind = dict(rows.dtypes)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        batch = pd.concat(list(frames)).sort_values(ordinal)
        out = []
        for o, e in zip(batch[ordinal], batch[event], strict=True):
            held = [*held, int(e)][-size:]
            if len(held) == size:
                out.append((group[0], int(o), held))
        state.update((held[-(size - 1) :] if size > 1 else [],))
        yield pd.DataFrame(out, columns=["key", "last_ord", "events"])

    return rows.select(F.col(key).alias("key"), ordinal, event).groupBy("key").applyInPandasWithState(step, f"key {kind[key]}, last_ord long, events array<int>", "held array<int>", "append", GroupStateTimeout.NoTimeout)


def snapshot(model: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """A sink that also adds each batch's new values to a saved model, under the batch's number."""

    def save(values: DataFrame, number: int) -> None:
        values.join(model, model.columns, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return save
