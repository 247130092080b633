"""Detectors of unusual sequences: windows of event ids, their counts, and what comes next in them.

All read (ord, logID, EventID, logFormatVariables). A window is the size records that end with a record; training windows
are whole training records' windows. Windows are made side by side (see order.sliding).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderlog.operators.detectors import chance, event_time
from cinderlog.operators.order import sliding, with_ordinal
from cinderlog.operators.stability import STABLE, STATIC, classify, value_changes
from cinderlog.runtime import durable


def windows(parsed: DataFrame, size: int) -> DataFrame:
    """(window, first_ord, last_ord, logIDs, times, events)"""
    rows = parsed.select("ord", "EventID", F.col("logID").cast("string").alias("logID"), event_time(F.col("logFormatVariables")).alias("time"))
    out = sliding(rows, size)
    pick = lambda name: F.transform("records", lambda r: r[name])
    return out.select("window", "first_ord", "last_ord", pick("logID").alias("logIDs"), pick("time").alias("times"), pick("EventID").alias("events"))


def count_vector(events: Column) -> Column:
    """How often each event from 0 up to the greatest occurs; an event of -1 has a place of its own before them."""
    return F.transform(F.sequence(F.lit(-1), F.greatest(F.array_max(events), F.lit(0))), lambda e: F.size(F.filter(events, lambda x: x == e)))


def window_alerts(odd: DataFrame, name: str, kind: str, description: str, key: Column, message: Column, score: Column | None = None, start_id: int = 10, clock: Column | None = None) -> DataFrame:
    now = clock if clock is not None else F.unix_timestamp()
    full = with_ordinal(odd, "last_ord", ordinal="_id", start=start_id)
    return full.select(
        F.col("last_ord").alias("ord"),
        F.lit(name).alias("detectorID"),
        F.lit(kind).alias("detectorType"),
        F.concat(F.lit(f"{name}_"), F.col("_id").cast("string")).alias("alertID"),
        now.alias("detectionTimestamp"),
        "logIDs",
        (score if score is not None else F.lit(1.0)).cast("float").alias("score"),
        F.col("times").alias("extractedTimestamps"),
        F.lit(description).alias("description"),
        now.alias("receivedTimestamp"),
        F.create_map(key, message).alias("alertsObtain"),
    )


@dataclass
class WindowDetector:
    name: str
    size: int = 10
    model: DataFrame | None = None
    kind: ClassVar[str] = "core_detector"

    def fit(self, parsed: DataFrame) -> WindowDetector:
        raise NotImplementedError

    def unusual(self, parsed: DataFrame) -> DataFrame:
        """The unusual windows, as `windows` has them."""
        raise NotImplementedError

    def transform(self, parsed: DataFrame) -> DataFrame:
        text = f"{self.name} found an unknown window"
        return window_alerts(self.unusual(parsed), self.name, self.kind, text, F.lit("window"), F.lit(text))


class EventSequence(WindowDetector):
    """Sequences of events that training didn't see."""

    kind = "event_sequence_detector"

    def fit(self, parsed: DataFrame) -> EventSequence:
        self.model = durable(windows(parsed, self.size).select("events").distinct(), self.kind)
        return self

    def unusual(self, parsed: DataFrame) -> DataFrame:
        full = windows(parsed, self.size)
        new = full.select("events").distinct().join(self.model, "events", "left_anti")
        return full.join(new, "events", "left_semi")

    def transform(self, parsed: DataFrame) -> DataFrame:
        shown = F.concat(F.lit("Sequence ("), F.array_join("events", ", "), F.lit(")"))
        message = F.concat(F.lit(f"EventID sequence of length {self.size} ending at logID "), F.element_at("logIDs", -1), F.lit(" was not seen during training."))
        return window_alerts(self.unusual(parsed), self.name, self.kind, f"{self.name} detects unknown EventID sequences as anomalies.", shown, message)


def choose_length(parsed: DataFrame, least: int = 2, most: int = 10) -> int | None:
    """The greatest window length whose series of sequences is stable or static; None if there is none."""
    rows = parsed.select("ord", "EventID")
    series = None
    for n in range(least, most + 1):
        one = sliding(rows, n).select(F.lit("*").alias("event"), F.lit(str(n)).alias("name"), F.col("last_ord").alias("ord"), F.array_join(F.transform("records", lambda r: r["EventID"].cast("string")), ",").alias("value"))
        series = one if series is None else series.union(one)
    found = classify(value_changes(series)).where(F.col("class").isin(STABLE, STATIC)).agg(F.max(F.col("name").cast("int"))).first()
    return found[0]


class CountVectors(WindowDetector):
    """Windows whose counts of events training didn't see."""

    kind = "scvs_detector"

    def fit(self, parsed: DataFrame) -> CountVectors:
        self.model = durable(windows(parsed, self.size).select(count_vector(F.col("events")).alias("vector")).distinct(), self.kind)
        return self

    def unusual(self, parsed: DataFrame) -> DataFrame:
        full = windows(parsed, self.size).withColumn("vector", count_vector(F.col("events")))
        new = full.select("vector").distinct().join(self.model, "vector", "left_anti")
        return full.join(new, "vector", "left_semi")

    def transform(self, parsed: DataFrame) -> DataFrame:
        return window_alerts(self.unusual(parsed), self.name, self.kind, "Count vector not found", F.lit("Count vector"), F.lit("Count vector not found"))


@dataclass
class NearCountVectors(WindowDetector):
    """Windows whose counts of events are far from all of training's.

    validation: the share of training's different vectors, in the order of a hash, that only sets the threshold: the mean
    of their own distances, or 0 ("default"). A model has one row for each different vector, of which windows of `size`
    records over a few events have few; vectors meet those of the model with which they share an event.
    """

    validation: float = 0.2
    seed: int = 0
    method: str = "mean"
    threshold: float | None = None
    kind: ClassVar[str] = "ecvc_detector_detector"

    def fit(self, parsed: DataFrame) -> NearCountVectors:
        every = windows(parsed, self.size).select(count_vector(F.col("events")).alias("vector")).distinct()
        return self.fit_vectors(every)

    def fit_vectors(self, every: DataFrame) -> NearCountVectors:
        spread = F.md5(F.concat_ws("|", F.array_join(F.col("vector").cast("array<string>"), ","), *([F.lit(self.seed)] if self.seed else [])))
        full = durable(with_ordinal(every.withColumn("_h", spread), "_h", "vector", ordinal="_o"), "vectors")
        n = full.count()
        kept = F.ceil(F.lit(n) * (1 - self.validation))
        self.model = durable(full.where(F.col("_o") < kept).select("vector"), self.kind)
        rest = full.where(F.col("_o") >= kept).select("vector")
        if self.method == "default":
            self.threshold = 0.0
        elif self.method == "mean":
            self.threshold = self.distances(rest).agg(F.avg("distance")).first()[0] or 0.0
        else:
            raise ValueError(f"method: {self.method}")
        return self

    def distances(self, vectors: DataFrame) -> DataFrame:
        """(vector, distance): the least distance to the model's vectors; null without any. vectors are few and different, as
        the counts of `size` records over a few events are; so is the model.

        Of two vectors the sum of lesser parts, shared, tells the distance: (sums - 2 * shared) / (sums - shared). Vectors meet those of the model that share an event with them, entry by entry, and only sums
        of shared counts are kept; one that shares none is at distance 1."""
        entries = lambda v: F.filter(F.transform(v, lambda n, i: F.struct(i.alias("i"), n.alias("n"))), lambda e: e["n"] > 0)
        total = lambda v: F.aggregate(v, F.lit(0), lambda s, n: s + n)
        left = vectors.select("vector", F.explode(entries(F.col("vector"))).alias("e")).select("vector", "e.*")
        right = self.model.select(F.col("vector").alias("known"), F.explode(entries(F.col("vector"))).alias("e")).select("known", F.col("e.i").alias("j"), F.col("e.n").alias("m"))
        met = left.join(right, F.col("i") == F.col("j")).groupBy("vector", "known").agg(F.sum(F.least("n", "m")).alias("shared"))
        both = total(F.col("vector")) + total(F.col("known"))
        near = met.groupBy("vector").agg(F.min((both - 2 * F.col("shared")) / (both - F.col("shared"))).alias("near"))
        some = F.lit(None).cast("double") if self.model.isEmpty() else F.lit(1.0)
        near = near.withColumnRenamed("vector", "_met")
        return vectors.join(near, F.col("vector") == F.col("_met"), "left").select("vector", F.coalesce("near", some).alias("distance"))

    def unusual(self, parsed: DataFrame) -> DataFrame:
        full = windows(parsed, self.size).withColumn("vector", count_vector(F.col("events")))
        # Vectors of training are at distance 0, which no threshold is below.
        new = full.select("vector").distinct().join(self.model, "vector", "left_anti")
        # A mean of equal distances may miss them by rounding.
        return full.join(self.distances(new).where(F.col("distance") > self.threshold + 1e-12), "vector")

    def transform(self, parsed: DataFrame) -> DataFrame:
        text = "ECVC found an anominal sequence"
        return window_alerts(self.unusual(parsed), self.name, self.kind, text, F.lit("Count vector"), F.lit(text), F.col("distance"))


@dataclass
class NextEvent(WindowDetector):
    """Windows whose last event is none of the likely ones after the others.

    The likelihood is a count of what followed the last `order` events in training, backing off to fewer where training
    hasn't seen them: a substitute, with the same rule, for a recurrent network. top_k, if it isn't given, is the usual rank of
    the truth in a share of training windows (chosen by a hash of their places) that the counts don't have, plus 2.
    """

    order: int = 2
    top_k: int | None = None
    validation: float = 0.2
    kind: ClassVar[str] = "deeplog_detector"

    def _context(self, n: int) -> Column:
        before = F.slice("events", 1, self.size - 1)
        return F.array_join(F.when(F.lit(n) > 0, F.slice(before, F.lit(self.size - n), F.lit(n))).otherwise(F.array().cast("array<int>")), ",")

    def _examples(self, full: DataFrame) -> DataFrame:
        orders = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), self._context(n).alias("context")) for n in range(min(self.order, self.size - 1) + 1))))
        return full.select("*", F.element_at("events", -1).alias("event"), orders.alias("_c")).select("*", "_c.n", "_c.context")

    def fit(self, parsed: DataFrame) -> NextEvent:
        full = windows(parsed, self.size)
        aside = F.lit(False) if self.top_k is not None else chance(F.col("window")) < self.validation
        counts = self._examples(full.where(~aside)).groupBy("n", "context", "event").agg(F.count(F.lit(1)).alias("c"))
        ranked = Window.partitionBy("n", "context").orderBy(F.col("c").desc(), "event")
        self.model = durable(counts.withColumn("rank", F.row_number().over(ranked)), "next-event")
        if self.top_k is None:
            usual = self.ranks(full.where(aside)).agg(F.mode("rank", True)).first()[0]
            self.top_k = int(usual or 0) + 2
        return self

    def ranks(self, full: DataFrame) -> DataFrame:
        """full with `rank` of the last event after the longest context that training knows; null if it never followed."""
        asked = self._examples(full.select("events").distinct())
        known = asked.join(self.model.select("n", "context").distinct(), ["n", "context"], "left_semi")
        best = known.groupBy("events").agg(F.max(F.struct("n", "context", "event")).alias("b")).select("events", "b.*")
        return full.join(best.join(self.model.select("n", "context", "event", "rank"), ["n", "context", "event"], "left").select("events", "rank"), "events")

    def unusual(self, parsed: DataFrame) -> DataFrame:
        return self.ranks(windows(parsed, self.size)).where(F.coalesce("rank", F.lit(2**31 - 1)) > self.top_k)

    def transform(self, parsed: DataFrame) -> DataFrame:
        text = f"{self.name} found an unlikely event"
        return window_alerts(self.unusual(parsed), self.name, self.kind, text, F.lit("Sequence"), F.lit(text))


@dataclass
class MaskedEvents(WindowDetector):
    """Windows with a masked event that is none of the likely ones between its neighbours.

    The likelihood is a count of what stood between the same two events in training: a substitute, with the same rule, for
    a masked transformer. share: of the places masked, chosen by a hash of window and place.
    """

    top_k: int = 3
    share: float = 0.4
    seed: int = 0
    kind: ClassVar[str] = "logbert_detector"

    def _places(self, full: DataFrame) -> DataFrame:
        inner = F.transform(
            F.sequence(F.lit(0), F.lit(self.size - 1)),
            lambda i: F.struct(i.alias("place"), F.coalesce(F.get("events", i - 1), F.lit(-2)).alias("before"), F.get("events", i).alias("event"), F.coalesce(F.get("events", i + 1), F.lit(-2)).alias("after")),
        )
        return full.select("*", F.explode(inner).alias("_p")).select("*", "_p.*").drop("_p")

    def fit(self, parsed: DataFrame) -> MaskedEvents:
        counts = self._places(windows(parsed, self.size)).groupBy("before", "after", "event").agg(F.count(F.lit(1)).alias("c"))
        ranked = Window.partitionBy("before", "after").orderBy(F.col("c").desc(), "event")
        self.model = durable(counts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= self.top_k).drop("c", "rank"), "masked")
        return self

    def unusual(self, parsed: DataFrame) -> DataFrame:
        full = windows(parsed, self.size)
        masked = chance(F.col("window"), F.col("place"), F.lit(self.seed)) < self.share
        odd = self._places(full).where(masked).join(self.model, ["before", "after", "event"], "left_anti")
        return full.join(odd.select("window").distinct(), "window", "left_semi")

    def transform(self, parsed: DataFrame) -> DataFrame:
        text = f"{self.name} found unlikely events"
        return window_alerts(self.unusual(parsed), self.name, self.kind, text, F.lit("Sequence"), F.lit(text))


def grid_search(make, options: dict[str, list], train: DataFrame, check: DataFrame) -> tuple[dict, float]:
    """The options, of all combinations of a few, with the fewest alerts on normal records; ties to the first."""
    from itertools import product

    best: tuple[dict, float] | None = None
    for values in product(*options.values()):
        chosen = dict(zip(options, values, strict=True))
        n = float(make(**chosen).fit(train).unusual(check).count())
        if best is None or n < best[1]:
            best = (chosen, n)
    if best is None:
        raise ValueError("options: one value each at least")
    return best
