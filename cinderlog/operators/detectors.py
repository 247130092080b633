"""Detectors of unusual values. Each is fitted by an aggregation into a small model table and scores records by joins.

Scoring works on distinct (event, variable, value) first: those are counted and tested with map-side combining, so that a
value that half of all records carry costs no more than another; only the unusual ones are joined back to their records.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.text import as_number, bigrams, characters, number_text, quoted_list
from cinderlog.functions.timestamps import to_seconds
from cinderlog.operators.variables import combinations, watched_variables
from cinderlog.plans.config import ANY_EVENT, Watched
from cinderlog.runtime import durable

VARIABLE = ["event", "name"]


def alert_key(event: Column, name: Column) -> Column:
    return F.when(event == ANY_EVENT, F.concat(F.lit("Global - "), name)).otherwise(F.concat(F.lit("EventID "), event, F.lit(" - "), name))


def event_time(parsed_fields: Column) -> Column:
    """A record's own time in seconds; 0 without a Time field."""
    return to_seconds(F.coalesce(F.try_element_at(parsed_fields, F.lit("Time")), F.lit("")))


#: What an alert says of its record, beside its place: both are carried along, so that records are read once for scoring.
ORIGIN = ("_log_id", "_stamp")


def with_origin(parsed: DataFrame) -> DataFrame:
    """parsed with its records' ids and stamps as they stand; the stamps of those that alert are read as times later."""
    return parsed.withColumns({"_log_id": F.col("logID").cast("string"), "_stamp": F.try_element_at("logFormatVariables", F.lit("Time"))})


@dataclass
class Detector:
    """name, watched: as configured. fit(parsed) makes the model and writes it, so that scoring doesn't learn it again;
    transform(parsed) gives alerts of parsed records (ord, logID, EventID, variables, logFormatVariables)."""

    name: str
    watched: list[Watched]
    model: DataFrame | None = None
    kind: ClassVar[str] = "core_detector"
    description: ClassVar[str] = "{name} detects values not encountered in training as anomalies."

    def fit(self, parsed: DataFrame) -> Detector:
        self.model = durable(self.learn(watched_variables(parsed, self.watched)), self.kind)
        return self

    def learn(self, values: DataFrame) -> DataFrame:
        raise NotImplementedError

    def unusual(self, values: DataFrame) -> DataFrame:
        """values: distinct (event, name, value); those that are unusual, with `message`."""
        raise NotImplementedError

    def findings(self, parsed: DataFrame) -> DataFrame:
        """(ord, _log_id, _stamp, event, name, value, message): one row for each unusual variable of a record."""
        rows = watched_variables(with_origin(parsed), self.watched, "ord", *ORIGIN)
        odd = self.unusual(rows.select("event", "name", "value").distinct())
        return rows.join(odd, ["event", "name", "value"])

    def transform(self, parsed: DataFrame) -> DataFrame:
        return alerts(self.scored(self.findings(parsed)), self.name, self.kind, self.description.format(name=self.name))

    def scored(self, findings: DataFrame) -> DataFrame:
        """(ord, _log_id, _stamp, score, found): found is a map of messages by variable."""
        entry = F.struct(alert_key(F.col("event"), F.col("name")).alias("key"), F.col("message").alias("value"))
        return findings.groupBy("ord", *ORIGIN).agg(F.count(F.lit(1)).cast("double").alias("score"), F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("found"))


def alerts(scored: DataFrame, name: str, kind: str, description: str, start_id: int = 10, clock: Column | None = None) -> DataFrame:
    """Alert records of scored records (ord, _log_id, _stamp, score, found). Ids are given in the order of records, to alerts
    alone."""
    from cinderlog.operators.order import with_ordinal

    now = clock if clock is not None else F.unix_timestamp()
    full = with_ordinal(scored.withColumn("_time", to_seconds(F.coalesce("_stamp", F.lit("")))), "ord", ordinal="_id", start=start_id)
    return full.select(
        "ord",
        F.lit(name).alias("detectorID"),
        F.lit(kind).alias("detectorType"),
        F.concat(F.lit(f"{name}_"), F.col("_id").cast("string")).alias("alertID"),
        now.alias("detectionTimestamp"),
        F.array("_log_id").alias("logIDs"),
        F.col("score").cast("float").alias("score"),
        F.array("_time").alias("extractedTimestamps"),
        F.lit(description).alias("description"),
        now.alias("receivedTimestamp"),
        F.col("found").alias("alertsObtain"),
    )


class NewValue(Detector):
    """Values that a variable didn't have in training; variables that training didn't see are silent."""

    kind = "new_value_detector"

    def learn(self, values: DataFrame) -> DataFrame:
        return values.distinct()

    def unusual(self, values: DataFrame) -> DataFrame:
        known = self.model.select(*VARIABLE).distinct()
        new = values.join(known, VARIABLE, "left_semi").join(self.model, [*VARIABLE, "value"], "left_anti")
        return new.withColumn("message", F.concat(F.lit("Unknown value: '"), F.col("value"), F.lit("'")))


@dataclass
class NewEvent(Detector):
    """Events that training didn't see. compat_global: with variables watched in all events, every record alerts."""

    compat_global: bool = False
    kind: ClassVar[str] = "new_event_detector"

    def fit(self, parsed: DataFrame) -> NewEvent:
        self.model = durable(parsed.select(F.col("EventID").cast("string").alias("event")).distinct(), self.kind)
        return self

    def scored_records(self, parsed: DataFrame) -> DataFrame:
        rows = with_origin(parsed).withColumn("event", F.col("EventID").cast("string"))
        if not (self.compat_global and any(w.event == ANY_EVENT for w in self.watched)):
            new = rows.select("event").distinct().join(self.model, "event", "left_anti")
            rows = rows.join(new, "event", "left_semi")
        from cinderlog.operators.variables import watched_entries

        shown = F.transform(watched_entries(self.watched), lambda e: F.concat(F.lit("'"), e["name"], F.lit("': '"), e["value"], F.lit("'")))
        key = F.concat(F.lit("EventID "), F.col("event"), F.lit(" - {"), F.array_join(shown, ", "), F.lit("}"))
        message = F.concat(F.lit("Unknown event ID: '"), F.col("event"), F.lit("'"))
        return rows.select("ord", *ORIGIN, F.lit(1.0).alias("score"), F.create_map(key, message).alias("found"))

    def transform(self, parsed: DataFrame) -> DataFrame:
        return alerts(self.scored_records(parsed), self.name, self.kind, self.description.format(name=self.name))


class NewValueCombo(Detector):
    """Combinations of an instance's variables that training didn't see. A record that lacks one of them is silent."""

    kind = "new_value_combo_detector"

    def fit(self, parsed: DataFrame) -> NewValueCombo:
        self.model = durable(combinations(parsed, self.watched).select("event", "instance", "name", "value").distinct(), self.kind)
        return self

    def findings(self, parsed: DataFrame) -> DataFrame:
        key = ["event", "instance", "name"]
        rows = combinations(with_origin(parsed), self.watched, "ord", *ORIGIN)
        known = self.model.select(*key).distinct()
        odd = rows.drop("ord", *ORIGIN).distinct().join(known, key, "left_semi").join(self.model, [*key, "value"], "left_anti")
        shown = F.concat(F.lit("("), quoted_list(F.col("value")), F.when(F.size("value") == 1, F.lit(",")).otherwise(F.lit("")), F.lit(")"))
        odd = odd.withColumn("message", F.concat(F.lit("Unknown value combination: "), shown))
        return rows.join(odd, [*key, "value"])


@dataclass
class ValueRange(Detector):
    """Numbers outside the range of training. strict: a value that isn't a number is an error, else it is left out."""

    strict: bool = False
    kind: ClassVar[str] = "value_range_detector"

    def _numbers(self, values: DataFrame) -> DataFrame:
        x = as_number(F.col("value"))
        if self.strict:
            x = F.when(x.isNull() & F.col("value").isNotNull(), F.raise_error(F.concat(F.lit("not a number: "), F.col("value")))).otherwise(x)
        return values.withColumn("number", x.cast("double")).where("number is not null")

    def learn(self, values: DataFrame) -> DataFrame:
        return self._numbers(values).groupBy(*VARIABLE).agg(F.min("number").alias("low"), F.max("number").alias("high"))

    def unusual(self, values: DataFrame) -> DataFrame:
        odd = self._numbers(values).join(self.model, VARIABLE).where("number < low or number > high")
        text = lambda c: number_text(F.col(c))
        message = F.concat(F.lit("Out of range value: '"), text("number"), F.lit("' ("), text("low"), F.lit(" - "), text("high"), F.lit(")"))
        return odd.select(*VARIABLE, "value", message.alias("message"))


class Charset(Detector):
    """Characters that a variable didn't have in training."""

    kind = "charset_detector"
    description = "{name} detects characters not encountered in training as anomalies."

    def learn(self, values: DataFrame) -> DataFrame:
        return values.select(*VARIABLE, F.explode(F.array_distinct(characters(F.col("value")))).alias("c")).distinct().groupBy(*VARIABLE).agg(F.collect_set("c").alias("chars"))

    def unusual(self, values: DataFrame) -> DataFrame:
        unknown = F.array_sort(F.array_except(F.array_distinct(characters(F.col("value"))), "chars"))
        odd = values.join(self.model, VARIABLE).withColumn("unknown", unknown).where(F.size("unknown") > 0)
        return odd.select(*VARIABLE, "value", F.concat(F.lit("Unknown character(s): "), quoted_list(F.col("unknown"))).alias("message"))


@dataclass
class BigramFrequency(Detector):
    """Values whose pairs of neighbouring characters are rare on average.

    once: a value counts once however often training has it. defaults: (a, b, n), counts of pairs to fall back to for pairs
    that training lacks. double: each value after a variable's first counts twice, which some programs do.
    """

    threshold: float = 0.05
    once: bool = True
    defaults: DataFrame | None = None
    double: bool = False
    kind: ClassVar[str] = "bigram_frequency_detector"
    description: ClassVar[str] = "{name} anomalies in the bigram frequencies."

    def fit(self, parsed: DataFrame) -> BigramFrequency:
        self.model = durable(self.learn(watched_variables(parsed, self.watched, "ord")), self.kind)
        return self

    def learn(self, values: DataFrame) -> DataFrame:
        counted = values.groupBy(*VARIABLE, "value").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
        weight = F.lit(1) if self.once else F.col("n")
        if self.double:
            first = counted.groupBy(*VARIABLE).agg(F.min("ord").alias("first"))
            weight = 2 * weight - (F.col("ord") == F.col("first")).cast("int")
            counted = counted.join(first, VARIABLE)
        pairs = counted.select(*VARIABLE, F.explode(bigrams(F.col("value"))).alias("p"), weight.alias("n"))
        return pairs.groupBy(*VARIABLE, "p.a", "p.b").agg(F.sum("n").alias("n"))

    def chances(self, values: DataFrame) -> DataFrame:
        """(event, name, value, chance): the mean probability of each value's pairs."""
        total = self.model.groupBy(*VARIABLE, "a").agg(F.sum("n").alias("total"))
        table = self.model.join(total, [*VARIABLE, "a"]).select(*VARIABLE, "a", "b", (F.col("n") / F.col("total")).alias("p"))
        pairs = values.join(self.model.select(*VARIABLE).distinct(), VARIABLE, "left_semi").select("*", F.explode(bigrams(F.col("value"))).alias("_p")).select(*VARIABLE, "value", "_p.a", "_p.b")
        pairs = pairs.join(table, [*VARIABLE, "a", "b"], "left")
        if self.defaults is not None:
            whole = self.defaults.groupBy("a").agg(F.sum("n").alias("_total"))
            usual = self.defaults.join(whole, "a").select("a", "b", (F.col("n") / F.col("_total")).alias("_usual"))
            pairs = pairs.join(usual, ["a", "b"], "left").withColumn("p", F.coalesce("p", "_usual"))
        return pairs.groupBy(*VARIABLE, "value").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("chance"))

    def unusual(self, values: DataFrame) -> DataFrame:
        odd = self.chances(values).where(F.col("chance") < self.threshold)
        message = F.concat(F.lit("Bigram frequency anomaly with value "), F.col("value"), F.lit(", critical_val "), F.col("chance").cast("string"), F.lit(f" and threshold {self.threshold}."))
        return odd.select(*VARIABLE, "value", message.alias("message"))

    def scored(self, findings: DataFrame) -> DataFrame:
        """An event counts once, however many of its variables are unusual; variables watched in all events once more."""
        full = super().scored(findings).drop("score")
        levels = findings.groupBy("ord").agg(F.count_distinct(F.col("event") == ANY_EVENT).cast("double").alias("score"))
        return full.join(levels, "ord")


#: The rules' messages, and words that tell of a failure.
FAILURES = ("exception", "fail", "error", "raise")


class RuleNotFound(ValueError):
    pass


@dataclass
class Rules(Detector):
    """Fixed rules; the score is how many fire. rules: (id, words), words only for R002."""

    rules: tuple[tuple[str, tuple[str, ...]], ...] = (("R001 - TemplateNotFound", ()), ("R003 - CheckForExceptions", ()), ("R004 - ErrorLevelFound", ()))
    kind: ClassVar[str] = "rule_detector"

    def fit(self, parsed: DataFrame) -> Rules:
        return self

    def _rule(self, rule: str, words: tuple[str, ...]) -> Column:
        """The message where the rule fires, else null."""
        first = lambda ws: F.coalesce(*(F.when(F.contains(F.lower("log"), F.lit(w)), F.lit(f"Found word '{w}' in the logs")) for w in ws), F.lit(None).cast("string"))
        number = rule.split(" ")[0]
        if number == "R001":
            return F.when(F.col("EventID") == -1, "No template found by parser")
        if number == "R002":
            return first(words)
        if number == "R003":
            return first(FAILURES)
        if number == "R004":
            return F.when(F.lower(F.try_element_at("logFormatVariables", F.lit("Level"))) == "error", "Error found")
        raise RuleNotFound(rule)

    def scored_records(self, parsed: DataFrame) -> DataFrame:
        entries = [F.when(m.isNotNull(), F.struct(F.lit(r).alias("key"), m.alias("value"))) for r, m in ((r, self._rule(r, w)) for r, w in self.rules)]
        fired = with_origin(parsed).select("ord", *ORIGIN, F.array_compact(F.array(*entries)).alias("e")).where(F.size("e") > 0)
        return fired.select("ord", *ORIGIN, F.size("e").cast("double").alias("score"), F.map_from_entries("e").alias("found"))

    def transform(self, parsed: DataFrame) -> DataFrame:
        return alerts(self.scored_records(parsed), self.name, self.kind, "")


@dataclass
class Random(Detector):
    """A watched variable alerts by chance, for tests. The chance depends on the record's place and the seed alone."""

    threshold: float = 0.5
    seed: int = 0
    kind: ClassVar[str] = "random_detector"

    def fit(self, parsed: DataFrame) -> Random:
        return self

    def findings(self, parsed: DataFrame) -> DataFrame:
        rows = watched_variables(with_origin(parsed), self.watched, "ord", *ORIGIN)
        u = chance(F.col("ord"), F.col("event"), F.col("name"), F.lit(self.seed))
        return rows.where(u > self.threshold).withColumn("message", F.lit("1.0"))


def chance(*parts: Column) -> Column:
    """A number from 0 to below 1 that depends on the parts alone: the first 13 hex digits of their MD5."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") * 2.0**-52


def coverage(model_events: DataFrame, watched: list[Watched], seen: DataFrame) -> tuple[list[str], list[str]]:
    """(configured events that training didn't see, those it saw without any watched variable)."""
    wanted = sorted({w.event for w in watched if w.event != ANY_EVENT})
    events = {r[0] for r in seen.select(F.col("EventID").cast("string")).where(F.col("EventID").cast("string").isin(*wanted)).distinct().collect()} if wanted else set()
    modelled = {r[0] for r in model_events.select("event").where(F.col("event").isin(*wanted)).distinct().collect()} if wanted else set()
    return [e for e in wanted if e not in events], [e for e in wanted if e in events and e not in modelled]
