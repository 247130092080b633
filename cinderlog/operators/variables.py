"""Long form: one row for each record and variable, the spine of all detectors that learn values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.plans.config import ANY_EVENT, Watched

#: Header fields that no detector tracks unless told to.
IGNORED = ("Content",)


def _entry(event: Column, name: Column, value: Column) -> Column:
    return F.struct(event.cast("string").alias("event"), name.alias("name"), value.cast("string").alias("value"))


def all_variables(parsed: DataFrame, *keep: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(keep, event, name, value) of every positional variable (var_0, ...) and header field."""
    placed = F.transform("variables", lambda v, i: _entry(F.col("EventID"), F.concat(F.lit("var_"), i.cast("string")), v))
    header = F.transform(F.map_entries("logFormatVariables"), lambda e: _entry(F.col("EventID"), e["key"], e["value"]))
    header = F.filter(header, lambda e: ~e["name"].isin(*ignored)) if ignored else header
    return _opened(parsed, keep, F.concat(F.coalesce(placed, F.array().cast(placed_type)), F.coalesce(header, F.array().cast(placed_type))))


placed_type = "array<struct<event:string,name:string,value:string>>"


def watched_entries(watched: list[Watched]) -> Column:
    """The watched variables that a record has, as one array: those out of its range, and absent fields, are left out.

    Picked before rows are multiplied, so a record costs as many rows as it has watched variables."""
    parts = []
    for w in watched:
        value = F.try_element_at("logFormatVariables", F.lit(w.name)) if w.header else F.get("variables", F.lit(w.position))
        event = F.lit(ANY_EVENT) if w.event == ANY_EVENT else F.col("EventID")
        applies = F.lit(True) if w.event == ANY_EVENT else F.col("EventID").cast("string") == w.event
        parts.append(F.when(applies & value.isNotNull(), _entry(event, F.lit(w.name), value)))
    return F.array_compact(F.array(*parts)).cast(placed_type) if parts else F.array().cast(placed_type)


def watched_variables(parsed: DataFrame, watched: list[Watched], *keep: str) -> DataFrame:
    """(keep, event, name, value) of the watched variables; event is ANY_EVENT for those watched in all events."""
    return _opened(parsed, keep, watched_entries(watched))


def _opened(parsed: DataFrame, keep: tuple[str, ...], entries: Column) -> DataFrame:
    return parsed.select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.event", "_e.name", "_e.value")


def combinations(parsed: DataFrame, watched: list[Watched], *keep: str) -> DataFrame:
    """(keep, event, instance, name, value): the watched variables of each instance taken together, in order.

    name is the names joined by ', '; value an array. A record that lacks one of them has another name, and so no model.
    """
    groups: dict[tuple[str, str], list[Watched]] = {}
    for w in watched:
        groups.setdefault((w.event, w.instance), []).append(w)
    parts = []
    for (event, instance), members in groups.items():
        entries = watched_entries(members)
        full = F.struct(
            (F.lit(ANY_EVENT) if event == ANY_EVENT else F.col("EventID").cast("string")).alias("event"),
            F.lit(instance).alias("instance"),
            F.array_join(F.transform(entries, lambda e: e["name"]), ", ").alias("name"),
            F.transform(entries, lambda e: e["value"]).alias("value"),
        )
        applies = F.size(entries) > 0
        parts.append(F.when(applies, full))
    if not parts:
        return parsed.select(*keep, F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("instance"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<string>").alias("value")).where(F.lit(False))
    return parsed.select(*keep, F.explode(F.array_compact(F.array(*parts))).alias("_e")).select(*keep, "_e.*")
