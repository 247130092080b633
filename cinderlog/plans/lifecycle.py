"""The life of a detector over one ordered input: configure, train, detect.

The first `configure` units choose the variables to watch, the next `train` units (after the configuring ones again, if
replay) are learned from, all units after those are scored. A unit is a record, or for window detectors a window: `train`
windows of n records are train + n - 1 records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.operators.detectors import Detector, Random, Rules
from cinderlog.operators.order import phase
from cinderlog.operators.sequences import WindowDetector
from cinderlog.operators.stability import classify, select_variables, value_changes
from cinderlog.operators.variables import all_variables
from cinderlog.plans.config import Watched

#: Detectors that learn nothing score the training units too.
STATELESS = (Rules, Random)


def first_unit_record(detector: Detector | WindowDetector, unit: int) -> int:
    """How many records the units before this one are made of."""
    return unit + detector.size - 1 if isinstance(detector, WindowDetector) and unit else unit


def with_phase(parsed: DataFrame, configure: int | None, train: int | None, size: int = 1) -> DataFrame:
    """parsed with `phase`: of the unit that a record completes; records before the first full window complete none."""
    unit = F.col("ord") - (size - 1)
    return parsed.withColumn("phase", F.when(unit >= 0, phase(unit, configure, train)))


def choose_variables(parsed: DataFrame, *, changes: Callable[[DataFrame], DataFrame] = value_changes, mode: str = "count", time: Column | None = None, stable: bool = True, static: bool = True) -> list[Watched]:
    """The variables, of all in the configuring records, whose series are stable or static. changes: what counts as a change,
    as the detector sees it."""
    rows = all_variables(parsed.withColumn("_time", time if time is not None else F.lit(None).cast("double")), "ord", "_time")
    return select_variables(classify(changes(rows), mode=mode, time="_time"), stable=stable, static=static)


def choose_combinations(parsed: DataFrame, most: int = 2, **options) -> list[Watched]:
    """Instances of 2 to `most` variables that are stable one by one and together."""
    from itertools import combinations as choose

    single = choose_variables(parsed, stable=True, static=False, **options)
    out: list[Watched] = []
    by_event: dict[str, list[Watched]] = {}
    for w in single:
        by_event.setdefault(w.event, []).append(w)
    candidates = [[Watched(w.event, "_".join(x.name for x in group), w.name, w.position) for w in group] for ws in by_event.values() for n in range(2, most + 1) for group in choose(ws, n)]
    if not candidates:
        return []
    from cinderlog.operators.variables import combinations

    rows = combinations(parsed, [w for group in candidates for w in group], "ord")
    series = rows.select("ord", "event", F.col("instance").alias("name"), F.array_join("value", "\u001f").alias("value"))
    chosen = {(r.event, r.name) for r in classify(value_changes(series)).where(F.col("class") == "STABLE").select("event", "name").collect()}
    for group in candidates:
        if (group[0].event, group[0].instance) in chosen:
            out += group
    return out


def run(detector: Detector | WindowDetector, parsed: DataFrame, *, configure: int | None = None, train: int | None = None, replay: bool = True, auto: Callable[[DataFrame], list[Watched]] | None = None) -> DataFrame:
    """Alerts of the detection units."""
    c, t = configure or 0, train or 0
    start = first_unit_record(detector, c)
    end = first_unit_record(detector, c + t)
    if c and auto is not None:
        detector.watched = auto(parsed.where(F.col("ord") < start))
    learn_from = 0 if replay or not c else c
    if end > learn_from:
        detector.fit(parsed.where((F.col("ord") >= learn_from) & (F.col("ord") < end)))
    elif not isinstance(detector, STATELESS):
        return detector.fit(parsed.limit(0)).transform(parsed).limit(0)
    if isinstance(detector, STATELESS):
        return detector.transform(parsed.where(F.col("ord") >= start))
    if isinstance(detector, WindowDetector):
        return detector.transform(parsed.where(F.col("ord") >= c + t))
    return detector.transform(parsed.where(F.col("ord") >= end))


def chain(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A pipeline of components; what a component filters out, the next ones don't get."""
    for step in steps:
        df = df.transform(step)
    return df
