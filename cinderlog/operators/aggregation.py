"""Aggregation of alerts: every `size` alerts in a row become one record of all that they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.operators.order import sliding, tumbling, with_ordinal

DESCRIPTION = "Basic aggregation by alert concatenation"


def concatenate(alerts: DataFrame, size: int = 3, *, order: tuple[str, ...] = ("ord", "alertID"), slide: bool = True, description: str = DESCRIPTION, clock: Column | None = None) -> DataFrame:
    """Aggregates of alerts; slide: one for each alert from the size-th on, so alerts repeat, else one for each `size`.

    alertsObtain stays empty, as it does in the aggregates that this stands for."""
    rows = with_ordinal(alerts, *order, ordinal="_a").drop("ord").withColumnRenamed("_a", "ord")
    fields = ("detectorID", "detectorType", "alertID", "logIDs", "extractedTimestamps")
    full = sliding(rows, size, *fields) if slide else tumbling(rows.select("ord", *fields), size)
    pick = lambda name: F.transform("records", lambda r: r[name])
    now = clock if clock is not None else F.unix_timestamp()
    return full.select(
        "window",
        pick("detectorID").alias("detectorIDs"),
        pick("detectorType").alias("detectorTypes"),
        pick("alertID").alias("alertIDs"),
        now.alias("outputTimestamp"),
        F.flatten(pick("logIDs")).alias("logIDs"),
        F.flatten(pick("extractedTimestamps")).alias("extractedTimestamps"),
        F.lit(description).alias("description"),
        F.create_map().cast("map<string,string>").alias("alertsObtain"),
    )
