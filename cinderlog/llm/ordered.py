"""Neighbours in a total order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderlog.runtime import durable


def neighbours(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `prior` and `following`: structs of the rows beside each row in the ascending order of `order`, which is
    total; null at the ends. df is cut into ranges; one row a range, as many as there are tasks, links these up."""
    columns = [*order, *(c for c in df.columns if c not in order)]
    parts = durable(df.select(*columns).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    row, line = F.struct(*columns), Window.orderBy("_at")
    ends = parts.groupBy(F.col("_part").alias("_at")).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    ends = ends.select("_at", F.lag("last").over(line).alias("_before"), F.lead("first").over(line).alias("_after"))
    inner = Window.partitionBy("_part").orderBy(*order)
    near = parts.select("*", F.lag(row).over(inner).alias("prior"), F.lead(row).over(inner).alias("following")).join(F.broadcast(ends), F.col("_part") == F.col("_at"))
    return near.select(*df.columns, F.coalesce("prior", "_before").alias("prior"), F.coalesce("following", "_after").alias("following"))
