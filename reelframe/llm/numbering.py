"""Running sums and row numbers over large groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers together, on average.
TOGETHER = 8192


def with_running(df: DataFrame, group: list[str], bucket: Column, order: list[Column], amount: Column, name: str) -> DataFrame:
    """The rows with a column of the sum of amount over the rows before them in their group.

    Rows of a group are ordered by bucket, then by order. Sums of whole buckets are added up first, so a group's
    rows spread over as many tasks as it has buckets; only its list of buckets is in one place.
    """
    own = df.withColumn("__b", bucket).withColumn("__x", amount.cast("long"))
    whole = own.groupBy(*group, "__b").agg(F.sum("__x").alias("__s"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("__o", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    inside = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("__i", F.coalesce(F.sum("__x").over(inside), F.lit(0)))
    return own.join(whole, [*group, "__b"]).withColumn(name, F.col("__i") + F.col("__o")).drop("__b", "__x", "__i", "__o")
