"""Gapless numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(df: DataFrame, group: list[str], order: list[Column], name: str, coarse: Column) -> DataFrame:
    """Adds name: 0, 1, ... within each group, ordered by coarse (an integer that splits large groups) and then by order.

    Windows run within (group, coarse); the offsets of these come from counts, which are aggregated before they shuffle.
    """
    df = df.withColumn("_coarse", coarse)
    counts = df.groupBy(*group, "_coarse").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(c).alias(f"_{c}") for c in group), F.col("_coarse").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_coarse").eqNullSafe(F.col("_c"))
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.row_number().over(Window.partitionBy(*group, "_coarse").orderBy(*order)) - 1
    return df.withColumn("_within", within).join(counts, same).withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_coarse", "_c", "_before", "_within", *(f"_{c}" for c in group))
