"""Exact weighted cuts of many ordered groups at once, without a sort: radix descent over aggregated histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, STEP = 48, 12  #: of a key, and of a round: groups of at most 4096 bins


def cut(points: DataFrame, targets: dict[int, float], key: Column, weight: Column, group: str = "node") -> dict[int, int]:
    """For each group, the smallest bound such that keys below it weigh nearest to the group's target.

    points: (group, ...) with non-negative integer keys under 2 ** BITS. Each of BITS / STEP rounds counts one histogram
    per group by aggregation and returns one row per group to the driver, which holds no more than the targets.
    """
    spark = points.sparkSession
    low, left = dict.fromkeys(targets, 0), dict.fromkeys(targets, 0.0)
    for shift in range(BITS - STEP, -1, -STEP):
        state = F.broadcast(spark.createDataFrame([(g, low[g], targets[g] - left[g]) for g in targets], f"{group} long, _low long, _need double"))
        near = points.select(group, key.alias("_key"), weight.alias("_w")).join(state, group).where(F.shiftright("_key", shift + STEP) == F.shiftright("_low", shift + STEP))
        bins = near.groupBy(group, "_need", F.shiftright("_key", shift).alias("_bin")).agg(F.sum("_w").alias("_w"))
        up = bins.withColumn("_sum", F.sum("_w").over(Window.partitionBy(group).orderBy("_bin")))
        # the bin in which the target lies: all before it weigh no more than what is needed
        rows = up.where("_sum - _w <= _need").groupBy(group).agg(F.max(F.struct("_bin", (F.col("_sum") - F.col("_w")).alias("before"), "_w")).alias("m")).select(group, "m.*").collect()
        for g, b, before, w in rows:
            low[g] = b << shift
            if shift == 0 and targets[g] - left[g] - before > before + w - (targets[g] - left[g]):
                low[g] += 1
            left[g] += before
    return low
