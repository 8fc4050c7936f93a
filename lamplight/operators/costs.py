"""Runs of models: costs, evaluation, choice, retries, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUCCESS = ["success", "cached"]


def cost_summary(records: DataFrame, by: str, cost: str, tokens: str) -> DataFrame:
    """(by, records, tokens, cost_usd) per value of by, and in all (by null), from one pass."""
    out = records.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.count("*").alias("records"), F.sum(tokens).cast("long").alias("tokens"), F.sum(cost).alias("cost_usd"), F.grouping(by).alias("whole"))
    return out.select(F.when(F.col("whole") == 1, None).otherwise(F.col(by)).alias(by), "records", "tokens", "cost_usd")


def cost_by_stage(records: DataFrame, costs: dict[str, str], tokens: dict[str, str]) -> DataFrame:
    """(stage, records, tokens, cost_usd): stage columns unpivoted; rows with neither cost nor tokens are left out."""
    stages = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(c).cast("double").alias("cost"), F.col(tokens[s]).cast("double").alias("tokens")) for s, c in costs.items())))
    rows = records.select(stages.alias("s")).select("s.*").where("cost <> 0 or tokens <> 0")
    return rows.groupBy("stage").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost_usd"))


def model_eval(records: DataFrame, model: str, status: str, counts: list[str], cost: str) -> DataFrame:
    """Per model: pages, success_rate (4 places), sums of counts over successful pages, and cost."""
    good = F.col(status).isin(SUCCESS)
    out = records.groupBy(model).agg(F.count("*").alias("pages"), F.round(F.avg(good.cast("double")), 4).alias("success_rate"), *(F.sum(F.when(good, F.col(c)).otherwise(0)).cast("long").alias(c) for c in counts), F.sum(cost).alias("cost_usd"))
    return out.withColumn("schema_errors", F.lit(0).cast("long"))


def choose_model(evals: DataFrame, model: str, counts: list[str], slate: str) -> DataFrame:
    """The best model: success, fewest schema errors, most of each count, then first in the slate."""
    return evals.orderBy(F.col("success_rate").desc(), F.col("schema_errors").asc(), *(F.col(c).desc() for c in counts), F.col(slate).asc()).limit(1)


def retry_totals(attempts: DataFrame, call: str, attempt: str, sums: list[str], outcome: str) -> DataFrame:
    """Per call: attempts, sums over all of them, and the outcome of the last."""
    return attempts.groupBy(call).agg(F.count("*").alias("attempts"), *(F.sum(c).alias(c) for c in sums), F.max_by(outcome, attempt).alias(outcome))


def cache_split(wanted: DataFrame, cached: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of what is wanted."""
    return wanted.join(cached, on, "left_semi"), wanted.join(cached, on, "left_anti")


def cache_inventory(entries: DataFrame, by: str, cost: str) -> DataFrame:
    """Entries and cost per configuration, and in all (by null)."""
    return entries.rollup(by).agg(F.count("*").alias("entries"), F.sum(cost).alias("cost_usd"))


def briefing_needed(pages: DataFrame, page: str, hit: str) -> DataFrame:
    """Per page: whether any model's bundle is missing."""
    return pages.groupBy(page).agg((~F.bool_and(hit)).alias("needed"))
