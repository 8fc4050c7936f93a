"""Contracts of rows and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validation_errors(df: DataFrame, schema: str, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """(schema, id, path, message) per broken rule: rules give, per path, what must hold (null counts as broken)."""
    broken = F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))) for path, (test, message) in rules.items()))
    return df.select(F.lit(schema).alias("schema"), F.col(key).cast("string").alias("id"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("e")).select("schema", "id", "e.path", "e.message")


def missing(expected: Column, actual: Column) -> Column:
    """What is expected and not there, sorted; nulls don't count."""
    clean = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.array_sort(F.array_except(clean(expected), clean(actual)))


def unresolved(targets: DataFrame, ids: DataFrame, target: str, on: str) -> DataFrame:
    """Targets that name no id; character ranges are exempt."""
    return targets.where(~F.col(target).rlike(r"#char-(\d+)-(\d+)$")).join(ids.withColumnRenamed(on, target), target, "left_anti")
