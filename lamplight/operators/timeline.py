"""Filters, facets, orders and timelines of what a reader looks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_filter(date: Column, start: str | None, end: str | None, confidence: Column, least: float) -> Column:
    """Undated rows stay; a null confidence is 0."""
    day = F.coalesce(F.substring(date, 1, 10), F.lit(""))
    out = F.coalesce(confidence, F.lit(0.0)) >= least
    if start:
        out &= (day == "") | (day >= start)
    return out & ((day == "") | (day <= end)) if end else out


def date_range(date: Column, start: str | None, end: str | None) -> Column:
    """Undated rows go as soon as either bound is set."""
    day, out = F.coalesce(F.substring(date, 1, 10), F.lit("")), F.lit(True)
    if start:
        out &= (day != "") & (day >= start)
    return out & (day != "") & (day <= end) if end else out


def haystack(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def historical(kind: Column, title: Column, kinds: list[str], terms: list[str]) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    out = ~F.lower(F.coalesce(kind, F.lit(""))).isin(kinds)
    for t in terms:
        out &= ~low.contains(t)
    return out


def first_rule(text: Column, rules: list[tuple[str, list[str]]], other: str) -> Column:
    """The first kind any of whose terms the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)), kind) for kind, terms in rules), F.lit(other))


def grouped(refs: DataFrame, key: list[str], order: list[str], source: str, fields: list[str]) -> DataFrame:
    """Per key: the first reference's fields, the number of distinct sources, and the place of the first."""
    place = F.struct(*order)
    return refs.groupBy(*key).agg(F.min_by(F.struct(*fields), place).alias("_f"), F.count_distinct(source).alias("sources"), F.min(place).alias("first_at")).select(*key, "_f.*", "sources", "first_at")


def facet_options(df: DataFrame, value: str, label: str, order: list[str]) -> DataFrame:
    """(value, label): distinct values with their last label."""
    return df.groupBy(value).agg(F.max_by(label, F.struct(*order)).alias(label))


def source_order() -> list[Column]:
    """By date, volume and first page, nulls last, and title; an empty string is no value."""
    return [*(F.nullif(F.col(c), F.lit("")).asc_nulls_last() for c in ("date", "volume")), F.col("page_start").asc_nulls_last(), F.col("title")]
