"""Entities: ordered merges, identifier maps, lookups by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType, StructType

from lamplight.functions.text import label_variants, normalize_label


def _held(c: Column, kind) -> Column:
    """Whether a field counts as filled: not null, not '', not []."""
    if isinstance(kind, StringType):
        return c.isNotNull() & (c != "")
    if isinstance(kind, ArrayType):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def _fold(c: Column, name: str, kind, order: Column, sort_lists: bool) -> Column:
    if isinstance(kind, StructType):
        return F.struct(*(_fold(c[f.name], f.name, f.dataType, order, sort_lists).alias(f.name) for f in kind))
    if name == "confidence" and isinstance(kind, NumericType):
        return F.max(c)
    if isinstance(kind, ArrayType) and sort_lists:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    if isinstance(kind, ArrayType):
        held = F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("v")))
        return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(held), lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)), lambda x: x["v"])))
    return F.min_by(F.when(_held(c, kind), c), F.when(_held(c, kind), order))


def merge_entities(items: DataFrame, key: str, order: list[str], sort_lists: bool = True) -> DataFrame:
    """One row per key, items folded in order: confidence takes the largest, lists their sorted distinct union, structs
    fold field by field, and other fields the first value that isn't empty. Without sort_lists, list elements stay in the
    order of their items. Aggregates alone, so partial before they shuffle."""
    place = F.struct(*order)
    return items.groupBy(key).agg(*(_fold(F.col(f.name), f.name, f.dataType, place, sort_lists).alias(f.name) for f in items.schema if f.name not in (key, *order)))


def id_map(items: DataFrame, old: str, new: str, order: list[str]) -> DataFrame:
    """(old_id, canonical_id): the last canonical id of each old one."""
    return items.groupBy(F.col(old).alias("old_id")).agg(F.max_by(new, F.struct(*order)).alias("canonical_id"))


def rewrite_id(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The column by the map; what it lacks stays."""
    return df.join(ids.withColumnRenamed("old_id", column), column, "left").withColumn(column, F.coalesce("canonical_id", column)).drop("canonical_id")


def rewrite_ids(df: DataFrame, key: str, column: str, ids: DataFrame) -> DataFrame:
    """(key, column): array elements by the map, without nulls, distinct and sorted."""
    out = rewrite_id(df.select(key, F.explode_outer(column).alias("_id")), "_id", ids)
    return out.groupBy(key).agg(F.array_sort(F.collect_set("_id")).alias(column))


def find_entity(refs: DataFrame, pool: DataFrame, ref: str) -> DataFrame:
    """refs (ref, canonical_id, label) with entity_id: the pool's entity of that id, else the first in pool order any of
    whose label variants equals any of the reference's. pool: (entity_id, ordinal, labels)."""
    by_id = refs.where(F.coalesce("canonical_id", F.lit("")) != "").join(pool.select(F.col("entity_id").alias("canonical_id")).distinct(), "canonical_id").select(ref, F.col("canonical_id").alias("entity_id"), F.lit(-1).cast("long").alias("o"))
    names = pool.select("entity_id", F.col("ordinal").cast("long").alias("o"), F.explode("labels").alias("l")).select("entity_id", "o", F.explode(label_variants(F.col("l"))).alias("v"))
    names = names.groupBy("v").agg(F.min_by("entity_id", "o").alias("entity_id"), F.min("o").alias("o"))  # the first of a label: no reference meets the others
    by_label = refs.select(ref, F.explode(label_variants(F.col("label"))).alias("v")).join(names, "v").select(ref, "entity_id", "o")
    best = by_id.union(by_label).groupBy(ref).agg(F.min_by("entity_id", "o").alias("entity_id"))
    return refs.join(best, ref, "left")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null key all stay."""
    rest = [c for c in df.columns if c not in keys]
    some = F.lit(True)
    for k in keys:
        some &= F.col(k).isNotNull()
    once = df.where(some).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    return once.select(df.columns).union(df.where(~some))


def pool_union(pools: list[DataFrame], key: str, order: str) -> DataFrame:
    """The pools in turn, one row per key, that of the first pool; rows without a key all stay."""
    out = pools[0].withColumn("_pool", F.lit(0))
    for i, p in enumerate(pools[1:], 1):
        out = out.unionByName(p.withColumn("_pool", F.lit(i)))
    return first_wins(out, [key], ["_pool", order]).drop("_pool")


def participants(given: Column, resolved: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(F.coalesce(given, F.array().cast("array<string>")), F.coalesce(resolved, F.array().cast("array<string>"))), lambda x: x.isNotNull()))


def ordered(order: str, value: str) -> Column:
    """Values of a group as an array in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def top(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def rank(df: DataFrame, keys: list[str], by: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long"))


def _first_label(*parts: Column) -> Column:
    return normalize_label(F.coalesce(*(F.nullif(p, F.lit("")) for p in parts), F.lit("")))


def person_key(display_name: Column, alternate_names: Column, identifier: Column) -> Column:
    """The label a person is grouped by: the first name there is, else the id."""
    return _first_label(display_name, F.get(F.filter(alternate_names, lambda x: F.coalesce(x, F.lit("")) != ""), 0), identifier)


def location_key(name: Column, address: Column, modern_address: Column, identifier: Column) -> Column:
    return _first_label(name, address, modern_address, identifier)


def event_key(title: Column, start: Column, place: Column) -> Column:
    return normalize_label(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (title, start, place))))


def rewrite_bundle(table: DataFrame, key: str, scalars: dict[str, DataFrame], lists: dict[str, DataFrame]) -> DataFrame:
    """A child table of bundles under canonical ids: scalar and list columns, each by the map of what it names."""
    for column, ids in scalars.items():
        table = rewrite_id(table, column, ids)
    for column, ids in lists.items():
        table = table.drop(column).join(rewrite_ids(table, key, column, ids), key)
    return table


def last_wins(dictionaries: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value): of all dictionaries, in turn, the last entry of each key. Each has ordinal, key and value."""
    out = dictionaries[0].select(F.lit(0).alias("_d"), "ordinal", key, value)
    for i, d in enumerate(dictionaries[1:], 1):
        out = out.union(d.select(F.lit(i), "ordinal", key, value))
    return out.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(value), F.struct("_d", "ordinal")).alias("v")).select(key, f"v.{value}")
