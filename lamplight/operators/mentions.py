"""Mentions of entities in text: search, overlap, suppression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

SHORTEST = 3  #: characters of a label that is searched for
FEW = 1000  #: labels up to which each text is searched for all of them; beyond, for those that share a trigram with it


def folded(c: Column) -> Column:
    """In lower case, character by character: places are those of the text itself. U+0130 alone would become two."""
    return F.lower(F.translate(c, "\u0130", "i"))


@F.pandas_udf(ArrayType(LongType()))
def _places(text: pd.Series, label: pd.Series) -> pd.Series:
    def find(t: str, x: str) -> list[int]:
        out, at = [], t.find(x)
        while at >= 0:
            out.append(at)
            at = t.find(x, at + len(x))
        return out

    return pd.Series([find(t, x) for t, x in zip(text, label, strict=True)])


def occurrences(texts: DataFrame, labels: DataFrame, text: str, on: list[str] | None = None) -> DataFrame:
    """texts x labels (entity_id, label): a row (start, end) per occurrence, left to right, none overlapping, in any case.

    With on, texts have labels of their own, by columns that both share, and are never broadcast: what comes out of Python
    is taken for less than it is. Without, a few labels go along with each text; more are joined by their first trigram, so
    that a text meets only labels it may hold.
    """
    labels = labels.where(F.length("label") >= SHORTEST)
    rest = [c for c in labels.columns if c not in (on or [])]
    texts_ = texts.withColumn("_low", folded(F.col(text)))
    if on:
        pairs = texts.hint("merge").join(labels, on).withColumn("_low", folded(F.col(text)))
    else:
        held = labels.limit(FEW + 1).collect()
        if len(held) <= FEW:
            kind = labels.schema
            each = F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in kind)) for r in held)) if held else F.array().cast(f"array<{kind.simpleString()}>")
            pairs = texts_.select("*", F.explode(F.filter(each, lambda x: F.contains(F.col("_low"), folded(x["label"])))).alias("_l")).select(*texts_.columns, "_l.*")
        else:
            chars, join = F.split("_low", ""), lambda a, b: F.concat(a, b)
            grams = F.array_distinct(F.zip_with(F.zip_with(chars, F.slice(chars, 2, F.length("_low")), join), F.slice(chars, 3, F.length("_low")), join))
            pairs = texts_.select("*", F.explode(grams).alias("_gram")).join(labels.withColumn("_gram", F.substring(folded(F.col("label")), 1, SHORTEST)), "_gram").drop("_gram")
    pairs = pairs.where(F.contains("_low", folded(F.col("label"))))
    out = pairs.select(*texts.columns, *rest, F.explode(_places(F.col("_low"), folded(F.col("label")))).alias("start"))
    return out.withColumn("end", F.col("start") + F.length("label"))


def overlapping(segments: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a segment and a mention (m_start, m_end) of one document whose ranges overlap."""
    return segments.join(mentions, keys).where((F.col("m_start") < F.col("end")) & (F.col("m_end") > F.col("start")))


def suppress(df: DataFrame, keys: list[str], mention: list[str]) -> DataFrame:
    """Of each segment's mentions (start, end, ...) by start and then the longest, those that begin where none before covers."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start"), (-F.col("end")).alias("n"), F.col("end"), *mention))).alias("m"))
    begin = F.struct(F.lit(-1).cast("long").alias("cursor"), F.filter("m", lambda x: F.lit(False)).alias("out"))

    def step(a: Column, x: Column) -> Column:
        take = x["start"] >= a["cursor"]
        return F.struct(F.when(take, x["end"]).otherwise(a["cursor"]).alias("cursor"), F.when(take, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"))

    return rows.select(*keys, F.explode(F.aggregate("m", begin, step, lambda a: a["out"])).alias("x")).select(*keys, "x.start", "x.end", *(f"x.{c}" for c in mention))


def merge(groups: list[DataFrame]) -> DataFrame:
    """One row per (source_id, kind, entity_id, start, end): the first group that has it."""
    out = groups[0].withColumn("_g", F.lit(0))
    for i, g in enumerate(groups[1:], 1):
        out = out.unionByName(g.withColumn("_g", F.lit(i)))
    key = ["source_id", "kind", "entity_id", "start", "end"]
    rest = [c for c in out.columns if c not in (*key, "_g")]
    return out.groupBy(*key).agg(F.min_by(F.struct(*rest), "_g").alias("r")).select(*key, "r.*")
