"""Ordered text: segments, offsets, markers, sections, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions.text import classify_line, lines, marker_label, page_ref


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_index, line) of the normalized lines of each document."""
    return docs.select(key, F.posexplode(lines(F.col(text))).alias("line_index", "line"))


def page_markers(rows: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, line_index, label, page_ref) of the marker lines."""
    out = rows.withColumn("label", marker_label(F.col("line"))).where("label is not null")
    order = F.row_number().over(Window.partitionBy(key).orderBy("line_index")) - 1
    return out.select(key, order.alias("ordinal"), "line_index", "label", page_ref(F.col("label")).alias("page_ref"))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], marks: Column, value: Column, name: str, keep_null: bool = True) -> DataFrame:
    """Adds the value of the latest marked row. With keep_null a marked null overwrites; else the value before stays."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if keep_null:
        return df.withColumn(name, F.last(F.when(marks, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"])
    return df.withColumn(name, F.last(F.when(marks, value), ignorenulls=True).over(w))


def content_blocks(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_index, line, kind, page_ref) per line."""
    marked = rows.withColumn("_label", marker_label(F.col("line")))
    filled = forward_fill(marked, [key], ["line_index"], F.col("_label").isNotNull(), page_ref(F.col("_label")), "page_ref")
    return filled.withColumn("kind", classify_line(F.col("line"))).drop("_label")


def sections(df: DataFrame, keys: list[str], order: list[str], marks: Column, name: str = "section") -> DataFrame:
    """Adds the running number of marked rows and drops what stands before the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(marks.cast("int")).over(w)).where(F.col(name) > 0)


def offsets(df: DataFrame, keys: list[str], order: list[str], text: str, joiner: int = 1) -> DataFrame:
    """Adds start and end, in characters, of each text in its document's texts joined in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("start", F.coalesce(F.sum(F.length(text) + joiner).over(w), F.lit(0)).cast("long"))
    return out.withColumn("end", F.col("start") + F.length(text))


def prior_units(df: DataFrame, keys: list[str], order: list[str], unit: Column, n: int = 3) -> DataFrame:
    """Adds prior: the n units before, in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    return df.withColumn("prior", F.collect_list(unit).over(w))


def greedy_chunks(df: DataFrame, key: str, order: str, size: Column, limit: float) -> DataFrame:
    """(key, order, chunk): a new chunk begins when size would pass the limit; what is larger stands alone.

    Sequential within a document: a fold over its ordered sizes.
    """
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("double").alias("s")))).alias("rows"))
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["chunk"] < 0) | ((a["sum"] + x["s"] > limit) & (a["sum"] > 0))
        chunk = F.when(new, a["chunk"] + 1).otherwise(a["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, x["s"]).otherwise(a["sum"] + x["s"]).alias("sum"), F.concat(a["out"], F.array(chunk)).alias("out"))

    rows = rows.withColumn("chunks", F.aggregate("rows", start, step, lambda a: a["out"]))
    return rows.select(key, F.explode(F.arrays_zip(F.col("rows"), F.col("chunks"))).alias("z")).select(key, F.col("z.rows.o").alias(order), F.col("z.chunks").alias("chunk"))
