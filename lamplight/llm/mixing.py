"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamplight.llm.common import Scratch, free, small
from lamplight.llm.numbering import number


@dataclass(frozen=True)
class Params:
    """weights: of sources by code point (null last), repeating. limit: times its size to which a source's target goes.
    seed: of the offsets and of the order of documents of one size. salt: pieces of a group of one source and size."""

    weights: tuple[int, ...] = (1, 2, 3)
    limit: int = 3
    seed: int = 17
    salt: int = 64


def _hex(*parts):
    """The first 13 hex digits of an md5 as a double in [0, 1): the same in any SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, p: Params = Params()) -> DataFrame:
    """(source, source_size, docs, target, offset) of sizes (source, source_size, docs), one row a source.

    Water filling: target = least(limit * size, level * weight), where the level spends the whole. The windows run over
    one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, p.weights)), (turn % len(p.weights) + 1).cast("int")).cast("long")
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("turn"))
    out = sizes.withColumns({"turn": turn, "weight": weight, "cap": F.col("source_size") * p.limit})
    everything = Window.partitionBy()
    out = out.withColumns({"spent": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "shares": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(everything)})
    level = (F.col("total") - F.col("spent")) / F.col("shares")
    out = out.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return out.select("source", "source_size", "docs", target.alias("target"), _hex(F.lit(str(p.seed)), F.coalesce("source", F.lit(""))).alias("offset"))


def _key(docs: DataFrame):
    """128 bits of a row's doc_id, source and text, each null or not."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("\0", part("doc_id"), part("source"), part("text")).cast("binary")))


def copies(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, row_key, size, source, source_size, target, copies) for each row of docs (doc_id, text, source).

    size counts the words [^\\x20\\x09-\\x0D]+ of the text (null: 0). A source's documents, ordered by size, each expect
    target / source_size copies; prefix sums of these, plus one random offset, emit a copy per integer boundary crossed,
    so a source takes its target within about one document of each size. No row gets more than limit copies. Null is a
    source like any other. Repeated rows count each; ties of size are ordered by hash. An empty table gives none; a source
    without words takes none. Reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select("doc_id", "source", _key(docs).alias("row_key"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    sized = scratch.save(sized, "sized")
    # ranks by (size, tie): hot groups of one size are split by the leading bits of the tie
    tie = F.md5(F.concat_ws(":", F.lit(str(p.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    salt = (F.conv(F.substring("tie", 1, 4), 16, 10).cast("long") * p.salt / 65536).cast("long")
    ranked = number(sized.withColumn("tie", tie), ["source"], [F.col("tie"), F.col("doc_id"), F.col("row_key")], "rank", F.col("size") * p.salt + salt)
    plan = scratch.save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), p), "targets")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    cross = lambda k: F.floor(k * each + F.col("offset"))
    out = ranked.withColumnRenamed("source", "_source").join(small(plan), F.col("_source").eqNullSafe(F.col("source")))
    return out.select("doc_id", "row_key", "size", "source", "source_size", "target", (cross(F.col("rank") + 1) - cross(F.col("rank"))).cast("long").alias("copies"))


def mix(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: the words of the result are those that copies() takes. Rows that
    repeat doc_id, source and text share the copies of all of them evenly. Columns keep names and types, whatever they are.
    An empty table gives none. Texts are shuffled only where the rows taken otherwise than once are too many to broadcast.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key, other, total, rows, place, times = free(docs, "key", "other", "total", "rows", "place", "times")
    taken = copies(docs, p).groupBy("row_key").agg(F.sum("copies").cast("long").alias(total), F.count("*").alias(rows))
    # most documents of a source have as many copies; those that have one are left out of the join's side
    taken = scratch.save(taken.where(F.col(total) != F.col(rows)).withColumnRenamed("row_key", other), "taken")
    keyed = docs.withColumn(key, _key(docs)).join(small(taken, 32), F.col(key) == F.col(other), "left")
    uneven = F.coalesce(F.col(total) % F.col(rows) != 0, F.lit(False))
    even = keyed.where(~uneven).withColumn(times, F.coalesce(F.col(total) / F.col(rows), F.lit(1)).cast("int"))
    if taken.where(F.col(total) % F.col(rows) != 0).limit(1).count():
        # numbered within their places in a written table, which split a group of any size
        held = scratch.save(keyed.where(uneven).withColumn(place, F.monotonically_increasing_id()), "uneven")
        ranked = number(held.select(key, place), [key], [F.col(place)], "rank", F.shiftright(place, 16)).select(F.col(place).alias(other), "rank")
        held = held.drop(other).join(ranked, F.col(place) == F.col(other))
        share = lambda k: F.floor(k * F.col(total) / F.col(rows))
        even = even.select(*docs.columns, times).unionByName(held.withColumn(times, (share(F.col("rank") + 1) - share(F.col("rank"))).cast("int")).select(*docs.columns, times))
    return even.where(F.col(times) > 0).withColumn(place, F.explode(F.sequence(F.lit(1), times))).select(docs.columns)
