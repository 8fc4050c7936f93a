"""Sharding by a k-d tree: recursive splits at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import Scratch
from lamplight.llm.cuts import cut
from lamplight.llm.numbering import number


@dataclass(frozen=True)
class Params:
    """shards: leaves; or target_bytes, which gives as many as are needed. whole: the share of a leaf up to which a group
    of equal texts stays whole; larger groups are dealt out in pieces of at most about that share. heavy: the share of a
    leaf from which a group is placed before the light ones, which then even out the sides."""

    shards: int | None = 8
    target_bytes: int | None = None
    whole: float = 0.6
    heavy: float = 0.005


def _place(text: str):
    """A number that orders strings as their first six bytes do."""
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), 1, 12), 12, "0"), 16, 10).cast("double"), F.lit(0.0))


#: The dimensions, each as a double; the smallest of a group of equal texts counts.
DIMENSIONS = {"doc_id": lambda: F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)), "size": lambda: F.col("size").cast("double"), "lang": lambda: _place("lang"), "source": lambda: _place("source")}


def assign(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs (doc_id, text, lang, source).

    size is the text's UTF-8 bytes (null: none) plus 1, text_crc32 that of a null text as of an empty one. Leaves are near
    equal in bytes. Rows of equal texts share a leaf (null apart from empty), but for groups above p.whole of a leaf. slot
    numbers a shard's rows from 0. Rows with null columns, repeated rows and ties are placed like any other; an empty
    table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.col("text").isNull(), "text").alias("text_key"))
    rows = scratch.save(rows.select("doc_id", "size", "text_crc32", "text_key", *(f().alias(f"d_{c}") for c, f in DIMENSIONS.items())), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = p.shards or max(1, ceil(total / p.target_bytes))
    leaf = max(1.0, total / leaves)

    group = ["text_key", "size", "text_crc32"]
    dims = [f"d_{c}" for c in DIMENSIONS]
    bulk = rows.groupBy(*group).agg(F.sum("size").alias("bulk"))
    pieces = F.when(F.col("bulk") > p.whole * leaf, F.ceil(F.col("bulk") / F.lit(leaf * p.heavy))).otherwise(1).cast("int")
    split = bulk.where(F.col("bulk") > p.whole * leaf).select(*group, pieces.alias("pieces"))  # fewer than leaves / whole groups
    rows = rows.join(F.broadcast(split), group, "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("int")).drop("pieces")
    points = rows.groupBy(*group, "piece").agg(F.sum("size").cast("long").alias("weight"), *(F.min(c).alias(c) for c in dims))
    points = scratch.save(points.withColumn("tie", F.pmod(F.xxhash64(*group, "piece"), F.lit(1 << 20))).withColumn("node", F.lit(0).cast("long")), "points-0")

    span = points.agg(*(F.min(c).alias(f"a_{c}") for c in dims), *(F.max(c).alias(f"b_{c}") for c in dims)).first()
    whole = {c: (span[f"b_{c}"] or 0) - (span[f"a_{c}"] or 0) or 1.0 for c in dims}
    parts, level = {0: leaves}, 0  # leaves below each node
    while any(n > 1 for n in parts.values()):
        found = points.groupBy("node").agg(F.sum("weight").alias("weight"), *(F.min(c).alias(f"a_{c}") for c in dims), *(F.max(c).alias(f"b_{c}") for c in dims), F.max(F.col("weight") >= p.heavy * leaf).alias("heavy")).collect()
        nodes = {}
        for r in found:
            if parts[r["node"]] > 1:
                c = max(dims, key=lambda c: (r[f"b_{c}"] - r[f"a_{c}"]) / whole[c])
                nodes[r["node"]] = (dims.index(c), r[f"a_{c}"], r[f"b_{c}"] - r[f"a_{c}"], r["weight"] * (parts[r["node"]] // 2) / parts[r["node"]], r["heavy"])
        table = F.broadcast(spark.createDataFrame([(k, *v[:3]) for k, v in nodes.items()], "node long, _dim int, _from double, _width double")) if nodes else None
        if table is not None:
            value = F.element_at(F.array(*dims), F.col("_dim") + 1)
            place = F.when(F.col("_width") > 0, (value - F.col("_from")) / F.col("_width") * ((1 << 28) - 1)).otherwise(0.0).cast("long")
            at = points.join(table, "node", "left").withColumn("key", F.when(F.col("_dim").isNotNull(), F.shiftleft(place, 20) + F.col("tie"))).drop("_dim", "_from", "_width")
            at = scratch.save(at, f"keys-{level}")
            split_ = at.where("key is not null")
            bounds = cut(split_, {k: v[3] for k, v in nodes.items()}, F.col("key"), F.col("weight"))
            heavy = F.col("weight") >= p.heavy * leaf
            uneven = {k for k, v in nodes.items() if v[4]}
            light = dict(bounds)
            if uneven:
                limits = F.broadcast(spark.createDataFrame([(k, bounds[k]) for k in uneven], "node long, _bound long"))
                held = {r[0]: r[1] for r in split_.where(heavy).join(limits, "node").where("key < _bound").groupBy("node").agg(F.sum("weight")).collect()}
                light |= cut(split_.where(~heavy), {k: max(0.0, nodes[k][3] - held.get(k, 0)) for k in uneven}, F.col("key"), F.col("weight"))
            limits = F.broadcast(spark.createDataFrame([(k, bounds[k], light[k]) for k in nodes], "node long, _heavy long, _light long"))
            right = F.when(F.col("key") >= F.when(heavy, F.col("_heavy")).otherwise(F.col("_light")), 1).otherwise(0)
            points = at.join(limits, "node", "left").withColumn("node", F.col("node") * 2 + F.coalesce(right, F.lit(0))).drop("key", "_heavy", "_light")
        else:
            points = points.withColumn("node", F.col("node") * 2)
        parts = {2 * k + side: n for k, v in parts.items() for side, n in ((0, v // 2 if v > 1 else v), (1, v - v // 2 if v > 1 else 0)) if n}
        level += 1
        points = scratch.save(points, f"points-{level}")
        scratch.drop(f"points-{level - 1}")
        scratch.drop(f"keys-{level - 1}")
    order = F.broadcast(spark.createDataFrame([(k, i) for i, k in enumerate(sorted(parts))], "node long, shard int"))
    shards = points.join(order, "node").select(*group, "piece", "shard")
    placed = rows.join(shards, [*group, "piece"]).select("doc_id", "size", "text_crc32", "text_key", "shard")
    return number(placed, ["shard"], [F.col("doc_id"), F.col("text_key")], "slot", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(1024))).drop("text_key")
