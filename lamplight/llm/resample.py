"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import Scratch
from lamplight.llm.cuts import BITS, cut
from lamplight.llm.minhash import word_hashes


@dataclass(frozen=True)
class Params:
    """buckets: of hashed n-grams. share: of rows to keep; None takes the share of good rows among the labels learned
    from. target: labelled good rows of which the target model is made, at most. prior: added to each bucket's count.
    seed: of the noise."""

    buckets: int = 1 << 14
    share: float | None = None
    target: int = 50_000
    prior: float = 1.0
    seed: int = 23


def grams(data: bytes, buckets: int) -> np.ndarray:
    """Buckets of the words and the word pairs; pairs of a word with itself share one, whatever the word."""
    words = word_hashes(data)[0]
    pairs = np.where(words[1:] == words[:-1], np.uint64(1), words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1])
    mixed = np.concatenate((words, pairs ^ (pairs >> np.uint64(29))))
    return ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _counts(docs: DataFrame, p: Params) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows, and of those marked target. A row per task and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(p.buckets, np.int64), np.zeros(p.buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(0).slice(at, 512).cast(pa.binary()).to_pylist()
                for text, yes in zip(texts, batch.column(1).slice(at, 512).to_pylist(), strict=True):
                    n = np.bincount(grams(text or b"", p.buckets), minlength=p.buckets)
                    raw += n
                    if yes:
                        good += n
        held = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(raw[held]), pa.array(good[held])], ["bucket", "raw", "target"])

    rows = docs.select("text", "_target").mapInArrow(run, "bucket long, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def learned(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, y) of the labels to learn from: not held out, not null, one per doc_id."""
    key = F.col("doc_id").cast("string")
    return labels.where(F.col(name).isNotNull() & (F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(5)) != 0)).groupBy("doc_id").agg((F.avg(name) >= 0.5).cast("int").alias("y"))


def bounded(rows: DataFrame, n: int) -> DataFrame:
    """At most n of rows (doc_id, ...), by hash of the doc_id."""
    return rows.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(n)


def resample(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept) per row of docs (doc_id, text); labels: (doc_id, quality).

    log_weight is the log ratio of the text's likelihoods under target and raw models, over all its words and pairs; an
    empty or null text has 0. kept marks the rows with the largest log_weight + noise, share of all; rows that tie at the
    boundary all stay. Noise depends on doc_id and seed, so reruns agree and repeated rows go together; null doc_ids share
    one noise. Without labels the models are the prior's and noise decides. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    known = scratch.save(learned(labels, "quality"), "known")
    seen = known.agg(F.count("*"), F.sum("y")).first()
    share = p.share if p.share is not None else (seen[1] / seen[0] if seen[0] else 0.5)
    good = F.broadcast(scratch.save(bounded(known.where("y = 1"), p.target).select("doc_id", F.lit(True).alias("_target")), "target"))  # p.target rows at most
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    counted = np.zeros((p.buckets, 2))
    for bucket, raw, target in _counts(rows.join(good, "doc_id", "left"), p).collect():  # p.buckets rows at most
        counted[bucket] = raw, target
    model = counted + p.prior
    ratio = np.log(model[:, 1] / model[:, 1].sum()) - np.log(model[:, 0] / model[:, 0].sum())
    table = spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [float(table.value[grams(t or b"", p.buckets)].sum()) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.float64())], ["doc_id", "u", "log_weight"])

    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(p.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    scored = rows.select(F.col("doc_id").cast("long"), "text", u.alias("u")).mapInArrow(run, "doc_id long, u double, log_weight double")
    scored = scratch.save(scored.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log("u"))).alias("gumbel_key")), "scored")
    low, high, n = scored.agg(F.min("gumbel_key"), F.max("gumbel_key"), F.count("*")).first()
    if not n:
        return scored.withColumn("kept", F.lit(False))
    scale = ((1 << BITS) - 1) / (high - low) if high > low else 0.0
    place = F.floor((F.col("gumbel_key") - low) * scale).cast("long")
    bound = cut(scored.withColumn("node", F.lit(0).cast("long")), {0: float(n - round(share * n))}, place, F.lit(1))[0]
    return scored.withColumn("kept", place >= bound)


