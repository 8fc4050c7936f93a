"""A corpus, stage by stage: toxicity, line dedup, near-dedup, mixing, tokens. Part of the subpackage llm.

Each stage takes documents with any further columns, null, empty, tied and repeated ones, and rows decide, not doc_ids. An
empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.llm import bpe, linedup, minhash, mixing, toxicity
from lamplight.llm.common import Scratch, free, table
from lamplight.llm.queries import tokenizer


#: Rows of a batch between an executor and its Python worker. Both hold whole batches, which have 10,000 rows by default.
BATCH = 1024


def bound_batches(spark: SparkSession) -> None:
    """Bounds the batches of this session from now on, for what a stage returns runs later; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose texts are predicted toxic. Labels are learned from documents that came in. Rows of equal texts,
    whatever their doc_ids, go or stay together; null and empty texts stay."""
    bound_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that recur across documents; n_chars follows the text where a line went. Null texts stay null,
    rows of equal texts fare alike, and what consists of recurring lines becomes empty."""
    lines, dropped = free(docs, "lines", "dropped")
    out = linedup.drop_lines(docs, counts=(lines, dropped))
    return out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id, null last; equal rows are copies too. Texts without
    words stay."""
    bound_batches(spark)
    return minhash.keep_one(docs, minhash.Params(percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; equal rows share their copies. A null source is one of its own, and rows
    without words weigh nothing."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; a null text has the tokens of an empty one."""
    bound_batches(spark)
    return bpe.encode(docs, tokenizer(), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("minhash near-dedup", drop_copies), ("source mix", mix_sources), ("bpe", encode_tokens)]

#: Nearest neighbours and byte-pair merges aren't SQL: the stages are held against brute force one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
