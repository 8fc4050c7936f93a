"""Published transcripts: documents flattened, searched for their entities, annotated, flattened again, and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.functions.scores import RATIO_BAR, RECALL_BAR, verdicts
from lamplight.operators import mentions, runs
from lamplight.operators.checks import missing
from lamplight.sources import tei

#: Which fields of which entities are searched for in texts; modern addresses and quotes of speakers aren't.
SEARCHED = {"people": ("person", ["display_name", "alternate_names"]), "locations": ("location", ["name", "address_1886", "address_1887"]), "claims": ("claim", ["quote"]), "events": ("event", ["title"])}


def labels(tables: dict[str, DataFrame]) -> DataFrame:
    """(source_id, kind, entity_id, label, confidence, rank) of entity tables (source_id, id, confidence, labels' fields)."""
    out = None
    for rank, (table, (kind, fields)) in enumerate(SEARCHED.items()):
        if table in tables:
            df = tables[table]
            every = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) if df.schema[f].dataType.simpleString() == "array<string>" else F.array(c) for f in fields for c in [F.col(f)]))
            one = df.where("id <> ''").select("source_id", F.lit(kind).alias("kind"), F.col("id").alias("entity_id"), F.explode(every).alias("label"), F.col("confidence").cast("double").alias("confidence"), F.lit(rank).alias("rank"))
            out = one if out is None else out.unionByName(one)
    return out.withColumn("label", F.trim("label")).where("label <> ''")


def entity_mentions(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(source_id, id, kind, entity_id, start, end, text, confidence, source) of every place where a document's own labels
    stand in it (source_id, text), one per kind, entity and range."""
    rows = mentions.occurrences(texts.select("source_id", "text"), found, "text", on=["source_id"])
    words = F.substring("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))  # a key, though the range decides it: else every mention takes its whole text along
    once = rows.groupBy("source_id", "kind", "entity_id", "start", "end", words.alias("text")).agg(F.max("confidence").alias("confidence"))
    name = F.concat_ws("_", F.lit("mention"), "kind", "entity_id", F.col("start").cast("string"), F.col("end").cast("string"))
    return once.withColumns({"id": name, "source": F.lit(tei.EXTRACTED_SOURCE)})


def publish(docs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(source_id, tei, transcript's columns, source_stats, error) of documents (source_id, tei), annotated with the mentions
    of their entities. Documents that are null are left out; those that can't be read come with their error alone."""
    docs = docs.where("tei is not null and tei <> ''").select("source_id", "tei")
    texts = tei.transcripts(docs, "source_id", "tei").where("error is null")
    at = entity_mentions(texts, labels(tables))
    per = at.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "entity_id", "id", "text", "confidence", "source"))), lambda m: F.struct(m["id"].alias("id"), m["kind"].alias("kind"), m["entity_id"].alias("entity_id"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), m["confidence"].alias("confidence"), m["source"].alias("source"))).alias("found"))
    return runs.transcript_stats(tei.published(docs.join(per, "source_id", "left"), "source_id", "tei", "found"))


def validate(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(source_id, status, errors, warnings, similarity_ratio, token_recall, missing_page_refs, speech counts) of documents
    (source_id, tei) against pages (source_id, text, page_refs: those its cues have). Text drift needs both bars missed;
    page references that are missing only warn; the ratio is computed only where the recall fails."""
    flat = tei.transcripts(docs, "source_id", "tei")
    both = pages.select("source_id", F.coalesce("text", F.lit("")).alias("_expected"), F.col("page_refs").alias("_refs")).join(flat.hint("merge"), "source_id")  # sizes out of Python are unknown: never broadcast
    both = verdicts(both.withColumn("text", F.coalesce("text", F.lit(""))), "_expected", "text")
    actual = F.filter(F.transform("page_refs", lambda x: x["page_ref"]), lambda x: F.coalesce(x, F.lit("")) != "")
    both = both.withColumn("missing_page_refs", missing(F.filter("_refs", lambda x: F.coalesce(x, F.lit("")) != ""), actual))
    drift = F.format_string(f"TEI text drift ratio %.4f below {RATIO_BAR:.2f} and token recall %.4f below {RECALL_BAR:.2f}", "ratio", "recall")
    errors = F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("XML parse error: "), "error"))).otherwise(
        F.filter(F.array(F.when(~F.col("has_body"), F.lit("Missing TEI body")), F.when(~F.col("valid"), drift), F.when(F.size("dangling") > 0, F.lit("One or more TEI annotation targets do not resolve"))), lambda x: x.isNotNull())
    )
    warnings = F.when(F.col("error").isNull() & (F.size("missing_page_refs") > 0), F.array(F.concat(F.lit("Missing page refs in TEI: "), F.array_join(F.slice("missing_page_refs", 1, 10), ", ")))).otherwise(F.array().cast("array<string>"))
    counts = ["speech_turns", "turns_with_who", "answer_turns", "answer_turns_with_who", "annotations", "dangling"]
    return both.withColumns({"errors": errors, "warnings": warnings}).select("source_id", F.when(F.size("errors") == 0, "valid").otherwise("invalid").alias("status"), "errors", "warnings", F.round("ratio", 4).alias("similarity_ratio"), F.round("recall", 4).alias("token_recall"), "missing_page_refs", *counts)
