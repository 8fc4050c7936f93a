"""What runs of models leave behind: usage, audit records, bundles of tagged entities, diagnostics, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions.text import or_null, slug
from lamplight.operators.resolve import first_wins, merge_entities

# Fixed values.
USAGE_FIELDS = ["input_tokens", "output_tokens", "total_tokens", "reasoning_tokens", "cached_input_tokens"]
STAGES = ["briefing", "transcription", "tagging"]
COLLECTIONS = ["people", "locations", "claims", "events", "quotes"]
REASONING_PREFIXES = ["gpt-5", "o1", "o3", "o4"]
REQUIRED = {
    "people": ["id", "display_name", "roles", "bio"],
    "locations": ["id", "name", "address_1886", "coordinates"],
    "claims": ["id", "reported_by_person_id", "statement", "event_time"],
    "event_suggestions": ["id", "title", "time", "claim_ids"],
    "quotes": ["id", "speaker_person_id", "quote"],
}
UNRESOLVED_METHOD = "tei_llm_unresolved"

USAGE = "struct<" + ", ".join(f"{c}: bigint" for c in USAGE_FIELDS) + ">"


def is_reasoning(model: Column) -> Column:
    out = F.lit(False)
    for p in REASONING_PREFIXES:
        out |= model.startswith(p)
    return out


def usage_of(answer: Column) -> Column:
    """USAGE of a service's answer as JSON, under either of the names counts have; 0 where there is none."""

    def count(*paths: str) -> Column:
        return F.coalesce(*(F.nullif(F.get_json_object(answer, f"$.usage.{p}").try_cast("bigint"), F.lit(0)) for p in paths), F.lit(0)).cast("bigint")

    given, made = count("input_tokens", "prompt_tokens"), count("output_tokens", "completion_tokens")
    total = F.coalesce(F.nullif(count("total_tokens"), F.lit(0)), given + made)
    return F.struct(given.alias("input_tokens"), made.alias("output_tokens"), total.alias("total_tokens"), count("output_tokens_details.reasoning_tokens").alias("reasoning_tokens"), count("input_tokens_details.cached_tokens").alias("cached_input_tokens"))


def no_usage() -> Column:
    return F.struct(*(F.lit(0).cast("bigint").alias(c) for c in USAGE_FIELDS))


def add_usage(*usages: Column) -> Column:
    """The sum of usages; a null one, or a null count, is 0."""

    def total(c: str) -> Column:
        out = F.lit(0).cast("bigint")
        for u in usages:
            out = out + F.coalesce(u[c], F.lit(0))
        return out

    return F.struct(*(total(c).alias(c) for c in USAGE_FIELDS))


def tagging_summary(tagging: Column) -> Column:
    return F.struct(*(F.coalesce(tagging[c], F.lit(0)).cast("bigint").alias(c) for c in ("unit_count", "success_count", "error_count")))


def combined_audit(runs: DataFrame) -> DataFrame:
    """One record per (page_id, model) from the structs briefing, transcription and tagging (status, error, cost_usd, usage;
    tagging also unit_count, success_count, error_count), any of them null. A page fails if its transcription did, if it
    wasn't tagged, or if every unit failed; a failed briefing fails nothing."""
    cost = {s: F.coalesce(F.col(f"{s}.cost_usd"), F.lit(0.0)).cast("double") for s in STAGES}
    t, g = F.col("transcription"), F.col("tagging")
    error = F.when(~F.coalesce(t["status"] == "success", F.lit(False)), F.concat(F.lit("transcription: "), F.coalesce(t["error"], F.lit("None"))))
    error = error.when(g.isNull(), "tagging stage skipped")
    error = error.when((F.coalesce(g["error_count"], F.lit(0)) > 0) & (F.coalesce(g["success_count"], F.lit(0)) == 0), F.concat(F.lit("all "), g["unit_count"].cast("string"), F.lit(" tagging units failed")))
    return runs.select(
        F.concat_ws("_", "page_id", slug(F.col("model"))).alias("call_id"),
        "page_id",
        "model",
        F.struct(*(F.round(cost[s], 8).alias(s) for s in STAGES)).alias("stage_costs"),
        F.struct(*(add_usage(F.col(f"{s}.usage")).alias(s) for s in STAGES)).alias("stage_usage"),
        tagging_summary(g).alias("tagging_summary"),
        add_usage(*(F.col(f"{s}.usage") for s in STAGES)).alias("usage"),
        F.round(cost["briefing"] + cost["transcription"] + cost["tagging"], 8).alias("cost_usd"),
        F.when(error.isNull(), "success").otherwise("error").alias("status"),
        error.alias("error"),
    )


def cached_audit(hits: DataFrame) -> DataFrame:
    """Records like combined_audit's for pages served from the cache (page_id, model, cache_key, produced_by_run_id, cost_usd):
    free in this run; what they once cost is kept beside."""
    return hits.select(
        F.concat_ws("_", "page_id", slug(F.col("model"))).alias("call_id"),
        "page_id",
        "model",
        F.struct(*(F.lit(0.0).alias(s) for s in STAGES)).alias("stage_costs"),
        F.struct(*(no_usage().alias(s) for s in STAGES)).alias("stage_usage"),
        tagging_summary(F.lit(None).cast("struct<unit_count: bigint, success_count: bigint, error_count: bigint>")).alias("tagging_summary"),
        no_usage().alias("usage"),
        F.lit(0.0).alias("cost_usd"),
        F.lit("cached").alias("status"),
        F.lit(None).cast("string").alias("error"),
        "cache_key",
        F.col("produced_by_run_id").alias("cached_from_run_id"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cached_original_cost_usd"),
    )


def cacheable(records: DataFrame) -> DataFrame:
    """Only what succeeded is written to the cache."""
    return records.where("status = 'success'")


def tagging_totals(rows: DataFrame, key: str) -> DataFrame:
    """Per key: units, successes, errors, retried units, entities of each kind in successful ones, usage and cost.
    rows: key, status, attempts, usage, cost_usd, tags (a struct of arrays)."""
    good = F.col("status") == "success"
    held = {f.name for f in rows.schema["tags"].dataType}
    counts = [F.sum(F.when(good & F.col(f"tags.{c}").isNotNull(), F.size(f"tags.{c}")).otherwise(0)).cast("long").alias(c) for c in COLLECTIONS if c in held]
    usage = F.struct(*(F.sum(F.coalesce(f"usage.{c}", F.lit(0))).cast("long").alias(c) for c in USAGE_FIELDS[:3]))
    return rows.groupBy(key).agg(F.count("*").alias("unit_count"), F.count_if(good).alias("success_count"), F.count_if(~F.coalesce(good, F.lit(False))).alias("error_count"), F.count_if(F.coalesce("attempts", F.lit(1)) > 1).alias("retried_count"), *counts, usage.alias("usage"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 8).alias("cost_usd"))


def bundle_items(rows: DataFrame, key: str, collection: str) -> DataFrame:
    """A document's entities of one kind from its tagged units (key, unit_index, status, tags): those of successful units in
    unit order, merged by id with lists kept in order; entities without an id follow, each by itself."""
    items = rows.where("status = 'success'").select(key, "unit_index", F.posexplode(f"tags.{collection}").alias("item_index", "i")).select(key, "unit_index", "item_index", "i.*")
    order = ["unit_index", "item_index"]
    named = items.where("id <> ''").withColumn("_key", F.struct(key, "id")).drop(key, "id")
    merged = merge_entities(named, "_key", order, sort_lists=False).select(f"_key.{key}", "_key.id", "*").drop("_key")
    alone = items.where("id is null or id = ''").drop(*order)
    return merged.unionByName(alone)


def missing_fields(bundles: DataFrame, key: str, bundle: str, required: dict[str, list[str]] = REQUIRED) -> DataFrame:
    """(key, missing): required fields whose key a JSON bundle, or any item of it, lacks; a null value is no lack."""
    b = F.col(bundle)
    own = F.when(~F.array_contains(F.json_object_keys(b), "tei_xml"), F.array(F.lit("bundle.tei_xml"))).otherwise(F.array().cast("array<string>"))
    lists = [own]

    def lacking(items: Column, field: str) -> Column:
        return F.exists(items, lambda x: ~F.array_contains(F.json_object_keys(x), field))

    for name, fields in required.items():
        items = F.coalesce(F.from_json(F.get_json_object(b, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
        lists.append(F.filter(F.array(*(F.when(lacking(items, f), f"{name}.{f}") for f in fields)), lambda x: x.isNotNull()))
    return bundles.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(*lists))))).alias("missing"))


def speaker_directory(entries: DataFrame, key: str, order: str) -> DataFrame:
    """Speakers under ids made of their names; the nameless and later ones of an id go."""
    named = entries.where("display_name <> ''").withColumn("speaker_id", slug(F.col("display_name"), "person"))
    return first_wins(named, [key, "speaker_id"], [order])


def bare_ids(items: Column) -> Column:
    """Items without the # that their ids may begin with."""
    return F.transform(items, lambda x: x.withField("id", F.regexp_replace(x["id"], "^#+", "")))


def sorted_distinct(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def with_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: sorted_distinct(F.col(c)) for c in columns})


def coordinates(c: Column) -> Column:
    """Coordinates with what they lack filled: no confidence, and a method that says that they are unresolved."""
    return F.struct(c["lat"].alias("lat"), c["lng"].alias("lng"), F.coalesce(c["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(c["method"], F.lit(UNRESOLVED_METHOD)).alias("method"))


def chunk_table(sections: DataFrame, cues: DataFrame, key: str) -> DataFrame:
    """(key, chunk, text, cues, page_range) of sections (key, index, chunk, text, page_ref) and cues (key, ordinal, page_ref):
    a chunk has the cues of its pages, or all if it has none; its range is from its first cue's page to its last's."""
    rows = F.array_sort(F.collect_list(F.struct("index", "text", "page_ref")))
    chunks = sections.groupBy(key, "chunk").agg(rows.alias("r"))
    chunks = chunks.select(key, "chunk", F.array_join(F.filter(F.transform("r", lambda x: x["text"]), lambda x: F.coalesce(x, F.lit("")) != ""), "\n").alias("text"), F.filter(F.transform("r", lambda x: x["page_ref"]), lambda x: F.coalesce(x, F.lit("")) != "").alias("pages"))
    every = cues.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "page_ref"))), lambda x: x["page_ref"]).alias("all_cues"))
    out = chunks.join(every, key, "left").withColumn("cues", F.filter(F.coalesce("all_cues", F.array().cast("array<string>")), lambda c: (F.size("pages") == 0) | F.array_contains("pages", F.coalesce(c, F.lit("")))))
    return out.withColumn("page_range", page_span(F.col("cues"))).select(key, "chunk", "text", "cues", "page_range")


def page_span(refs: Column) -> Column:
    known = F.filter(refs, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(known) == 1, F.get(known, 0)).when(F.size(known) > 1, F.concat_ws("-", F.get(known, 0), F.element_at(known, -1)))


def input_diagnostics(chunks: DataFrame, key: str) -> DataFrame:
    """Per key: characters sent, and the number, modes and page ranges of chunks (key, chunk, mode, text, raw_html_excerpt,
    page_range) in order."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "mode", "page_range")))
    sent = F.length(F.coalesce("text", F.lit(""))) + F.length(F.coalesce("raw_html_excerpt", F.lit("")))
    return chunks.groupBy(key).agg(F.sum(sent).cast("long").alias("sent_chars"), F.count("*").alias("chunk_count"), ordered.alias("o")).select(key, "sent_chars", "chunk_count", F.transform("o", lambda x: x["mode"]).alias("chunk_modes"), F.transform("o", lambda x: x["page_range"]).alias("page_ranges"))


def answer_length(answer: Column) -> Column:
    """Characters of the text of a service's answer as JSON: its whole text, else its first piece of text."""
    pieces = F.from_json(F.get_json_object(answer, "$.output"), "array<struct<content: array<struct<type: string, text: string>>>>")
    texts = F.filter(F.flatten(F.filter(F.transform(pieces, lambda x: x["content"]), lambda x: x.isNotNull())), lambda x: x["type"] == "output_text")
    return F.coalesce(F.length(F.get_json_object(answer, "$.output_text")), F.length(F.get(texts, 0)["text"]), F.lit(0)).cast("long")


def brief_totals(pages: DataFrame, results: DataFrame) -> DataFrame:
    """One row for an update of briefings: pages briefed and skipped, briefings, reused ones, usage and cost. pages: source_id,
    source_type; results: source_id, status, reused, usage, cost_usd."""
    toc = F.col("source_type").eqNullSafe("toc")
    seen = pages.agg(F.count_if(~toc).alias("pages"), F.count_if(toc).alias("skipped"))
    usage = F.struct(*(F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).cast("long").alias(c) for c in USAGE_FIELDS))
    done = results.agg(F.count_if(F.col("status").isin("success", "cached")).alias("briefings"), F.count_if("reused").alias("reused"), usage.alias("usage"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 8).alias("cost_usd"))
    return seen.join(F.broadcast(done))  # one row each


def transcript_stats(df: DataFrame) -> DataFrame:
    """df (text, segments, page_refs, mentions) with the counts of a transcript."""
    kinds = lambda k: F.size(F.filter("segments", lambda s: s["kind"] == k)).cast("long")
    size = lambda c: F.size(c).cast("long")
    return df.withColumn("source_stats", F.struct(F.length("text").cast("long").alias("characters"), size("segments").alias("segments"), size("page_refs").alias("page_refs"), size("mentions").alias("mentions"), kinds("question").alias("questions"), kinds("answer").alias("answers"), F.size(F.filter("segments", lambda s: or_null(s["speaker_id"]).isNotNull())).cast("long").alias("speaker_attributed_segments")))


def source_stats(blocks: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Per page: characters, lines, links, page markers, questions and answers. blocks: content_blocks' rows; pages: key, text
    (normalized), links, raw_lines, navigation_removed."""
    per = blocks.groupBy(key).agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike(r"^\[Image,\s*(.+?)\]")).alias("page_markers"), F.count_if(F.col("kind") == "question").alias("questions"), F.count_if(F.col("kind") == "answer").alias("answers"))
    out = pages.select(key, F.length("text").cast("long").alias("characters"), F.size("links").cast("long").alias("links"), "raw_lines", "navigation_removed").join(per, key, "left")
    return out.fillna(0, ["lines", "page_markers", "questions", "answers"])
