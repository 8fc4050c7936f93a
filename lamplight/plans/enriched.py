"""Queries of documents, navigation, runs and readers over the driver's tables, each beside the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.functions import scores, text
from lamplight.operators import navigation, reader, resolve, runs, segments
from lamplight.plans import publish
from lamplight.plans.registry import query
from lamplight.sources import tei

_CLEAN = r"lines AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t]+', ' ', 'g')) AS line FROM documents)"


def _as_tei(t):
    null = F.lit(None)
    made = tei.build(F.concat(F.lit("source_"), F.col("doc_id").cast("string")), F.lit("http://localhost/"), F.col("source"), F.lit("transcript"), F.lit("now"), F.sha2("text", 256), F.col("text"), null.cast("array<string>"))
    return t("documents").select("doc_id", made.alias("tei"))


@query(f"""WITH {_CLEAN}, per AS (SELECT doc_id, count(*) AS segments, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS characters FROM lines WHERE line <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(segments, 0) AS segments, coalesce(characters, 0) AS characters FROM documents LEFT JOIN per USING (doc_id)""")
def tei_round_trip(t, spark):
    """Documents written as TEI and read back."""
    out = runs.transcript_stats(tei.transcripts(_as_tei(t), "doc_id", "tei"))
    return out.select("doc_id", "source_stats.segments", "source_stats.characters")


@query("""SELECT conv_id, count(*) FILTER (trim(text) <> '') AS segments, count(DISTINCT turn // 3) AS page_refs, count(*) FILTER (trim(text) <> '' AND role = 'user') AS attributed FROM conversations GROUP BY conv_id""")
def tei_synthesized(t, spark):
    """Conversations as speeches, a page every three turns."""
    rows = t("conversations").select("conv_id", "turn", F.floor(F.col("turn") / 3).cast("string").alias("page"), F.col("role").alias("speaker"), F.when(F.col("role") == "user", F.lit("person_user")).alias("speaker_id"), "text")
    cues = rows.select("conv_id", F.col("page").alias("page_ref"), F.lit("f").alias("facs")).distinct()
    out = runs.transcript_stats(tei.transcripts(tei.synthesize(rows, cues, "conv_id", "turn"), "conv_id", "tei"))
    return out.select("conv_id", "source_stats.segments", "source_stats.page_refs", F.col("source_stats.speaker_attributed_segments").alias("attributed"))


@query("SELECT conv_id, turn AS unit_index, 'sp_' || turn AS unit_id FROM (SELECT conv_id, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn FROM conversations WHERE trim(text) <> '')")
def tagging_units(t, spark):
    """X09."""
    rows = t("conversations").select("conv_id", "turn", F.lit(None).cast("string").alias("page"), F.col("role").alias("speaker"), F.lit(None).cast("string").alias("speaker_id"), "text")
    none = rows.select("conv_id", F.col("page").alias("page_ref"), F.col("page").alias("facs")).limit(0)
    return tei.unit_rows(tei.synthesize(rows, none, "conv_id", "turn"), "conv_id", "tei").select("conv_id", "unit_index", "unit_id")


@query("""SELECT conv_id, count(*) AS turns, CAST(sum(length(regexp_replace(trim(text), '\\s+', ' ', 'g'))) + count(*) - 1 AS BIGINT) AS characters FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def tei_combined(t, spark):
    """Every turn a document of its own, combined by conversation."""
    one = F.concat(F.lit("<TEI><text><body><div>"), tei.element("p", [], F.col("text")), F.lit("</div></body></text></TEI>"))
    out = tei.transcripts(tei.combined(t("conversations").select("conv_id", "turn", one.alias("tei")), "conv_id", "turn", "tei"), "conv_id", "tei")
    return out.where("text <> ''").select("conv_id", F.size("segments").cast("long").alias("turns"), F.length("text").cast("long").alias("characters"))


def _own_labels(t):
    first = t("conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("x"))
    return first.select(F.col("conv_id").alias("source_id"), F.concat(F.lit("person_"), F.col("conv_id").cast("string")).alias("id"), F.lit(0.5).alias("confidence"), F.lower(F.regexp_extract("x", "([A-Za-z]{3,})", 1)).alias("display_name"))


@query(r"""WITH own AS (SELECT conv_id, lower(regexp_extract(arg_min(text, turn), '([A-Za-z]{3,})', 1)) AS label FROM conversations GROUP BY conv_id),
doc AS (SELECT conv_id, string_agg(trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS text FROM conversations GROUP BY conv_id),
cut AS (SELECT conv_id, label, string_split(lower(text), label) AS p FROM doc JOIN own USING (conv_id) WHERE length(label) >= 3 AND contains(lower(text), label))
SELECT conv_id AS source_id, CAST(len(p) - 1 AS BIGINT) AS mentions, length(p[1]) AS first_at FROM cut""")
def published_mentions(t, spark):
    """Each conversation searched for its own label, annotated and flattened again."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: tei.element("p", [], x["text"]))
    docs = t("conversations").groupBy(F.col("conv_id").alias("source_id")).agg(F.concat(F.lit("<TEI><text><body>"), F.array_join(body, ""), F.lit("</body></text></TEI>")).alias("tei"))
    out = publish.publish(docs, {"people": _own_labels(t).withColumn("alternate_names", F.array().cast("array<string>"))})
    return out.where(F.size("mentions") > 0).select("source_id", F.size("mentions").cast("long").alias("mentions"), F.get("mentions", 0)["start"].alias("first_at"))


@query()
def tei_validation(t, spark):
    """F20, A16, J20, J21."""
    pages = t("documents").select(F.col("doc_id").alias("source_id"), "text", F.array().cast("array<string>").alias("page_refs"))
    out = publish.validate(pages, _as_tei(t).withColumnRenamed("doc_id", "source_id"))
    return out.select("source_id", "status", "similarity_ratio", "token_recall", "speech_turns")


_ROLE = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'testimony' WHEN contains(lower(title), 'cover page') THEN 'cover' WHEN regexp_matches(lower(title), 'summons|motion|order|indictment') THEN 'legal_document' ELSE 'other' END"
_TITLED = "titled AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'Cover Page ' WHEN 1 THEN 'Motion ' ELSE 'Talk ' END || o_orderkey AS title FROM orders)"


def _titled(t):
    kind = F.when(F.col("o_orderkey") % 4 == 0, "Cover Page ").when(F.col("o_orderkey") % 4 == 1, "Motion ").otherwise("Talk ")
    meta = F.struct(F.lit("I").alias("volume"), F.format_string("pp. %d-%d", "o_custkey", F.col("o_custkey") + 3).alias("pages"), F.date_format("o_orderdate", "MMMM d, yyyy").alias("date_text"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("Ann")).alias("witness_name"))
    return t("orders").select(F.col("o_orderkey").alias("source_id"), F.concat(kind, F.col("o_orderkey").cast("string")).alias("title"), F.when(F.col("o_orderpriority") == "1-URGENT", "testimony").otherwise("transcript").alias("source_type"), meta.alias("metadata"), "o_orderdate", "o_custkey")


_BRIEF = "source_id long, brief_title string, navigation_summary string, summary string, document_date struct<original_text: string, normalized_date: string, precision: string>, document_order struct<volume: string, page_start: int, page_end: int, sequence_label: string>, document_role string, topics array<string>, primary_people array<{e}>, primary_locations array<{e}>, referenced_events array<{v}>, document_events array<{v}>".format(e=navigation.ENTITY_REF, v=navigation.EVENT_REF)


@query(f"""WITH {_TITLED} SELECT o_orderkey AS source_id, title AS brief_title, strftime(o_orderdate, '%Y-%m-%d') AS day, {_ROLE} AS role, CAST(o_custkey AS INTEGER) AS page_start, CAST(o_custkey + 3 AS INTEGER) AS page_end, CASE WHEN o_orderkey % 3 = 0 THEN 'Ann' ELSE '' END AS people FROM titled""")
def catalogue_navigation(t, spark):
    """The catalogue's fallback where a source has no navigation."""
    none = spark.createDataFrame([], f"source_id long, navigation {navigation.NAVIGATION}")
    n = F.col("navigation")
    names = F.array_join(F.transform(n["primary_people"], lambda x: x["label"]), ",")
    return navigation.with_fallback(_titled(t), none).select("source_id", n["brief_title"].alias("brief_title"), n["document_date"]["normalized_date"].alias("day"), n["document_role"].alias("role"), n["document_order"]["page_start"].alias("page_start"), n["document_order"]["page_end"].alias("page_end"), names.alias("people"))


def _pools(spark):
    people = spark.createDataFrame([], "source_id long, ordinal int, id string, display_name string, alternate_names array<string>, roles array<string>, confidence double")
    places = spark.createDataFrame([], "source_id long, ordinal int, id string, name string, address_1886 string, address_1887 string, modern_address string, location_type string, confidence double")
    events = spark.createDataFrame([], f"source_id long, ordinal int, id string, title string, time {navigation.TIME}, location_id string, participant_person_ids array<string>, description string, confidence double")
    return [navigation.pool(x, x.drop("source_id"), labels) for x, labels in ((people, navigation.PERSON_LABELS), (places, navigation.LOCATION_LABELS), (events, navigation.EVENT_LABELS))]


@query("""WITH own AS (SELECT l_orderkey AS source_id, min(l_linenumber) AS o, 'p' || l_partkey AS id, arg_min(p_name, l_linenumber) AS label FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_partkey),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY o, id) AS n FROM own)
SELECT o_orderkey AS source_id, coalesce((SELECT string_agg(id, ',' ORDER BY n) FROM k WHERE k.source_id = o_orderkey AND n <= 8), '') AS people, CAST(coalesce((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS BIGINT) AS claim_count FROM orders""")
def source_navigation(t, spark):
    """Orders as sources without briefings, their parts as the people they show."""
    own = t("lineitem").join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.col("p_name").alias("display_name"), F.array().cast("array<string>").alias("alternate_names"), F.array().cast("array<string>").alias("roles"), F.lit(0.5).alias("confidence"))
    _, places, events = _pools(spark)
    people = navigation.pool(own, own.drop("source_id").limit(0), navigation.PERSON_LABELS)
    out = navigation.build(_titled(t), spark.createDataFrame([], _BRIEF), t("lineitem").select(F.col("l_orderkey").alias("source_id")), people, places, events)
    n = F.col("navigation")
    return out.select("source_id", F.array_join(F.transform(n["primary_people"], lambda x: x["canonical_id"]), ",").alias("people"), n["claim_count"].alias("claim_count"))


@query("""SELECT p_partkey, regexp_matches(lower(p_name), 'order|motion|filed|catalog|transcript|petition') AS document, CASE WHEN contains(lower(p_name), 'source') OR contains(lower(p_name), 'catalog') OR contains(lower(p_name), 'transcript') THEN 'source_description'
WHEN regexp_matches(lower(p_name), 'petition|motion|order') THEN 'court_procedure' WHEN regexp_matches(lower(p_name), 'drawn|made') THEN 'document_creation' ELSE 'other_document_event' END AS kind FROM (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' Order' WHEN 1 THEN ' source' WHEN 2 THEN ' drawn' ELSE '' END AS p_name FROM part)""")
def document_events(t, spark):
    """P04-P06."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, " Order").when(F.col("p_partkey") % 5 == 1, " source").when(F.col("p_partkey") % 5 == 2, " drawn").otherwise(""))
    return t("part").select("p_partkey", navigation.is_document_event(name, F.lit(None)).alias("document"), navigation.document_event_kind(name, F.lit(None)).alias("kind"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'event_' || event_id ELSE (CASE WHEN event_id % 4 = 0 THEN 'undated' ELSE strftime(ts, '%Y-%m-%d') END) || '|' || event_type || '|' || 'place ' || (user_id % 7) END AS key FROM events""")
def event_keys(t, spark):
    """F12."""
    ref = F.struct(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("event_"), F.col("event_id").cast("string"))).alias("canonical_id"), F.struct(F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("start")).alias("event_time"), F.upper("event_type").alias("label"), F.concat(F.lit("  Place  "), (F.col("user_id") % 7).cast("string")).alias("location_label"))
    return t("events").select("event_id", reader.event_key(ref).alias("key"))


@query("""SELECT event_id, k AS input_tokens, 2 * k AS output_tokens, 3 * k AS total_tokens FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def usage_extract(t, spark):
    """F21."""
    k = F.get_json_object("props", "$.k").cast("long")
    answer = F.when(F.col("event_id") % 2 == 0, F.format_string('{"usage": {"prompt_tokens": %d, "completion_tokens": %d}}', k, 2 * k)).otherwise(F.format_string('{"usage": {"input_tokens": %d, "output_tokens": %d, "total_tokens": %d}}', k, 2 * k, 3 * k))
    return t("events").select("event_id", runs.usage_of(answer).alias("u")).select("event_id", "u.input_tokens", "u.output_tokens", "u.total_tokens")


@query("""SELECT CAST(o_orderkey AS VARCHAR) || '_model_1' AS call_id, round(o_totalprice / 100 + 0.25, 4) AS cost_usd, CASE WHEN o_orderstatus = 'F' THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'error' ELSE 'success' END AS status, CAST(o_custkey + 7 AS BIGINT) AS tokens FROM orders""")
def combined_audits(t, spark):
    """A10, A27."""
    usage = lambda n: F.struct(*((n if c == "total_tokens" else F.lit(0)).cast("long").alias(c) for c in runs.USAGE_FIELDS))
    stage = lambda status, cost, n: F.struct(status.alias("status"), F.lit("e").alias("error"), cost.alias("cost_usd"), usage(n).alias("usage"), F.lit(1).alias("unit_count"), F.lit(1).alias("success_count"), F.lit(0).alias("error_count"))
    rows = t("orders").select(F.col("o_orderkey").cast("string").alias("page_id"), F.lit("Model 1").alias("model"), stage(F.lit("success"), F.lit(0.25), F.lit(7)).alias("briefing"), stage(F.when(F.col("o_orderstatus") == "F", "error").otherwise("success"), F.col("o_totalprice") / 100, F.col("o_custkey")).alias("transcription"), F.when(F.col("o_orderkey") % 5 != 0, stage(F.lit("success"), F.lit(0.0), F.lit(0))).alias("tagging"))
    return runs.combined_audit(rows).select("call_id", F.round("cost_usd", 4).alias("cost_usd"), "status", F.col("usage.total_tokens").alias("tokens"))


@query("""SELECT l_orderkey, count(*) AS unit_count, count(*) FILTER (l_linestatus = 'F') AS success_count, count(*) FILTER (l_linestatus <> 'F') AS error_count, count(*) FILTER (l_linenumber > 1) AS retried_count, CAST(count(*) FILTER (l_linestatus = 'F') * 2 AS BIGINT) AS people, CAST(sum(l_partkey) AS BIGINT) AS tokens FROM lineitem GROUP BY l_orderkey""")
def tagging_stage_totals(t, spark):
    """Order lines as tagged units."""
    tags = F.struct(F.array("l_partkey", "l_suppkey").alias("people"))
    usage = F.struct(F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.col("l_partkey").cast("long").alias("total_tokens"))
    rows = t("lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "F", "success").otherwise("error").alias("status"), F.col("l_linenumber").alias("attempts"), usage.alias("usage"), F.col("l_tax").cast("double").alias("cost_usd"), tags.alias("tags"))
    return runs.tagging_totals(rows, "l_orderkey").select("l_orderkey", "unit_count", "success_count", "error_count", "retried_count", "people", F.col("usage.total_tokens").alias("tokens"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS roles, arg_min(event_type, event_id) AS first_ FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE value > 1 GROUP BY user_id, event_type) GROUP BY user_id""")
def bundle_merge(t, spark):
    """Events as tagged units of users; lists keep their order."""
    item = F.array(F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.array("event_type").alias("roles")))
    rows = t("events").select("user_id", F.col("event_id").alias("unit_index"), F.when(F.col("value") > 1, "success").otherwise("error").alias("status"), F.struct(item.alias("people")).alias("tags"))
    return runs.bundle_items(rows, "user_id", "people").select("user_id", F.array_join("roles", ",").alias("roles"), F.col("name").alias("first_"))


@query("""SELECT source, string_agg(DISTINCT m, ',' ORDER BY m) AS missing FROM (SELECT source, unnest(CASE WHEN doc_id % 2 = 0 THEN ['people.bio', 'people.roles'] ELSE ['bundle.tei_xml'] END) AS m FROM documents) GROUP BY source""")
def missing_required_fields(t, spark):
    """A03."""
    bundle = F.when(F.col("doc_id") % 2 == 0, '{"tei_xml": null, "people": [{"id": 1, "display_name": null}]}').otherwise('{"people": []}')
    return runs.missing_fields(t("documents").select("source", bundle.alias("b")), "source", "b").select("source", F.array_join("missing", ",").alias("missing"))


@query("""SELECT o_custkey, CAST(chunk AS INTEGER) AS chunk, string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey) AS text, CASE WHEN count(*) = 1 THEN CAST(min(o_orderkey) AS VARCHAR) ELSE min(o_orderkey) || '-' || max(o_orderkey) END AS page_range
FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS chunk FROM orders) GROUP BY ALL""")
def chunk_ranges(t, spark):
    """W05, A22."""
    nth = resolve.rank(t("orders"), ["o_custkey"], [F.col("o_orderkey")], "n")
    rows = nth.select("o_custkey", F.col("o_orderkey").alias("index"), F.floor((F.col("n") - 1) / 3).cast("int").alias("chunk"), F.col("o_orderkey").cast("string").alias("text"), F.col("o_orderkey").cast("string").alias("page_ref"))
    cues = rows.select("o_custkey", F.col("index").alias("ordinal"), "page_ref")
    return runs.chunk_table(rows, cues, "o_custkey").select("o_custkey", "chunk", "text", "page_range")


@query(f"""WITH {_CLEAN} SELECT d.doc_id, CAST(coalesce(sum(length(line)) + count(line) - 1, 0) AS BIGINT) AS characters, count(line) AS lines FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id AND line <> '' GROUP BY d.doc_id""")
def document_stats(t, spark):
    """T15."""
    blocks = segments.content_blocks(segments.line_rows(t("documents"), "doc_id", "text"), "doc_id")
    none = F.array().cast("array<string>").alias("links")
    pages = t("documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"), none, F.lit(0).alias("raw_lines"), F.lit(0).alias("navigation_removed"))
    return runs.source_stats(blocks, pages, "doc_id").select("doc_id", "characters", "lines")


@query("SELECT s_suppkey AS id, s_acctbal AS lat, CAST(s_nationkey AS DOUBLE) AS lng, 'p' || s_suppkey AS primary_person, n_name AS location_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey % 3 <> 0")
def mapped_events(t, spark):
    """Suppliers as events at their nations."""
    places = t("supplier").join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").alias("id"), F.col("n_name").alias("name"), F.struct(F.col("s_acctbal").alias("lat"), F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey").cast("double")).alias("lng")).alias("coordinates"))
    events = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("location_id"), F.array(F.concat(F.lit("p"), F.col("s_suppkey").cast("string"))).alias("participant_person_ids"))
    return reader.mapped_events(events, places).select("id", "lat", "lng", "primary_person", "location_name")


@query("SELECT l_orderkey AS id, string_agg(CASE WHEN l_suppkey % 2 = 0 THEN s_name ELSE CAST(l_suppkey AS VARCHAR) END, ',' ORDER BY l_linenumber, l_suppkey) AS pills FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey")
def person_pills(t, spark):
    """An order's suppliers by name; odd ones are unknown."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct().join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string"))
    events = lines.groupBy(F.col("l_orderkey").alias("id")).agg(ids.alias("participant_person_ids"))
    people = t("supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("display_name"))
    return reader.person_pills(events, people).select("id", F.array_join("pills", ",").alias("pills"))


@query("SELECT key, arg_max(label, d) AS label FROM (SELECT c_custkey AS key, c_name AS label, 0 AS d FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) GROUP BY key")
def label_dictionary(t, spark):
    """J22."""
    tables = [t(x).select(F.col(k).alias("ordinal"), F.col(k).alias("key"), F.col(n).alias("label")) for x, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))]
    return resolve.last_wins(tables, "key", "label")


@query("SELECT c_custkey, lower(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END) AS key FROM customer")
def entity_keys(t, spark):
    """F11."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("")
    return t("customer").select("c_custkey", resolve.person_key(name, F.array(F.lit(""), "c_mktsegment"), F.lit("id")).alias("key"))


@query("SELECT event_id, round(CASE event_type WHEN 'click' THEN k * 2.5 / 1e6 + k * 10 / 1e6 ELSE 0 END, 8) AS cost_usd FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def list_prices(t, spark):
    """F13 by the built-in price list."""
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.when(F.col("event_type") == "click", "gpt-4o").otherwise("unlisted")
    return t("events").select("event_id", F.round(scores.list_price(model, k, k), 8).alias("cost_usd"))
