"""The engine's operators as queries over the driver's tables, each beside the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lamplight.functions import scores, text
from lamplight.operators import checks, costs, mentions, resolve, segments, timeline
from lamplight.plans.registry import query
from lamplight.sources import html

LABELS = [("person_the", "the"), ("person_ation", "ation"), ("location_und", "und")]
_LABELS = ", ".join(f"('{a}', '{b}')" for a, b in LABELS)
PRICES = [("click", 1.0, 2.0), ("view", 0.5, 1.5), ("purchase", 3.0, 6.0)]
_PRICES = ", ".join(map(str, PRICES))


def _labels(spark: SparkSession):
    return spark.createDataFrame(LABELS, "entity_id string, label string")


_SEG = """seg AS (SELECT conv_id, turn, role, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations)"""
_OCC = f"""cut AS (SELECT s.conv_id, s.turn, l.entity_id, l.label, string_split(lower(s.text), l.label) AS p FROM conversations s, (VALUES {_LABELS}) l(entity_id, label) WHERE contains(lower(s.text), l.label)),
  occ AS (SELECT conv_id, turn, entity_id, unnest(list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length(label))) AS pos, length(label) AS n FROM cut)"""


@query(f"WITH {_SEG} SELECT conv_id, turn, start, start + length(text) AS \"end\" FROM seg")
def segments_offsets(t, spark):
    return segments.offsets(t("conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "start", "end")


def _occurrences(t, spark):
    return mentions.occurrences(t("conversations").select("conv_id", "turn", "text"), _labels(spark), "text").select("conv_id", "turn", "entity_id", "start", "end")


@query(f"WITH {_OCC} SELECT conv_id, turn, entity_id, CAST(pos AS BIGINT) AS start, CAST(pos + n AS BIGINT) AS \"end\" FROM occ")
def mention_occurrences(t, spark):
    return _occurrences(t, spark)


@query(f"""WITH {_SEG}, {_OCC}, doc AS (SELECT o.conv_id, entity_id, s.start + pos AS m_start, s.start + pos + n AS m_end FROM occ o JOIN seg s USING (conv_id, turn))
SELECT s.conv_id, s.turn, s.role, s.start, s.start + length(s.text) AS "end", count(*) AS mentions, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS entities
FROM seg s JOIN doc m ON m.conv_id = s.conv_id AND m.m_start < s.start + length(s.text) AND m.m_end > s.start GROUP BY ALL""")
def segment_mentions(t, spark):
    seg = segments.offsets(t("conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "role", "start", "end")
    found = _occurrences(t, spark).withColumnsRenamed({"start": "s", "end": "e"}).join(seg.select("conv_id", "turn", F.col("start").alias("base")), ["conv_id", "turn"])
    found = found.select("conv_id", "entity_id", (F.col("base") + F.col("s")).alias("m_start"), (F.col("base") + F.col("e")).alias("m_end"))
    out = mentions.overlapping(seg, found, ["conv_id"]).groupBy("conv_id", "turn", "role", "start", "end")
    return out.agg(F.count("*").alias("mentions"), F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("entities"))


@query(f"""WITH RECURSIVE {_OCC}, found AS (SELECT conv_id, turn, entity_id, CAST(pos AS BIGINT) AS s, CAST(pos + n AS BIGINT) AS e FROM occ),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s, e DESC, entity_id) AS k FROM found),
  walk AS (SELECT conv_id, turn, k, s, e, entity_id, e AS cursor, true AS taken FROM ranked WHERE k = 1
    UNION ALL SELECT r.conv_id, r.turn, r.k, r.s, r.e, r.entity_id, CASE WHEN r.s >= w.cursor THEN r.e ELSE w.cursor END, r.s >= w.cursor FROM walk w JOIN ranked r ON r.conv_id = w.conv_id AND r.turn = w.turn AND r.k = w.k + 1)
SELECT conv_id, turn, s AS start, e AS "end", entity_id FROM walk WHERE taken""")
def mention_overlap_suppressed(t, spark):
    return mentions.suppress(_occurrences(t, spark), ["conv_id", "turn"], ["entity_id"])


@query("""SELECT event_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id, grp) AS ref FROM
(SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events)""")
def forward_fill_ref(t, spark):
    return segments.forward_fill(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "ref").select("event_id", "ref")


@query("""SELECT user_id, section, count(*) AS rows_, min(event_id) AS first_id FROM (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS section FROM events) WHERE section > 0 GROUP BY ALL""")
def page_sections(t, spark):
    out = segments.sections(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return out.groupBy("user_id", "section").agg(F.count("*").alias("rows_"), F.min("event_id").alias("first_id"))


@query("""SELECT conv_id, turn, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p), '') AS prior FROM (SELECT c.conv_id, c.turn, x.turn AS p FROM conversations c LEFT JOIN conversations x ON x.conv_id = c.conv_id AND x.turn < c.turn AND x.turn >= c.turn - 3) GROUP BY ALL""")
def prior_units(t, spark):
    return segments.prior_units(t("conversations"), ["conv_id"], ["turn"], F.col("turn").cast("string")).select("conv_id", "turn", F.array_join("prior", ",").alias("prior"))


_LINES = r"lines AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t]+', ' ', 'g')) AS line FROM documents)"


@query(f"""WITH {_LINES} SELECT doc_id, CASE WHEN regexp_matches(line, '^Q[\\.\\s]') THEN 'question' WHEN regexp_matches(line, '^A[\\.\\s]') THEN 'answer' WHEN regexp_matches(line, '^(MR|Mr|THE COURT|WITNESS|A JUROR)[:\\.\\s]') THEN 'speaker'
WHEN starts_with(line, '[') AND ends_with(line, ']') THEN 'reference' WHEN regexp_matches(line, '^[-*]\\s+\\[') THEN 'toc_entry' ELSE 'text' END AS kind, count(*) AS n FROM lines WHERE line <> '' GROUP BY ALL""")
def line_classify(t, spark):
    return segments.content_blocks(segments.line_rows(t("documents"), "doc_id", "text"), "doc_id").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


_NAV = " OR ".join([f"lower(line) IN ({', '.join(repr(x) for x in text.NAVIGATION_LINES)})", *(f"starts_with(lower(line), '{x}')" for x in text.NAVIGATION_STARTS)])


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER ({_NAV}) AS removed FROM lines WHERE line <> '' GROUP BY doc_id")
def navigation_filter(t, spark):
    rows = segments.line_rows(t("documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(text.is_navigation(F.col("line"))).alias("removed"))


@query("SELECT p_partkey, 'Image, Volume I, Page ' || p_size AS label, CAST(p_size AS VARCHAR) AS ref FROM (SELECT p_partkey, p_size FROM part)".replace("'Image, Volume I, Page ' || p_size", "'Volume I, Page ' || p_size"))
def page_ref_extract(t, spark):
    rows = t("part").select("p_partkey", F.format_string("[Image, Volume I, Page %d]", "p_size").alias("line"))
    return rows.select("p_partkey", text.marker_label(F.col("line")).alias("label")).withColumn("ref", text.page_ref(F.col("label")))


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'trialtoc') THEN 'toc' WHEN contains(lower(url), '/exhibits/') THEN 'exhibit' WHEN regexp_matches(lower(concat_ws(' ', url, '', substr(html, 1, 500))), 'testimony|direct examination|cross-examination') THEN 'testimony' ELSE 'transcript' END AS source_type FROM pages""")
def source_classify(t, spark):
    return t("pages").select("page_id", text.classify_source(F.col("url"), F.lit(""), F.col("html")).alias("source_type"))


@query("""SELECT o_orderkey, 'I' AS volume, CAST(o_custkey AS VARCHAR) AS pages, 'July ' || (o_orderkey % 28 + 1) || ', 1886' AS date_text, 'Witness ' || o_custkey AS witness FROM orders""")
def metadata_extract(t, spark):
    rows = t("orders").select("o_orderkey", F.format_string("Volume I, pages %d. July %d, 1886", "o_custkey", F.col("o_orderkey") % 28 + 1).alias("b"), F.format_string("Testimony of Witness %d, resumed", "o_custkey").alias("h"))
    m = text.metadata(F.lit("http://x/y"), F.col("h"), F.col("b"))
    return rows.select("o_orderkey", m.alias("m")).select("o_orderkey", "m.volume", "m.pages", "m.date_text", F.col("m.witness_name").alias("witness"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<a\\s+href="[^"]+"')) AS BIGINT) AS links FROM pages""")
def html_links(t, spark):
    return html.extract(t("pages"), "page_id", "url", "html").select("page_id", F.size("links").cast("long").alias("links"))


@query()
def html_core_text(t, spark):
    return html.extract(t("pages"), "page_id", "url", "html").select("page_id", "text", "raw_lines", "navigation_removed")


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(t, spark):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("SELECT page_id, substr(sha256(concat_ws('|', sha256(html), 'brief', 'tei', 'jsonl', 'tag')), 1, 16) AS key FROM pages")
def cache_key(t, spark):
    return t("pages").select("page_id", text.cache_key(F.sha2("html", 256), *map(F.lit, ("brief", "tei", "jsonl", "tag"))).alias("key"))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS hit FROM documents")
def cache_hit_miss(t, spark):
    hits, misses = costs.cache_split(t("documents").select("doc_id"), t("labels"), ["doc_id"])
    return hits.withColumn("hit", F.lit(True)).union(misses.withColumn("hit", F.lit(False)))


@query("SELECT source, NOT bool_and(l.doc_id IS NOT NULL) AS needed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def brief_needed(t, spark):
    known = t("labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return costs.briefing_needed(t("documents").join(known, "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "source", "hit")


_SLUG = "CASE WHEN {0} = '' THEN 'unknown' ELSE {0} END".format("lower(trim(regexp_replace(strip_accents({0}), '[^a-zA-Z0-9]+', '_', 'g'), '_'))")


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({i} AS VARCHAR) AS id, '{k}_' || {_SLUG.format(c)} AS slug FROM {k}" for k, i, c in (("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("pages", "page_id", "url"))))
def slugify_ids(t, spark):
    each = [t(k).select(F.lit(k).alias("kind"), F.col(i).cast("string").alias("id"), text.slug(F.col(c), k).alias("slug")) for k, i, c in (("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("pages", "page_id", "url"))]
    return each[0].union(each[1]).union(each[2])


def _parts(t):
    return t("part").withColumn("canonical", F.concat(F.lit("part_"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_")))


_PARTS = "parts AS (SELECT *, 'part_' || regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS canonical FROM part)"


@query(f"WITH {_PARTS} SELECT canonical, arg_min(p_name, p_partkey) AS name, arg_min(p_brand, p_partkey) AS brand, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS types, CAST(max(p_size) AS INTEGER) AS confidence FROM parts GROUP BY canonical")
def merge_entities(t, spark):
    items = _parts(t).select("canonical", "p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.array("p_type").alias("types"), F.col("p_size").alias("confidence"))
    return resolve.merge_entities(items, "canonical", ["p_partkey"]).withColumn("types", F.array_join("types", ","))


@query(f"WITH {_PARTS} SELECT l_orderkey, l_linenumber, coalesce(canonical, CAST(l_partkey AS VARCHAR)) AS part FROM lineitem LEFT JOIN parts ON p_partkey = l_partkey")
def id_map_rewrite(t, spark):
    ids = resolve.id_map(_parts(t).withColumn("old", F.col("p_partkey").cast("string")), "old", "canonical", ["p_partkey"])
    return resolve.rewrite_id(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part")), "part", ids)


@query(f"WITH {_PARTS} SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(canonical))), ',') AS parts FROM lineitem JOIN parts ON p_partkey = l_partkey GROUP BY l_orderkey")
def id_array_rewrite(t, spark):
    ids = resolve.id_map(_parts(t).withColumn("old", F.col("p_partkey").cast("string")), "old", "canonical", ["p_partkey"])
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("parts"))
    return resolve.rewrite_ids(rows, "l_orderkey", "parts", ids).withColumn("parts", F.array_join("parts", ","))


@query(f"WITH {_PARTS} SELECT count(*) AS raw, count(DISTINCT canonical) AS merged, count(*) - count(DISTINCT canonical) AS merges FROM parts")
def merge_counts(t, spark):
    return _parts(t).agg(F.count("*").alias("raw"), F.count_distinct("canonical").alias("merged")).withColumn("merges", F.col("raw") - F.col("merged"))


def _refs(t):
    odd = F.col("p_partkey") % 3
    return t("part").select("p_partkey", F.when(odd == 0, F.col("p_partkey").cast("string")).alias("canonical_id"), F.when(odd == 1, F.concat("p_name", F.lit(" (see below)"))).when(odd == 2, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("label"))


def _pool(t):
    return t("part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_partkey").alias("ordinal"), F.array("p_name").alias("labels"))


_FOUND = "CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN CAST(min(p_partkey) OVER (PARTITION BY lower(p_name)) AS VARCHAR) END"


@query(f"SELECT p_partkey, {_FOUND} AS entity_id FROM part")
def find_entity(t, spark):
    return resolve.find_entity(_refs(t), _pool(t), "p_partkey").select("p_partkey", "entity_id")


@query(f"SELECT f.p_partkey, coalesce(p.p_name, f.p_name || '?') AS label, coalesce(f.e, '') AS entity_id FROM (SELECT *, {_FOUND} AS e FROM part) f LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = f.e")
def normalize_refs(t, spark):
    found = resolve.find_entity(_refs(t), _pool(t), "p_partkey")
    names = t("part").select(F.col("p_partkey").cast("string").alias("entity_id"), "p_name")
    return found.join(names, "entity_id", "left").select("p_partkey", F.coalesce("p_name", "label").alias("label"), F.coalesce("entity_id", "canonical_id", F.lit("")).alias("entity_id"))


@query("SELECT key, name, CAST(nation AS INTEGER) AS nation FROM (SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer))")
def pool_union_first(t, spark):
    pools = [t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))]
    return resolve.pool_union(pools, "key", "name")


@query("SELECT o_orderkey, c_name AS source_title, c_mktsegment AS source_kind FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def claims_with_source(t, spark):
    return t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", F.col("c_name").alias("source_title"), F.col("c_mktsegment").alias("source_kind"))


@query("SELECT doc_id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS role, coalesce(CAST(l.toxic AS VARCHAR), d.source) AS title FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def catalog_fallback(t, spark):
    side = t("labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x"))
    return t("documents").join(side, "doc_id", "left").select("doc_id", F.coalesce(F.col("q").cast("string"), "lang").alias("role"), F.coalesce(F.col("x").cast("string"), "source").alias("title"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def doc_dedupe_first(t, spark):
    return resolve.first_wins(t("documents").where("text is not null").select(F.sha2("text", 256).alias("sha"), "doc_id"), ["sha"], ["doc_id"])


_RUNS = "runs AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens FROM events)"


def _runs(t):
    return t("events").withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))


@query(f"WITH {_RUNS} SELECT event_type AS model, count(*) AS records, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(value), 4) AS cost_usd FROM runs GROUP BY GROUPING SETS ((), (event_type))")
def cost_summary(t, spark):
    return costs.cost_summary(_runs(t), "event_type", "value", "tokens").select(F.col("event_type").alias("model"), "records", "tokens", F.round("cost_usd", 4).alias("cost_usd"))


@query("""SELECT stage, count(*) AS records, round(sum(cost), 4) AS cost_usd FROM (SELECT 'discount' AS stage, l_discount AS cost FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) WHERE cost <> 0 GROUP BY stage""")
def cost_by_stage(t, spark):
    out = costs.cost_by_stage(t("lineitem"), {"discount": "l_discount", "tax": "l_tax"}, {"discount": "l_discount", "tax": "l_tax"})
    return out.select("stage", "records", F.round("cost_usd", 4).alias("cost_usd"))


@query(f"WITH {_RUNS}, prices(model, i, o) AS (VALUES {_PRICES}) SELECT event_id, round(coalesce((tokens * i + tokens * 2 * o) / 1e6, 0), 8) AS cost_usd FROM runs LEFT JOIN prices ON model = event_type")
def estimate_cost(t, spark):
    usage = _runs(t).select("event_id", F.col("event_type").alias("model"), F.col("tokens").alias("input_tokens"), (F.col("tokens") * 2).alias("output_tokens"))
    return scores.estimate_cost(usage, spark.createDataFrame(PRICES, "model string, input_per_m double, output_per_m double")).select("event_id", "cost_usd")


_EVAL = f"""{_RUNS}, evals AS (SELECT event_type AS model, count(*) AS pages, round(avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END), 4) AS success_rate, CAST(sum(CASE WHEN value > 5 THEN tokens ELSE 0 END) AS BIGINT) AS claims, round(sum(value), 4) AS cost_usd FROM runs GROUP BY 1)"""


def _evals(t):
    runs = _runs(t).withColumns({"status": F.when(F.col("value") > 5, "success").otherwise("error"), "claims": F.col("tokens")})
    return costs.model_eval(runs, "event_type", "status", ["claims"], "value").withColumnRenamed("event_type", "model")


@query(f"WITH {_EVAL} SELECT * FROM evals")
def model_eval(t, spark):
    return _evals(t).select("model", "pages", "success_rate", "claims", F.round("cost_usd", 4).alias("cost_usd"))


@query(f"WITH {_EVAL} SELECT model FROM evals ORDER BY success_rate DESC, claims DESC, model LIMIT 1")
def choose_model(t, spark):
    return costs.choose_model(_evals(t), "model", ["claims"], "model").select("model")


@query("SELECT l_orderkey, count(*) AS attempts, round(sum(l_quantity), 2) AS usage, arg_max(l_linestatus, l_linenumber * 100000000 + l_partkey * 2 + CAST(l_linestatus = 'O' AS INTEGER)) AS status FROM lineitem GROUP BY l_orderkey")
def retry_totals(t, spark):
    attempt = F.col("l_linenumber") * F.lit(100000000).cast("long") + F.col("l_partkey") * 2 + (F.col("l_linestatus") == "O").cast("int")
    rows = t("lineitem").select("l_orderkey", attempt.alias("attempt"), F.col("l_quantity").alias("usage"), F.col("l_linestatus").alias("status"))
    out = costs.retry_totals(rows, "l_orderkey", "attempt", ["usage"], "status")
    return out.withColumn("usage", F.round("usage", 2))


@query(r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS w FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.w) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) / len(a.w) END, 4) AS recall FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def token_recall(t, spark):
    d = t("documents").select("doc_id", "text")
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id").select("doc_id", F.round(scores.token_recall(F.col("text"), F.col("other")), 4).alias("recall"))


@query()
def text_verdict(t, spark):
    c = t("conversations")
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other")), ["conv_id", "turn"])
    return scores.verdicts(pairs, "text", "other").select("conv_id", "turn", "recall", "ratio", "valid")


@query("""SELECT o_orderkey, coalesce((SELECT string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N'
  AND l_linenumber NOT IN (SELECT l_linenumber FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_linestatus = 'F' AND x.l_returnflag <> 'N')), '') AS missing FROM orders""")
def missing_refs(t, spark):
    line = F.col("l_linenumber").cast("string")
    sets = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "N", line)).alias("e"), F.collect_set(F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "N"), line)).alias("a"))
    return t("orders").join(sets, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.array_join(checks.missing(F.col("e"), F.col("a")), ",").alias("missing"))


@query("SELECT role, count(*) AS segments, count(*) FILTER (length(text) > 200) AS long_ones, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def speaker_stats(t, spark):
    return t("conversations").groupBy("role").agg(F.count("*").alias("segments"), F.count_if(F.length("text") > 200).alias("long_ones"), F.sum(F.length("text")).alias("chars"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def parse_date(t, spark):
    return t("orders").select("o_orderkey", text.parse_date(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("iso"))


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS start, CAST(p_size + 5 AS INTEGER) AS \"end\", CAST(p_size AS INTEGER) AS first_, CAST(p_size + 5 AS INTEGER) AS last_, CAST(p_size AS VARCHAR) AS refs FROM part")
def parse_page_range(t, spark):
    rows = t("part").select("p_partkey", F.format_string("pp. %d-%d", F.col("p_size"), F.col("p_size") + 5).alias("s"))
    out = rows.select("p_partkey", text.page_range(F.col("s")).alias("r"), text.number_range(F.col("s")).alias("n"), text.page_refs(F.col("s")).alias("p"))
    return out.select("p_partkey", F.col("r.start").cast("int").alias("start"), F.col("r.end").alias("end"), F.col("n.start").alias("first_"), F.col("n.end").alias("last_"), F.array_join("p", ",").alias("refs"))


_DATED = "dated AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events)"


def _dated(t):
    return t("events").withColumn("day", F.when(F.col("event_id") % 5 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd")))


@query(f"WITH {_DATED} SELECT event_id, day FROM dated WHERE (day = '' OR day >= '2024-01-05') AND (day = '' OR day <= '2024-01-20') AND value >= 2")
def event_filter(t, spark):
    return _dated(t).where(timeline.map_filter(F.col("day"), "2024-01-05", "2024-01-20", F.col("value"), 2.0)).select("event_id", "day")


@query(f"WITH {_DATED} SELECT event_id, day FROM dated WHERE day <> '' AND day >= '2024-01-05' AND day <= '2024-01-20'")
def date_range_filter(t, spark):
    return _dated(t).where(timeline.date_range(F.col("day"), "2024-01-05", "2024-01-20")).select("event_id", "day")


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE contains(lower(concat_ws(' ', d.lang, d.source, d.text)), 'the') AND l.quality = 1 GROUP BY d.doc_id")
def facet_filter(t, spark):
    hay = timeline.haystack(F.col("lang"), F.col("source"), F.col("text"))
    return t("documents").where(hay.contains("the")).join(t("labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")


@query(f"WITH {_DATED} SELECT day, event_type, count(DISTINCT user_id) AS sources, arg_min(event_id, event_id) AS first_id FROM dated GROUP BY ALL")
def grouped_timeline(t, spark):
    return timeline.grouped(_dated(t).withColumn("first_id", F.col("event_id")), ["day", "event_type"], ["event_id"], "user_id", ["first_id"]).drop("first_at")


@query("SELECT user_id, arg_max(event_type, event_id) AS label FROM events GROUP BY user_id")
def facet_options(t, spark):
    return timeline.facet_options(t("events").withColumnRenamed("event_type", "label"), "user_id", "label", ["event_id"])


@query("SELECT doc_id, row_number() OVER (ORDER BY nullif(CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END, '') NULLS LAST, nullif(source, '') NULLS LAST, l.q NULLS LAST, doc_id) AS place FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id)")
def source_order(t, spark):
    side = t("labels").groupBy("doc_id").agg(F.max("quality").alias("page_start"))
    rows = t("documents").join(side, "doc_id", "left").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("date"), F.col("source").alias("volume"), "page_start", F.col("doc_id").alias("title"))
    return resolve.rank(rows, [], timeline.source_order(), "place").select("doc_id", "place")


@query("SELECT o_orderkey, string_agg(p_name, ',' ORDER BY l_linenumber, p_name) AS claims FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def event_detail(t, spark):
    rows = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy("o_orderkey").agg(F.array_join(resolve.ordered("l_linenumber", "p_name"), ",").alias("claims"))


_KIND = "CASE s_suppkey % 5 WHEN 0 THEN 'ROOFTOP' WHEN 1 THEN 'RANGE_INTERPOLATED' WHEN 2 THEN 'GEOMETRIC_CENTER' WHEN 3 THEN 'APPROXIMATE' ELSE 'NONE' END"


@query(f"SELECT s_suppkey, round(least(b, coalesce(nullif(c, 0), b)), 2) AS confidence FROM (SELECT s_suppkey, (s_suppkey % 4) / 4.0 AS c, CASE s_suppkey % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 WHEN 3 THEN 0.55 ELSE 0.5 END AS b FROM supplier)")
def geo_confidence(t, spark):
    return t("supplier").select("s_suppkey", scores.geocode_confidence(F.expr(_KIND), (F.col("s_suppkey") % 4) / 4.0).alias("confidence"))


@query(f"SELECT {_KIND} AS status, count(*) AS n, round(sum(s_acctbal), 2) AS cost FROM supplier GROUP BY 1")
def geo_summary(t, spark):
    return t("supplier").groupBy(F.expr(_KIND).alias("status")).agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("s_acctbal", F.lit(0.0))), 2).alias("cost"))


@query("""SELECT 'customer' AS schema, CAST(c_custkey AS VARCHAR) AS id, path, message FROM (SELECT c_custkey, 'c_acctbal' AS path, 'below minimum' AS message FROM customer WHERE coalesce(c_acctbal < 0, true)
UNION ALL SELECT c_custkey, 'c_mktsegment', 'not in enum' FROM customer WHERE coalesce(c_mktsegment NOT IN ('BUILDING', 'MACHINERY'), true))""")
def validation_errors(t, spark):
    rules = {"c_acctbal": (F.col("c_acctbal") >= 0, "below minimum"), "c_mktsegment": (F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "not in enum"), "c_name": (F.col("c_name").rlike("^Customer#"), "pattern")}
    return checks.validation_errors(t("customer"), "customer", "c_custkey", rules)


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'publication' WHEN contains(lower(p_name), 'blue') OR contains(lower(p_name), 'bolt') THEN 'filing' ELSE 'other_document_event' END AS kind FROM part WHERE lower(p_type) NOT IN ('economy') AND NOT contains(lower(p_name), 'ring')")
def historical_filter(t, spark):
    kind = timeline.first_rule(F.col("p_name"), [("publication", ["red"]), ("filing", ["blue", "bolt"])], "other_document_event")
    return t("part").where(timeline.historical(F.col("p_type"), F.col("p_name"), ["economy"], ["ring"])).select("p_partkey", kind.alias("kind"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
walk AS (SELECT o_custkey, o_orderkey, k, s AS run, 0 AS chunk FROM o WHERE k = 1 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.k, CASE WHEN run + s > 500000 AND run > 0 THEN s ELSE run + s END, CASE WHEN run + s > 500000 AND run > 0 THEN chunk + 1 ELSE chunk END FROM walk w JOIN o ON o.o_custkey = w.o_custkey AND o.k = w.k + 1)
SELECT o_custkey, o_orderkey, CAST(chunk AS INTEGER) AS chunk FROM walk""")
def chunk_greedy(t, spark):
    return segments.greedy_chunks(t("orders"), "o_custkey", "o_orderkey", F.col("o_totalprice"), 500000)


_COUNTED = ["documents", "pages", "events", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{x}' AS dataset, count(*) AS rows_ FROM {x}" for x in _COUNTED))
def manifest_counts(t, spark):
    out = None
    for x in _COUNTED:
        one = t(x).agg(F.count("*").alias("rows_")).select(F.lit(x).alias("dataset"), "rows_")
        out = one if out is None else out.union(one)
    return out


@query("SELECT s_suppkey, CAST(list_sum(list_transform(string_split(s_name, ''), lambda c: ascii(c))) % 8 AS INTEGER) AS colour FROM supplier")
def person_colour(t, spark):
    return t("supplier").select("s_suppkey", scores.colour(F.col("s_name")).cast("int").alias("colour"))


@query("SELECT lang, count(*) AS entries, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang)")
def cache_inventory(t, spark):
    return costs.cache_inventory(t("documents"), "lang", "n_chars").withColumnRenamed("cost_usd", "chars")


@query("SELECT min(s_acctbal) AS south, max(s_acctbal) AS north, min(s_nationkey) AS west, max(s_nationkey) AS east FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal IS NOT NULL AND s_nationkey IS NOT NULL")
def map_bounds(t, spark):
    rows = t("supplier").join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("s_nationkey")).where("s_acctbal is not null and s_nationkey is not null")
    return rows.agg(F.min("s_acctbal").alias("south"), F.max("s_acctbal").alias("north"), F.min("s_nationkey").alias("west"), F.max("s_nationkey").alias("east"))
