"""Queries that put one operator each to the test on inputs of several shapes, beside SQL that says the rule again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.functions import text
from lamplight.operators import navigation, reader, resolve, segments
from lamplight.plans import geo, stages
from lamplight.plans.registry import query
from lamplight.sources import html

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_a}', '{_b}')"


@query(f"SELECT page_id, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title FROM pages")
def html_title(t, spark):
    """The title, entities resolved and blanks collapsed."""
    return html.extract(t("pages"), "page_id", "url", "html", cut_titles=True).select("page_id", "title")


@query("""WITH links AS (SELECT s_suppkey, i, CASE (s_suppkey + i) % 3 WHEN 0 THEN '/hadc/transcript/Volume' || i || '/p.' || s_suppkey || '.htm' WHEN 1 THEN '/hadc/transcript/x.pdf' ELSE '/hadc/exhibits/y.htm' END AS url FROM supplier, range(5) r(i))
SELECT s_suppkey, CAST(i AS INTEGER) AS "index", 'Day ' || i AS label, url, 'source_hadc_p_' || s_suppkey AS source_id FROM links WHERE contains(url, '/hadc/transcript/') AND ends_with(url, '.htm')""")
def contents_entries(t, spark):
    """Links to transcripts, with the id that a source of that address has."""
    i, key = F.col("i"), F.col("s_suppkey")
    url = F.when((key + i) % 3 == 0, F.concat(F.lit("/hadc/transcript/Volume"), i, F.lit("/p."), key, F.lit(".htm"))).when((key + i) % 3 == 1, "/hadc/transcript/x.pdf").otherwise("/hadc/exhibits/y.htm")
    links = t("supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("s_suppkey", "i", F.concat(F.lit("Day "), i).alias("text"), url.alias("url"))
    pages = links.groupBy("s_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text", "url"))), lambda x: F.struct(x["text"].alias("text"), x["url"].alias("url"))).alias("links"))
    return html.toc_entries(pages, "s_suppkey")


@query("""WITH marks AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, CASE turn % 4 WHEN 0 THEN 'Volume K, Page ' || turn WHEN 2 THEN 'Cover, Page iv' ELSE NULL END AS label FROM conversations WHERE turn % 4 IN (0, 2))
SELECT conv_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(turn AS INTEGER) AS line_index, label, CASE turn % 4 WHEN 0 THEN CAST(turn AS VARCHAR) ELSE 'iv' END AS page_ref, CASE WHEN ordinal < 2 THEN 'http://h/' || conv_id || '/' || ordinal || '.htm' END AS facs FROM marks""")
def page_markers(t, spark):
    """Marker lines with their references, and images by place, none beyond the second."""
    line = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("[Image, Volume K, Page "), "turn", F.lit("]"))).when(F.col("turn") % 4 == 2, "[Image, Cover, Page iv]").otherwise(F.concat(F.lit("see [Image, Volume K, Page 9] "), "text"))
    rows = t("conversations").select("conv_id", F.col("turn").cast("int").alias("line_index"), line.alias("line"))
    links = [F.struct(F.lit(name).alias("text"), F.concat(F.lit("http://h/"), "conv_id", F.lit(f"/{end}")).alias("url")) for name, end in (("Image 1", "0.htm"), ("notes", "notes.txt"), ("p", "1.htm"))]
    pages = rows.select("conv_id").distinct().select("conv_id", F.array(*links).alias("links"))
    return html.page_cues(segments.page_markers(rows, "conv_id"), pages, "conv_id")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'MR. ALLEN,THE COURT' WHEN 1 THEN 'WITNESS ' || c_nationkey WHEN 2 THEN '' ELSE 'A JUROR,Mr. Zed' END AS speakers FROM customer""")
def named_speakers(t, spark):
    """Who is named at the beginning of a line, distinct and sorted."""
    k = F.col("c_custkey") % 4
    body = F.when(k == 0, "THE COURT: Go on.\nMR. ALLEN: Yes: no.\nMR. ALLEN: Again.").when(k == 1, F.concat(F.lit("WITNESS "), "c_nationkey", F.lit(" : I saw it.\nHe said MR. X: no."))).when(k == 2, "Mr. Long\nspeaks: not").otherwise("Mr. Zed:\n A JUROR: no\nA JUROR: why")
    return t("customer").select("c_custkey", F.array_join(text.named_speakers(body), ",").alias("speakers"))


@query(r"""SELECT page_id, 'source_hadc_' || CASE WHEN s = '' THEN 'unknown' ELSE s END AS source_id FROM (SELECT page_id, trim(regexp_replace(lower(strip_accents(regexp_replace(string_split(url, '/')[-1], '\.html?$', ''))), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM pages)""")
def source_ids(t, spark):
    """the id of an address."""
    return t("pages").select("page_id", text.source_id(F.col("url")).alias("source_id"))


@query("SELECT doc_id FROM documents WHERE (contains(CAST(doc_id AS VARCHAR), '7') OR contains(CAST(doc_id AS VARCHAR), '13')) AND lang IS DISTINCT FROM 'de'")
def pages_matching(t, spark):
    """Pages by tokens of their ids, without tables of contents (here German)."""
    rows = t("documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "de", "toc").otherwise(F.col("lang")).alias("source_type"))
    return reader.without_contents(reader.pages_matching(rows, "id", ["7", "13"])).select(F.col("id").cast("long").alias("doc_id"))


def _sources(t):
    """Customers as sources: their orders are events, their nation a place, their segment a topic."""
    day = F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    time = F.struct(day.alias("start"), F.lit("x").alias("original_text"))
    event = F.struct("o_orderkey", F.struct(F.col("o_orderpriority").alias("label"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("event_"), F.col("o_orderkey") % 50)).alias("canonical_id"), F.col("o_orderstatus").alias("location_label"), time.alias("event_time"), F.lit("filing").alias("event_kind")).alias("r"))
    events = t("orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(event)), lambda x: x["r"]).alias("events"))
    rows = t("customer").join(events, F.col("o_custkey") == F.col("c_custkey"), "left")
    entity = lambda label, key: F.array(F.struct(label.alias("label"), key.alias("canonical_id")))
    dated = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("1886-07-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0")))
    kind = rows.schema["events"].dataType
    nav = F.struct(
        F.col("c_name").alias("brief_title"), F.lit("Summary").alias("navigation_summary"), F.array("c_mktsegment", F.lit("trial")).alias("topics"),
        entity(F.concat(F.lit("Person "), "c_nationkey"), F.concat(F.lit("person_"), "c_nationkey")).alias("primary_people"),
        entity(F.concat(F.lit("Place "), F.col("c_custkey") % 9), F.lit(None).cast("string")).alias("primary_locations"),
        F.coalesce("events", F.array().cast(kind)).alias("referenced_events"), F.array().cast(kind).alias("document_events"),
        F.struct(dated.alias("normalized_date"), F.lit(None).cast("string").alias("original_text")).alias("document_date"),
    )
    return rows.select(F.col("c_custkey").alias("source_id"), F.col("c_custkey").alias("place"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 2 == 0, "testimony").otherwise("exhibit").alias("source_type"), F.lit("http://h/").alias("url"), nav.alias("navigation"))


_EVENTS = """ev AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 5 = 0 THEN 'event_' || (o_orderkey % 50) END AS canonical_id, o_orderpriority AS label, lower(trim(o_orderpriority)) AS low, lower(o_orderstatus) AS place FROM orders JOIN customer ON c_custkey = o_custkey)"""
_DATE = "CASE WHEN c_custkey % 3 > 0 THEN '1886-07-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') END"


@query(f"""SELECT c_custkey AS source_id, coalesce({_DATE}, 'Unknown Date') AS "group" FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING' AND contains(lower(c_name || ' testimony http://h/ ' || c_name || ' Summary ' || c_mktsegment || ' trial Person ' || c_nationkey || ' Place ' || (c_custkey % 9)), 'person 1')
  AND {_DATE} >= '1886-07-04' AND {_DATE} <= '1886-07-25'""")
def reader_sources(t, spark):
    """Sources by search, type, topic and dates, under the day they are shown in. Customers without events
    of a searched label alone match by other words."""
    f = reader.Filters(query="Person 1", source_type="testimony", topic="BUILDING", start="1886-07-04", end="1886-07-25")
    return reader.source_groups(reader.sources(_sources(t), f)).select("source_id", "group")


@query("SELECT c_custkey AS source_id FROM customer WHERE c_nationkey = 3 OR 'Person ' || c_nationkey = 'person_3'")
def sources_of_person(t, spark):
    """Sources that name a person by id."""
    return reader.sources(_sources(t), reader.Filters(person="person_3")).select("source_id")


@query("SELECT c_custkey AS source_id FROM customer WHERE c_custkey % 9 = 4")
def sources_of_place(t, spark):
    """Sources that name a place by label."""
    return reader.sources(_sources(t), reader.Filters(location="Place 4")).select("source_id")


@query(f"WITH {_EVENTS} SELECT DISTINCT o_custkey AS source_id FROM ev WHERE canonical_id = 'event_10' OR label = 'event_10' OR coalesce(canonical_id, coalesce(day, 'undated') || '|' || low || '|' || place) = 'event_10'")
def sources_of_event(t, spark):
    """Sources that refer to an event."""
    return reader.sources(_sources(t), reader.Filters(event="event_10")).select("source_id")


@query(f"""WITH {_EVENTS}, keyed AS (SELECT *, coalesce(canonical_id, coalesce(day, 'undated') || '|' || low || '|' || place) AS key FROM ev WHERE o_custkey % 2 = 0 AND day >= '1994-01-01' AND day <= '1996-12-31')
SELECT key, arg_min(label, o_custkey * 100000000 + o_orderkey) AS label, arg_min(day, o_custkey * 100000000 + o_orderkey) AS "group", string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY o_custkey, o_orderkey) AS sources FROM keyed GROUP BY key""")
def reader_timeline(t, spark):
    """Events of the matching sources' references, each under its first reference and its day."""
    out = reader.timeline(_sources(t), reader.Filters(source_type="testimony", start="1994-01-01", end="1996-12-31"))
    return out.select("key", "ref.label", "group", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("SELECT conv_id, CAST(min(turn) AS BIGINT) AS first_ FROM conversations WHERE turn % 5 = 2 GROUP BY conv_id")
def page_jumps(t, spark):
    """The first segment on a page."""
    rows = t("conversations").select("conv_id", F.col("turn").cast("long").alias("index"), (F.col("turn") % 5).cast("string").alias("page_ref"))
    return reader.page_jump(rows, "conv_id", "2").withColumnRenamed("index", "first_")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE coalesce(c_name, 'person_' || k) END AS reporter, CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE n_name END AS source
FROM (SELECT o_orderkey, o_custkey * 2 AS k, o_custkey % 30 AS n FROM orders) LEFT JOIN customer ON c_custkey = k LEFT JOIN nation ON n_nationkey = n""")
def claim_details(t, spark):
    """Who reports a claim, and its source, its own before that of its id."""
    own = F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.lit("own").alias("id"), F.lit("u").alias("url")))
    claims = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("person_"), F.col("o_custkey") * 2)).alias("reported_by_person_id"), (F.col("o_custkey") % 30).cast("string").alias("source_id"), own.alias("source"))
    people = t("customer").select(F.concat(F.lit("person_"), "c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.col("c_custkey").alias("ordinal"))
    sources = t("nation").select(F.col("n_nationkey").cast("string").alias("source_id"), F.col("n_name").alias("url"))
    return reader.claim_details(claims, people, sources).select("id", "reporter", F.when(F.col("source.id") == "own", "own").otherwise(F.col("source.url")).alias("source"))


@query("SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS unit_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 > 0 THEN -l_linenumber END NULLS LAST, CAST(l_linenumber AS VARCHAR)) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def audit_order(t, spark):
    """Audit rows in the order of their units, unknown ones last."""
    rows = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("unit_id")).distinct()
    units = rows.where(F.col("unit_id").cast("int") % 3 > 0).withColumn("unit_index", -F.col("unit_id").cast("int"))
    return reader.in_document_order(rows, units, "l_orderkey")


@query("""SELECT s_suppkey, concat_ws(' · ', CASE WHEN s_suppkey % 2 = 0 THEN '1886-07-01' WHEN s_suppkey % 3 = 0 THEN 'July 1' ELSE 'Unknown date' END, CASE WHEN s_suppkey % 5 > 0 THEN s_name END, CASE WHEN s_suppkey % 3 > 0 THEN 'Vol. K' END, CASE WHEN s_nationkey > 9 THEN 'pp. ' || s_nationkey END) AS line,
  CASE WHEN s_suppkey % 4 > 0 THEN CAST(CAST(round((s_suppkey % 4) * 25.0) AS INTEGER) AS VARCHAR) || '% confidence' END AS sure FROM supplier""")
def source_lines(t, spark):
    """the line under a source's title, and a confidence in percent."""
    k = F.col("s_suppkey")
    nav = F.struct(F.struct(F.when(k % 3 > 0, "K").otherwise("").alias("volume"), F.when(F.col("s_nationkey") > 9, F.col("s_nationkey").cast("string")).alias("sequence_label")).alias("document_order"), F.struct(F.when(k % 2 == 0, "1886-07-01").alias("normalized_date"), F.when(k % 3 == 0, "July 1").alias("original_text")).alias("document_date"))
    rows = t("supplier").select("s_suppkey", nav.alias("n"), F.struct(F.when(k % 5 > 0, F.col("s_name")).alias("witness_name")).alias("m"), F.when(k % 4 > 0, (k % 4) / 4).alias("c"))
    return rows.select("s_suppkey", reader.source_line(F.col("n"), F.col("m")).alias("line"), reader.confidence_label(F.col("c")).alias("sure"))


@query("""SELECT count(*) AS locations, count(*) FILTER (s_suppkey % 3 = 0) AS successes, count(*) FILTER (s_suppkey % 3 = 1) AS errors, count(*) FILTER (s_suppkey % 3 = 2) AS skipped, round(sum(CASE WHEN s_suppkey % 3 = 2 THEN 0 ELSE s_suppkey / 1000.0 END), 8) AS cost_usd FROM supplier""")
def geo_records(t, spark):
    """What became of the places of a run."""
    k = F.col("s_suppkey") % 3
    record = F.struct(F.when(k == 0, "success").when(k == 1, "error").otherwise("skipped_existing").alias("status"), F.when(k < 2, F.col("s_suppkey") / 1000).alias("cost_usd"))
    return geo.summary(t("supplier").select(record.alias("record")))


@query("SELECT min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM (SELECT o_orderkey, s_acctbal AS lat, CAST(s_nationkey AS DOUBLE) AS lng FROM orders JOIN supplier ON s_suppkey = o_custkey % 200 WHERE s_suppkey % 3 > 0)")
def map_frame(t, spark):
    """The frame of the events at places with both coordinates."""
    at = F.struct(F.col("s_acctbal").alias("lat"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey").cast("double")).alias("lng"))
    places = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ordinal"), at.alias("coordinates"))
    events = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).cast("string").alias("location_id"), F.array().cast("array<string>").alias("participant_person_ids"))
    return reader.bounds(reader.mapped_events(events, places))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN upper(p_name) END AS output, CASE WHEN p_partkey % 5 > 0 THEN 'success' ELSE 'error' END AS status, CAST(CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts,
  CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE length(p_name) END AS BIGINT) AS input_tokens, CASE WHEN p_partkey % 5 = 0 THEN 'ValueError: refused' END AS error FROM part WHERE p_partkey % 7 > 0""")
def service_calls(t, spark):
    """Calls to a service that refuses some, tried again; what an earlier run has is left out."""

    def client(prompt: str) -> dict:
        name, _, key = prompt.rpartition("#")
        if int(key) % 5 == 0:
            raise ValueError("refused")
        return {"output": name.upper(), "input_tokens": len(name)}

    asked = t("part").select("p_partkey", F.concat("p_name", F.lit("#"), "p_partkey").alias("prompt"))
    known = t("part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "success").otherwise("error").alias("status"), F.lit("done").alias("output"))
    todo = stages.resume(asked, known, "p_partkey")[1]
    return stages.call(todo, "p_partkey", "prompt", client, attempts=3).select("p_partkey", "output", "status", "attempts", "input_tokens", "error")


@query("""SELECT o_orderkey, kind, CASE kind WHEN 1 THEN 'filing' WHEN 2 THEN 'evidence_introduction' WHEN 3 THEN 'publication' WHEN 0 THEN 'court_procedure' ELSE 'other_document_event' END AS named, kind IN (0, 1, 2, 3) AS document FROM (SELECT o_orderkey, o_orderkey % 5 AS kind FROM orders)""")
def document_event_kinds(t, spark):
    """The kind of a document's event by the fixed terms, and whether it is one at all."""
    k = F.col("o_orderkey") % 5
    label = F.when(k == 0, "  MOTION for a new trial").when(k == 1, "Filing of the bill").when(k == 2, "Diagram  introduced into Evidence").when(k == 3, "Publication of a letter").otherwise("Meeting at the hall")
    rows = t("orders").select("o_orderkey", k.alias("kind"), label.alias("l"))
    return rows.select("o_orderkey", "kind", navigation.document_event_kind(F.col("l"), F.lit("by the clerk")).alias("named"), navigation.is_document_event(F.col("l"), F.lit(None).cast("string")).alias("document"))


@query("""SELECT c_custkey, d.day, CASE WHEN c_custkey % 4 = 0 THEN 'month' WHEN d.day IS NULL THEN 'unknown' ELSE 'day' END AS precision, CASE c_custkey % 3 WHEN 0 THEN 'K' ELSE 'L' END AS volume, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS INTEGER) ELSE 7 END AS first_, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey + 3 AS INTEGER) ELSE 8 END AS last_
FROM customer, LATERAL (SELECT CASE c_custkey % 4 WHEN 0 THEN '1886-05' WHEN 1 THEN '1886-07-16' WHEN 2 THEN '1887-11-11' END AS day) d""")
def source_dates(t, spark):
    """a source's date and place by its briefing and metadata."""
    k = F.col("c_custkey")
    given = F.struct(F.lit(None).cast("string").alias("original_text"), F.when(k % 4 == 0, "1886-05").alias("normalized_date"), F.when(k % 4 == 0, "month").otherwise("").alias("precision"))
    meta = F.struct(F.when(k % 4 == 1, "1886 July 16").when(k % 4 == 2, "Nov. 11, 1887").otherwise("sometime").alias("date_text"), F.when(k % 3 == 0, "K").otherwise("").alias("volume"), F.when(k % 2 == 0, F.concat(F.col("c_nationkey"), F.lit("-"), F.col("c_nationkey") + 3)).alias("pages"))
    order = F.struct(F.lit("L").alias("volume"), F.lit(7).alias("page_start"), F.lit(8).alias("page_end"), F.lit("7 f.").alias("sequence_label"))
    rows = t("customer").select("c_custkey", given.alias("g"), meta.alias("m"), order.alias("o"))
    out = rows.select("c_custkey", navigation.document_date(F.col("g"), F.col("m")).alias("d"), navigation.document_order(F.col("o"), F.col("m")).alias("o"))
    return out.select("c_custkey", F.col("d.normalized_date").alias("day"), "d.precision", "o.volume", F.col("o.page_start").alias("first_"), F.col("o.page_end").alias("last_"))


@query("""WITH all_ AS (SELECT 0 AS d, p_partkey AS ordinal, p_brand AS key, p_name AS value FROM part UNION ALL SELECT 1, p_partkey, p_brand, p_type FROM part WHERE p_size > 45)
SELECT key, arg_max(value, d * 10000000 + ordinal) AS value FROM all_ GROUP BY key""")
def merged_dictionaries(t, spark):
    """Of several dictionaries the last entry of each key."""
    rows = t("part").select(F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("key"), F.col("p_name").alias("value"), "p_type", "p_size")
    return resolve.last_wins([rows.select("ordinal", "key", "value"), rows.where("p_size > 45").select("ordinal", "key", F.col("p_type").alias("value"))], "key", "value")
