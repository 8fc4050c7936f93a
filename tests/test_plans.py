import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamplight.operators import reader, resolve, runs
from lamplight.plans import contracts, geo, publish
from lamplight.sources import store

USAGE = runs.USAGE


def test_publish_annotates_own_entities(spark):
    docs = spark.createDataFrame([("s", "<TEI><text><body><p>Ann met ann at Lake.</p><p>Lake</p></body></text></TEI>"), ("t", "<TEI><text><body><p>Ann</p></body></text></TEI>"), ("u", None), ("v", "<x")], "source_id string, tei string")
    people = spark.createDataFrame([("s", "p1", 0.5, "Ann", ["Al"])], "source_id string, id string, confidence double, display_name string, alternate_names array<string>")
    places = spark.createDataFrame([("s", "l1", None, "Lake", "Lake", None)], "source_id string, id string, confidence double, name string, address_1886 string, address_1887 string")
    got = {r["source_id"]: r for r in publish.publish(docs, {"people": people, "locations": places}).collect()}
    assert set(got) == {"s", "t", "v"} and got["v"]["error"] and got["t"]["mentions"] == []
    text = got["s"]["text"]
    assert [(m["entity_id"], text[m["start"] : m["end"]], m["text"]) for m in got["s"]["mentions"]] == [("p1", "Ann", "Ann"), ("p1", "ann", "ann"), ("l1", "Lake", "Lake"), ("l1", "Lake", "Lake")]
    assert got["s"]["source_stats"]["mentions"] == 4 and got["s"]["tei"].count("<annotation ") == 4


def test_publish_reads_annotated_documents_in_the_same_pass(spark):
    docs = spark.range(2).select(F.col("id").alias("source_id"), F.lit("<TEI><text><body><p>Ann met ann.</p></body></text></TEI>").alias("tei"))
    people = spark.range(1).select(F.col("id").alias("source_id"), F.lit("p1").alias("id"), F.lit(0.5).alias("confidence"), F.lit("Ann").alias("display_name"), F.array().cast("array<string>").alias("alternate_names"))
    out = publish.publish(docs, {"people": people})
    assert {r["source_id"]: [m["start"] for m in r["mentions"]] for r in out.collect()} == {0: [0, 8], 1: []}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # the text that is searched, the document that is published


def test_validation(spark):
    pages = spark.createDataFrame([("a", "Q. What is it?", ["19", "20"]), ("b", "quite other words stand here", []), ("c", "x", []), ("d", "", None)], "source_id string, text string, page_refs array<string>")
    docs = spark.createDataFrame([("a", '<TEI><text><body><pb n="19"/><sp type="answer" who="#x"><speaker>Q.</speaker><p>What is it?</p></sp></body></text><annotation target="#no"/></TEI>'), ("b", "<TEI><text><body><p>zzz</p></body></text></TEI>"), ("c", "<x"), ("d", "<TEI/>")], "source_id string, tei string")
    got = {r["source_id"]: r for r in publish.validate(pages, docs).collect()}
    assert got["a"]["status"] == "invalid" and got["a"]["missing_page_refs"] == ["20"] and got["a"]["warnings"] and got["a"]["answer_turns_with_who"] == 1
    assert "drift" in got["b"]["errors"][0] and got["c"]["errors"][0].startswith("XML parse error") and got["d"]["errors"] == ["Missing TEI body"]


def test_geolocation(spark):
    shape = "o int, id string, name string, modern_address string, coordinates struct<lat: double, lng: double, method: string>"
    rows = [(0, "l1", "Lake", None, None), (1, "l1", "again", None, None), (2, "l2", "old", "m", (1.0, 2.0, geo.METHOD)), (3, "l3", "fails", "keep", None), (4, "l4", "nowhere", None, None)]

    def modernize(prompt):
        if "fails" in prompt:
            raise RuntimeError("down")
        return {"output": json.dumps({"modern_query": "" if "nowhere" in prompt else "q", "confidence": 0.6}), "input_tokens": 10}

    def geocode(query):
        return json.dumps({"status": "OK", "results": [{"formatted_address": "F", "place_id": "P", "geometry": {"location": {"lat": 41.5, "lng": -87.5}, "location_type": "ROOFTOP"}}]})

    out = geo.geolocate(spark.createDataFrame(rows, shape), modernize, geocode, "o", price=lambda i, o: i * 0.1)
    got = {r["id"]: r for r in out.collect()}
    assert (got["l1"]["name"], got["l1"]["modern_address"], got["l1"]["coordinates"]["lat"], got["l1"]["coordinates"]["confidence"], got["l1"]["geocoding"]["status"]) == ("Lake", "F", 41.5, 0.6, "success")
    assert got["l2"]["record"]["status"] == geo.SKIPPED and got["l2"]["coordinates"]["lng"] == 2.0
    assert got["l3"]["modern_address"] == "keep" and got["l3"]["geocoding"]["error"] == geo.NO_QUERY and got["l4"]["record"]["error"] == geo.NO_QUERY
    assert tuple(geo.summary(out).first()) == (4, 1, 2, 1, 2.0)


def test_usage_and_audits(spark):
    answers = spark.createDataFrame([('{"usage": {"prompt_tokens": 3, "completion_tokens": 4, "output_tokens_details": {"reasoning_tokens": 2}}, "output": [{}, {"content": [{"type": "x"}, {"type": "output_text", "text": "hello"}]}]}',), ("{}",)], "a string")
    got = answers.select(runs.usage_of(F.col("a")).alias("u"), runs.answer_length(F.col("a")).alias("n")).collect()
    assert [tuple(r["u"]) for r in got] == [(3, 4, 7, 2, 0), (0, 0, 0, 0, 0)] and [r["n"] for r in got] == [5, 0]
    stage = f"struct<status: string, error: string, cost_usd: double, usage: {USAGE}, unit_count: bigint, success_count: bigint, error_count: bigint>"

    def of(status, ok=1, bad=0):
        return (status, "why", 0.5, (1, 2, 3, 0, None), 2, ok, bad)

    rows = [("a", "M-1", of("error"), of("success"), of("success")), ("b", "M-1", None, of("error"), None), ("c", "M-1", None, of("success"), None), ("d", "M-1", None, of("success"), of("x", 0, 2))]
    out = runs.combined_audit(spark.createDataFrame(rows, f"page_id string, model string, briefing {stage}, transcription {stage}, tagging {stage}"))
    got = {r["page_id"]: r for r in out.collect()}
    assert [(got[k]["status"], got[k]["error"]) for k in "abcd"] == [("success", None), ("error", "transcription: why"), ("error", "tagging stage skipped"), ("error", "all 2 tagging units failed")]
    assert (got["a"]["call_id"], got["a"]["cost_usd"], got["a"]["usage"]["total_tokens"]) == ("a_m_1", 1.5, 9)
    hits = spark.createDataFrame([("p", "m", "k", "r", 2.0)], "page_id string, model string, cache_key string, produced_by_run_id string, cost_usd double")
    cached = runs.cached_audit(hits)
    assert out.unionByName(cached, allowMissingColumns=True).count() == 5 and cached.first()["cached_original_cost_usd"] == 2.0


def test_bundles_totals_and_missing_fields(spark):
    person = "struct<id: string, display_name: string, roles: array<string>, confidence: double>"
    rows = spark.createDataFrame([("d", 1, "success", 2, (1, 1, 2, 0, 0), 0.1, ([("p", "late", ["x", "a"], 0.9), (None, "n", None, None)],)), ("d", 0, "success", 1, None, None, ([("p", "first", ["z", "x"], 0.1)],)), ("d", 2, "error", None, None, 0.2, None)], f"s string, unit_index int, status string, attempts int, usage {USAGE}, cost_usd double, tags struct<people: array<{person}>>")
    got = sorted(runs.bundle_items(rows, "s", "people").collect(), key=lambda r: r["id"] or "~")
    assert [(r["id"], r["display_name"], r["roles"], r["confidence"]) for r in got] == [("p", "first", ["z", "x", "a"], 0.9), (None, "n", None, None)]
    t = runs.tagging_totals(rows, "s").first()
    assert (t["unit_count"], t["success_count"], t["error_count"], t["retried_count"], t["people"], t["usage"]["total_tokens"], t["cost_usd"]) == (3, 2, 1, 1, 3, 2, 0.3)
    bundles = spark.createDataFrame([("m", '{"tei_xml": null, "people": [{"id": null, "display_name": 1, "roles": []}]}'), ("m", '{"quotes": []}')], "m string, b string")
    assert runs.missing_fields(bundles, "m", "b").first()["missing"] == ["bundle.tei_xml", "people.bio"]


def test_chunks(spark):
    sections = spark.createDataFrame([("d", 0, 0, "one", "19"), ("d", 1, 0, "two", "20"), ("d", 2, 1, "three", None)], "s string, index int, chunk int, text string, page_ref string")
    cues = spark.createDataFrame([("d", 0, "19"), ("d", 1, "20"), ("d", 2, "21")], "s string, ordinal int, page_ref string")
    got = runs.chunk_table(sections, cues, "s").orderBy("chunk").collect()
    assert [(r["text"], r["page_range"]) for r in got] == [("one\ntwo", "19-20"), ("three", "19-21")]
    sent = runs.input_diagnostics(spark.createDataFrame([("d", 1, "m", "ab", "", None), ("d", 0, "m", "c", "xyz", "1")], "s string, chunk int, mode string, text string, raw_html_excerpt string, page_range string"), "s").first()
    assert (sent["sent_chars"], sent["chunk_count"], sent["page_ranges"]) == (6, 2, ["1", None])


def test_directories_and_dictionaries(spark):
    rows = spark.createDataFrame([("s", 0, "Élan", "#x"), ("s", 1, "elan", "y"), ("s", 2, None, "z")], "s string, o int, display_name string, speaker_id string")
    assert [(r["display_name"], r["speaker_id"]) for r in runs.speaker_directory(rows, "s", "o").collect()] == [("Élan", "person_elan")]
    a, b = (spark.createDataFrame(x, "ordinal int, id string, label string") for x in ([(0, "i", "A"), (1, "i", "B")], [(0, "i", "C"), (1, None, "D")]))
    assert [tuple(r) for r in resolve.last_wins([a, b], "id", "label").collect()] == [("i", "C")]


def test_reader(spark):
    time = "struct<start: string, original_text: string>"
    ref = f"struct<label: string, canonical_id: string, event_kind: string, event_time: {time}, location_label: string, confidence: double>"
    entity = "array<struct<label: string, canonical_id: string>>"
    shape = f"source_id string, place int, title string, source_type string, url string, metadata struct<witness_name: string>, navigation struct<brief_title: string, navigation_summary: string, document_date: struct<normalized_date: string, original_text: string>, document_order: struct<volume: string, sequence_label: string>, topics: array<string>, primary_people: {entity}, primary_locations: {entity}, referenced_events: array<{ref}>, document_events: array<{ref}>>"
    rally, walk = ("Rally", "e1", None, ("1886-05-04T10", None), "Market", 0.5), ("A  walk", None, None, (None, "soon"), "Lake", None)
    rows = [
        ("s1", 0, "One", "testimony", "u", ("Ann",), ("B", "sum", ("1886-07-16", None), ("I", "3-8"), ["bomb"], [("Ann", "p1")], [], [rally, walk], [])),
        ("s2", 1, "Two", "exhibit", "u", None, ("C", "", (None, None), (None, None), None, None, None, [("a Walk", None, None, (None, None), "lake", None), rally], [])),
    ]
    df = spark.createDataFrame(rows, shape)
    ids = lambda **f: sorted(r["source_id"] for r in reader.sources(df, reader.Filters(**f)).collect())
    assert ids() == ["s1", "s2"] and ids(query="BOMB") == ["s1"] and ids(person="p1") == ["s1"] and ids(event="Rally") == ["s1", "s2"] and ids(topic="bomb") == ["s1"] and ids(start="1880") == ["s1"] and ids(source_type="toc") == []
    got = reader.timeline(df, reader.Filters()).orderBy(*reader.timeline_order()).collect()
    assert [(r["key"], r["ref"]["label"], r["sources"], r["group"]) for r in got] == [("e1", "Rally", ["s1", "s2"], "1886-05-04"), ("undated|a walk|lake", "A  walk", ["s1", "s2"], "Undated Events")]
    assert reader.timeline(df, reader.Filters(start="1886")).count() == 1
    lines = df.orderBy("place").select(reader.source_line(F.col("navigation"), F.col("metadata")).alias("l"), reader.event_line(F.get("navigation.referenced_events", 0)).alias("e")).collect()
    assert [tuple(r) for r in lines] == [("1886-07-16 · Ann · Vol. I · pp. 3-8", "1886-05-04 · Market · 50% confidence"), ("Unknown date", "Undated · lake")]


def test_details(spark):
    events = spark.createDataFrame([("e", "l", ["p", "q"]), ("f", "m", None)], "id string, location_id string, participant_person_ids array<string>")
    people = spark.createDataFrame([(0, "p", "Ann"), (1, "p", "Bea")], "ordinal int, id string, display_name string")
    places = spark.createDataFrame([(0, "l", "Lake", (1.0, 2.0)), (1, "m", "x", (None, 2.0))], "ordinal int, id string, name string, coordinates struct<lat: double, lng: double>")
    got = reader.mapped_events(events, places)
    assert [(r["id"], r["location_name"], r["primary_person"]) for r in got.collect()] == [("e", "Lake", "p")] and tuple(reader.bounds(got).first()) == (1.0, 1.0, 2.0, 2.0)
    assert reader.person_pills(events, people).first()["pills"] == ["Bea", "q"]
    claims = spark.createDataFrame([("c", "s", "p", None), ("d", "s", "z", ("own", "w")), ("e", "t", None, None)], "id string, source_id string, reported_by_person_id string, source struct<id: string, url: string>")
    out = {r["id"]: r for r in reader.claim_details(claims, people, spark.createDataFrame([("s", "u")], "source_id string, url string")).collect()}
    assert [(out[k]["reporter"], out[k]["source"] and out[k]["source"]["url"]) for k in "cde"] == [("Bea", "u"), ("z", "w"), ("unknown", None)]


def test_contracts(tmp_path):
    part = {"type": "object", "title": "P", "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^p"}, "more": {"type": "string"}}}
    whole = {"$id": "x", "type": "object", "properties": {"people": {"type": "array", "items": {}}, "n": {"type": ["number", "null"], "minimum": 0}, "open": {}}}
    for n, s in (("w.json", whole), ("p.json", part)):
        (tmp_path / n).write_text(json.dumps(s))
    got = contracts.strict(contracts.load(str(tmp_path), "w.json", {"people.items": "p.json"}))
    assert got == {"type": "object", "properties": {"people": {"type": "array", "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}}, "additionalProperties": False}}, "n": {"type": ["number", "null"]}, "open": {}}, "additionalProperties": False, "required": ["people", "n", "open"]}
    assert contracts.ddl(got) == "struct<`people`: array<struct<`id`: string>>, `n`: double, `open`: variant>"


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/raw"
    pages = spark.createDataFrame([("source_a", "T")], "source_id string, title string")
    store.pull(pages, root, "20260101T000000Z")
    got = store.pull(pages.withColumn("title", F.lit("U")), root, "20260102T000000Z").first()
    assert got["title"] == "U" and got["paths"]["tei"] == f"{root}/20260102T000000Z/tei/source_a.xml"
    assert store.load_run(spark, root, "pages").first()["title"] == "U" and store.load_run(spark, root, "pages", "20260101T000000Z").first()["title"] == "T"
    assert store.run_id(spark, "2026-01-02T03:04:05Z") == "20260102T030405Z"
    (tmp_path / "enriched" / "people").mkdir(parents=True)
    (tmp_path / "enriched" / "people" / "latest.json").write_text('{"items": [{"id": "p"}]}')
    schemas = {n: StructType().add("id", "string") for n in store.DATASETS}
    assert [store.map_payload(spark, f"file://{tmp_path}/enriched", schemas)[n].count() for n in ("people", "events")] == [1, 0]
    for name, text, n in (("empty", '{"items": []}', 0), ("list", '[{"id": "a"}, {"id": "b"}]', 2)):
        (tmp_path / f"{name}.json").write_text(text)
        assert store.read_items(spark, f"file://{tmp_path}/{name}.json", schemas["people"]).count() == n
    with pytest.raises(KeyError):
        store.dataset(spark, root, "other", schemas)
    assert store.clear_generated(spark, f"file://{tmp_path}") > 1
    links = spark.createDataFrame([(0, "http://h/hadc/transcript/b.htm"), (1, "http://h/x.htm"), (2, "http://h/hadc/transcript/b.htm"), (3, "http://h/hadc/transcript/a.htm")], "index int, url string")
    assert [r["url"][-5:] for r in store.corpus_urls("http://h/toc", links).orderBy("ordinal").collect()] == ["h/toc", "b.htm", "a.htm"]
    bundles = spark.createDataFrame([("source_a", 0, "x"), ("source_a", 1, "y")], "source_id string, o int, v string")
    assert store.last_bundle(pages, bundles, "o").first()["bundle"]["v"] == "y"


def test_small_reader_rules(spark):
    pages = spark.createDataFrame([("source_ab", "toc", "1"), ("source_b", None, "2"), ("source_c", "exhibit", None)], "source_id string, source_type string, page_ref string")
    assert sorted(r[0] for r in reader.without_contents(pages).select("source_id").collect()) == ["source_b", "source_c"]
    assert reader.pages_matching(pages, "source_id", ["_b", "ab"]).count() == 2 and reader.by_key(pages, "source_id", "source_b").count() == 1
    with pytest.raises(ValueError):
        reader.pages_matching(pages, "source_id", ["zz"])
    with pytest.raises(ValueError):
        reader.by_key(pages, "source_id", "b")
    rows = spark.createDataFrame([("d", 0, "1", "a"), ("d", 1, "2", "b"), ("d", 2, "2", "c")], "k string, index int, page_ref string, unit_id string")
    assert reader.page_jump(rows, "k", "2").first()["index"] == 1
    audit = spark.createDataFrame([("d", "c"), ("d", "x"), ("d", "a")], "k string, unit_id string")
    placed = reader.in_document_order(audit, rows.withColumnRenamed("index", "unit_index"), "k").orderBy("place").collect()
    assert [r["unit_id"] for r in placed] == ["a", "c", "x"]


def test_small_run_rules(spark, tmp_path):
    ids = spark.createDataFrame([("a", "A")], "old_id string, canonical_id string")
    claims = spark.createDataFrame([("c", "a", ["b", "a", None])], "id string, who string, subjects array<string>")
    assert tuple(resolve.rewrite_bundle(claims, "id", {"who": ids}, {"subjects": ids}).select("id", "who", "subjects").first()) == ("c", "A", ["A", "b"])
    pages = spark.createDataFrame([("s", "toc"), ("t", None)], "source_id string, source_type string")
    results = spark.createDataFrame([("t", "success", True, (1, 2, 3, 0, 0), 0.5)], f"source_id string, status string, reused boolean, usage {USAGE}, cost_usd double")
    r = runs.brief_totals(pages, results).first()
    assert (r["pages"], r["skipped"], r["briefings"], r["reused"], r["usage"]["total_tokens"], r["cost_usd"]) == (1, 1, 1, 1, 3, 0.5)
    assert runs.cacheable(results).count() == 1
    item = spark.createDataFrame([([("##p",)], (None, 1.0, None, None))], "i array<struct<id: string>>, c struct<lat: double, lng: double, confidence: double, method: string>")
    got = item.select(runs.bare_ids(F.col("i")).alias("i"), runs.coordinates(F.col("c")).alias("c")).first()
    assert got["i"][0]["id"] == "p" and tuple(got["c"]) == (None, 1.0, 0.0, runs.UNRESOLVED_METHOD)
    (tmp_path / "a.txt").write_text("x\ny\n")
    assert store.read_text(spark, f"file://{tmp_path}/a.txt").first()["text"] == "x\ny\n"
    row = spark.range(1).select(store.cache_paths("r", F.lit("k"), F.lit("p")).alias("c"), store.brief_path("r", F.lit("1"), F.lit("M 1"), F.lit("p")).alias("b")).first()
    assert row["c"]["bundle"] == "r/k/p/bundle.json" and row["b"] == "r/1/m_1/p/briefing.json"
