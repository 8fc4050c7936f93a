from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamplight.functions import scores, text
from lamplight.operators import checks, mentions, resolve, segments
from lamplight.plans import publish, stages
from lamplight.sources import html, store, tei


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def most_rows(plan):
    """Rows out of the plan's step that gave the most; the plan has run, without adaptive execution."""
    held = plan.metrics().get("numOutputRows")
    return max([held.get().value() if held.isDefined() else 0, *(most_rows(plan.children().apply(i)) for i in range(plan.children().size()))])


def test_lines_and_markers(spark):
    body = "Title\n[Image, Volume I, Page 19]\nQ. What?\nA Yes.\n[Image, Volume I, Page 20]\nMR. NAME: hello"
    rows = segments.content_blocks(segments.line_rows(spark.createDataFrame([("d", body)], "id string, t string"), "id", "t"), "id").orderBy("line_index").collect()
    assert [r["kind"] for r in rows] == ["text", "reference", "question", "answer", "reference", "speaker"]
    assert [r["page_ref"] for r in rows] == [None, "19", "19", "19", "20", "20"]


def test_parse_date(spark):
    for s, want in [("1886 July 16", "1886-07-16"), ("July 16, 1886", "1886-07-16"), ("Sept. 3, 1886", "1886-09-03"), ("August 9, 1886", "1886-08-09"), ("soon", None)]:
        assert one(spark, text.parse_date(F.col("s")), s=s) == want


def test_slug(spark):
    assert [one(spark, text.slug(F.col("s"), "person"), s=s) for s in ("Élan Vital!", "日本", "a--b")] == ["person_elan_vital", "person_unknown", "person_a_b"]


def test_page_refs(spark):
    assert one(spark, text.page_refs(F.col("s")), s="pp. 24-27") == ["24"]
    assert one(spark, text.page_refs(F.col("s")), s="K 12") == ["K 12"]


def test_merge_entities_keeps_first_filled_values(spark):
    rows = spark.createDataFrame([("a", 1, "", 0.2, ["x"]), ("a", 2, "n", 0.9, ["b", "x"]), ("a", 3, "m", 0.5, None)], "id string, o int, name string, confidence double, tags array<string>")
    r = resolve.merge_entities(rows, "id", ["o"]).first()
    assert (r["name"], r["confidence"], r["tags"]) == ("n", 0.9, ["b", "x"])


def test_find_entity_prefers_ids_then_pool_order(spark):
    pool = spark.createDataFrame([("p2", 1, ["Ann (elder)"]), ("p1", 0, ["Ann"])], "entity_id string, ordinal long, labels array<string>")
    refs = spark.createDataFrame([(1, "p2", "Bob"), (2, None, "ANN"), (3, None, "Cy"), (4, "p9", "ann (x)")], "r int, canonical_id string, label string")
    assert {r["r"]: r["entity_id"] for r in resolve.find_entity(refs, pool, "r").collect()} == {1: "p2", 2: "p1", 3: None, 4: "p1"}


def test_find_entity_joins_the_first_of_a_label_alone(spark):
    pool = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("entity_id"), F.col("id").alias("ordinal"), F.array(F.lit("Same (name)")).alias("labels"))
    refs = spark.range(2000).select(F.col("id").alias("r"), F.lit(None).cast("string").alias("canonical_id"), F.lit("same").alias("label"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = resolve.find_entity(refs, pool, "r")
        assert {r["entity_id"] for r in found.collect()} == {"p0"}
        assert most_rows(found._jdf.queryExecution().executedPlan()) <= 4000  # 4,000,000 pairs if each met all
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_occurrences_and_suppression(spark):
    texts = spark.createDataFrame([("d", "Aaaa banana BANANA")], "id string, t string")
    labels = spark.createDataFrame([("e", "ana"), ("f", "banana"), ("g", "aa")], "entity_id string, label string")
    rows = mentions.occurrences(texts, labels, "t").select("id", "entity_id", "start", "end")
    assert sorted((r["entity_id"], r["start"]) for r in rows.collect()) == [("e", 6), ("e", 13), ("f", 5), ("f", 12)]
    kept = mentions.suppress(rows, ["id"], ["entity_id"]).collect()
    assert sorted((r["entity_id"], r["start"]) for r in kept) == [("f", 5), ("f", 12)]


def test_verdict_needs_both_bars_missed(spark):
    rows = spark.createDataFrame([("a b c d", "d c b a"), ("a b c d", "x y z w"), ("", "")], "a string, b string")
    assert [r["valid"] for r in scores.verdicts(rows, "a", "b").collect()] == [True, False, True]


def test_geocode_confidence(spark):
    rows = spark.createDataFrame([("ROOFTOP", 0.0), ("ROOFTOP", 0.4), ("?", None)], "k string, c double")
    assert [r[0] for r in rows.select(scores.geocode_confidence(F.col("k"), F.col("c"))).collect()] == [0.95, 0.4, 0.5]


def test_validation_errors(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "n string, i int")
    found = checks.validation_errors(rows, "s", "i", {"n": (F.col("n").isNotNull(), "required")}).collect()
    assert [(r["id"], r["path"]) for r in found] == [("2", "n")]


def test_html_drops_scripts_and_navigation(spark):
    page = "<title> A  b </title><p>One</p><a href='x.htm'>[Image 1]</a><script>no()</script><p>Go to next page</p><p>Return to top</p>"
    r = html.parse(page, "http://h/d/i.htm")
    assert r["title"] == "A b" and "no()" not in r["text"] and r["navigation_removed"] == 2
    assert r["links"] == [{"text": "[Image 1]", "url": "http://h/d/x.htm"}]


def test_tei_repairs_and_offsets(spark):
    raw = 'noise <TEI><text><body><pb n="19"><sp who="#p1"><speaker>Mr X</speaker><p>Hi  &c. <seg corresp="#e" xml:id="m">there</seg></p></sp><pb/><p>Q</p></body></text><annotation target="#m" type="place"/><annotation target="#gone"/></TEI> tail'
    doc = tei.read(tei.parse(tei.cut_out(raw)))
    assert [(r["kind"], r["page_ref"], r["start"], r["end"], r["speaker_id"]) for r in doc["segments"]] == [("speech", "19", 0, 17, "p1"), ("text", None, 18, 19, None)]
    assert [(p["page_ref"], p["offset"]) for p in doc["page_refs"]] == [("19", 0), (None, 17)]
    assert [(m["kind"], m["entity_id"], doc["text"][m["start"] : m["end"]]) for m in doc["mentions"]] == [("entity", "e", "there"), ("place", "e", "there")]
    assert doc["dangling"] == ["gone"] and (doc["speech_turns"], doc["turns_with_who"]) == (1, 1)
    assert tei.units(tei.parse(tei.cut_out(raw)))[0] == {"unit_index": 0, "unit_id": "sp_000", "kind": "sp", "speaker_id": "p1", "page_ref": "19", "text": "Mr XHi &c. there"}
    bad = tei.segment_rows(spark.createDataFrame([(1, "<TEI><p></TEI>"), (2, None)], "k long, t string"), "k", "t").collect()
    assert all(r["error"] for r in bad) and len(bad) == 2


BODY = "Title & <b>\n[Image, Volume I, Page 19]\nQ. What?\nA Yes.\n[Image, front]\nMR. NAME: hello\nWITNESS leaves\n[stage]"


def test_tei_from_lines_reads_back(spark):
    rows = spark.createDataFrame([("s1", BODY, ["i1"]), ("s2", None, None)], "id string, t string, images array<string>")
    one = tei.build(F.col("id"), F.lit('http://u/"x"'), F.lit("T"), F.lit("testimony"), F.lit("now"), F.lit("ff"), F.col("t"), F.col("images"))
    made = {r["id"]: r["tei"] for r in rows.select("id", one.alias("tei")).collect()}
    for text in made.values():
        assert tei.serialize(tei.ET.fromstring(text)) == text
    doc = tei.read(tei.parse(made["s1"]))
    assert [(s["kind"], s["line"], s["page_ref"], s["text"]) for s in doc["segments"]] == [("text", 0, None, "Title & <b>"), ("question", 2, "19", "Q. What?"), ("answer", 3, "19", "A Yes."), ("speaker", 5, "front", "MR. NAME: hello"), ("speaker", 6, "front", "WITNESS leaves"), ("reference", 7, "front", "[stage]")]
    assert [p["facs"] for p in doc["page_refs"]] == ["i1", None] and tei.read(tei.parse(made["s2"]))["text"] == ""


def test_tei_lines_without_a_blank_after_the_speaker(spark):
    said = ["A.### The&&& rest", "Q.What? A. no", "MR. X:well: so", "A.", "Q. What", "A.. b", "THE COURT: :x"]
    one = tei.build(*(F.lit(x) for x in ("s", "u", "T", "k", "now", "ff")), F.col("t"), F.array().cast("array<string>"))
    made = spark.createDataFrame([("\n".join(said),)], "t string").select(one).first()[0]
    assert [s["text"] for s in tei.read(tei.parse(made))["segments"]] == said and made.count("<speaker>") == len(said)
    text, found = tei.block_text(tei.ET.fromstring('<sp><speaker> A. </speaker><p rend="run-on">at <seg corresp="#l">Lake</seg></p><p>my <seg corresp="#l">Lake</seg></p></sp>'))
    assert text == "A.at Lake my Lake" and [text[m["start"] : m["end"]] for m in found] == ["Lake", "Lake"]


def test_tei_from_rows(spark):
    rows = spark.createDataFrame([("d", 0, "19", None, None, " a "), ("d", 1, "19", "Mr X", "p", "b & c"), ("d", 2, None, "Mr Y", "#q", "d"), ("d", 3, "20", "Z", None, " "), ("e", 0, None, None, None, None)], "id string, o int, page string, speaker string, speaker_id string, text string")
    cues = spark.createDataFrame([("d", "20", "f20")], "id string, page_ref string, facs string")
    made = {r["id"]: r["tei"] for r in tei.synthesize(rows, cues, "id", "o").collect()}
    for text in made.values():
        assert tei.serialize(tei.ET.fromstring(text)) == text
    doc = tei.read(tei.parse(made["d"]))
    assert [(s["line"], s["page_ref"], s["speaker_id"], s["text"]) for s in doc["segments"]] == [(None, "19", None, "a"), (0, "19", "p", "Mr X b & c"), (1, "19", "q", "Mr Y d")]
    assert [(p["page_ref"], p["facs"]) for p in doc["page_refs"]] == [("19", None), ("20", "f20")]


def test_tei_combines_rewrites_and_annotates(spark):
    part = "<TEI><text><body><div><p>{}</p></div></body></text><standOff><listAnnotation>{}</listAnnotation></standOff></TEI>"
    rows = spark.createDataFrame([("d", 1, part.format("two", "b")), ("d", 0, part.format("one", "a")), ("e", 0, "<x"), ("f", 0, "<x"), ("f", 1, "y")], "id string, o int, t string")
    made = {r["id"]: r for r in tei.combined(rows, "id", "o", "t").collect()}
    assert tei.read(tei.parse(made["d"]["tei"]))["text"] == "one\ntwo" and made["d"]["tei"].count("<standOff>") == 1 and "b" in made["d"]["tei"]
    assert made["e"]["tei"] == "<x" and made["f"]["error"]
    docs = spark.createDataFrame([("d", '<TEI><text><body><p corresp="#a b" xml:id="a">Ann</p></body></text></TEI>', {"a": "c"}, [("m", "person", "c", 0, 3, "Ann", 0.123456)])], "id string, t string, ids map<string, string>, m array<struct<id: string, kind: string, entity_id: string, start: long, end: long, text: string, confidence: double>>")
    assert 'corresp="#c b" xml:id="c"' in tei.rewritten(docs, "id", "t", "ids").first()["tei"].replace('xml:id="c" corresp="#c b"', 'corresp="#c b" xml:id="c"')
    out = tei.annotated(docs, "id", "t", "m")
    assert 'cert="0.1235"' in out.first()["tei"]
    got = tei.transcripts(out, "id", "tei").first()
    assert [(m["kind"], m["entity_id"], m["start"], m["end"], m["text"]) for m in got["mentions"]] == [("person", "c", 0, 3, "Ann")]


def test_jsonl_rows(spark):
    raw = 'prose\n```\n{"text": "a"}\n{"text": null}\n{"x": 1}\n{broken}\n```'
    assert one(spark, F.size(store.jsonl_rows(F.col("s"))), s=raw) == 2


def test_paths_stay_below_the_root(tmp_path, spark):
    assert store.resolve("/r", "a/../b") == "/r/b"
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError):
            store.resolve("/r", bad)
    (tmp_path / "f").write_text("x")
    assert store.clear(spark, f"file://{tmp_path}") == 1 and store.clear(spark, f"file://{tmp_path}") == 0


def test_calls_retry_and_never_raise(spark):
    def client(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return {"output": prompt.upper(), "input_tokens": 3, "output_tokens": 1}

    rows = {r["k"]: r for r in stages.call(spark.createDataFrame([(1, "ok"), (2, "bad")], "k long, p string"), "k", "p", client).collect()}
    assert (rows[1]["output"], rows[1]["status"], rows[2]["status"], rows[2]["attempts"]) == ("OK", "success", "error", 2)


def test_occurrences_in_the_text_itself(spark):
    texts = spark.createDataFrame([(1, "\u0130x the Cat, a CATalogue \\E cat"), (2, "no such thing")], "id long, t string")
    labels = spark.createDataFrame([("c", "cat"), ("e", "\\E c"), ("s", "at")], "entity_id string, label string")
    want = [("c", 7, 10), ("c", 14, 17), ("c", 27, 30), ("e", 24, 28)]
    assert sorted((r["entity_id"], r["start"], r["end"]) for r in mentions.occurrences(texts, labels, "t").collect()) == want
    many = labels.union(spark.range(1200).selectExpr("concat('n', id)", "concat('zq', id, 'w')"))
    assert sorted((r["entity_id"], r["start"], r["end"]) for r in mentions.occurrences(texts, many, "t").collect()) == want
    assert mentions.occurrences(texts, labels.limit(0), "t").count() == 0


def test_texts_with_labels_of_their_own_are_not_broadcast(spark):
    texts = spark.range(3).select(F.col("id").alias("d"), F.concat(F.lit("At the Lake "), "id").alias("t"))
    labels = spark.range(2).select(F.col("id").alias("d"), F.lit("lake").alias("label"))
    found = mentions.occurrences(texts, labels, "t", on=["d"])
    assert sorted((r["d"], r["start"], r["end"]) for r in found.collect()) == [(0, 7, 11), (1, 7, 11)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_documents_leave_workers_a_few_at_a_time(spark):  # a session parses types
    docs = SimpleNamespace(schema=StructType.fromDDL("k long, t string"), select=lambda *c: SimpleNamespace(mapInArrow=lambda run, ddl: run))
    worked = []
    run = tei._each(docs, "k", ["t"], {"n": "long"}, lambda t: worked.append(t) or {"n": int(t)})
    texts = ["x" if i == 700 else str(i) for i in range(1000)]
    out = run(iter([pa.record_batch({"k": range(1000), "t": texts}), pa.record_batch({"k": [1000, 1001], "t": ["1000" + " " * tei.HELD_BYTES, "1001"]})]))
    first = next(out)
    assert len(worked) == first.num_rows == tei.HELD_ROWS
    rest = list(out)
    assert [b.num_rows for b in rest] == [256, 256, 232, 1, 1]
    rows = [r for b in (first, *rest) for r in b.to_pylist()]
    assert [r["k"] for r in rows] == list(range(1002)) and [r["n"] for r in rows] == [None if i == 700 else i for i in range(1002)] and rows[700]["error"]


def test_validation_broadcasts_no_documents(spark):
    docs = spark.range(2).select(F.col("id").alias("source_id"), F.lit("<TEI><text><body><p>a</p></body></text></TEI>").alias("tei"))
    out = publish.validate(spark.range(2).select(F.col("id").alias("source_id"), F.lit("a").alias("text"), F.array().cast("array<string>").alias("page_refs")), docs)
    assert [r["status"] for r in out.collect()] == ["valid"] * 2
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_mentions_are_sorted_without_their_texts(spark):
    texts = spark.range(2).select(F.col("id").alias("source_id"), F.lit("Ann met ann").alias("text"))
    labels = spark.range(2).select(F.col("id").alias("source_id"), F.lit("person").alias("kind"), F.lit("p").alias("entity_id"), F.explode(F.array(F.lit("Ann"), F.lit("ann"))).alias("label"), F.lit(0.5).alias("confidence"))
    found = publish.entity_mentions(texts, labels)
    assert sorted((r["source_id"], r["start"], r["text"]) for r in found.collect()) == [(0, 0, "Ann"), (0, 8, "ann"), (1, 0, "Ann"), (1, 8, "ann")]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
