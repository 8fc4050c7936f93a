from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamplight.operators import navigation as nav

META = "struct<volume: string, pages: string, date_text: string, witness_name: string>"
PEOPLE = "ordinal int, id string, display_name string, alternate_names array<string>, roles array<string>, confidence double, source_ids array<string>"
PLACES = "ordinal int, id string, name string, address_1886 string, address_1887 string, modern_address string, location_type string, confidence double, source_ids array<string>"
EVENTS = f"ordinal int, id string, title string, time {nav.TIME}, location_id string, participant_person_ids array<string>, description string, confidence double, claim_ids array<string>"
BRIEF = f"source_id string, brief_title string, navigation_summary string, summary string, document_date struct<original_text: string, normalized_date: string, precision: string>, document_order struct<volume: string, page_start: int, page_end: int, sequence_label: string>, document_role string, topics array<string>, primary_people array<{nav.ENTITY_REF}>, primary_locations array<{nav.ENTITY_REF}>, referenced_events array<{nav.EVENT_REF}>, document_events array<{nav.EVENT_REF}>"


def event(label, canonical=None, **more):
    base = dict.fromkeys("label canonical_id event_kind event_time location_label location_id participant_labels participant_person_ids summary supporting_quote page_refs confidence".split())
    return base | {"label": label, "canonical_id": canonical} | more


def built(spark):
    pages = spark.createDataFrame([("s1", "Testimony", "testimony", ("I", "pp. 3-8", "July 16, 1886", "Ann")), ("s2", "Motion for trial", "transcript", (None, None, None, None))], f"source_id string, title string, source_type string, metadata {META}")
    people = spark.createDataFrame([(0, "p1", "Ann", ["Annie (maid)"], ["cook", "maid", "x"], 0.5, ["s2"]), (1, "p2", "Bob", [], None, 0.7, ["s9"]), (2, "p3", "annie", None, None, None, None)], PEOPLE)
    places = spark.createDataFrame([(0, "l1", "Market", "12 Lake St", None, None, "square", 0.4, ["s2"])], PLACES)
    events = spark.createDataFrame([(0, "e1", "Rally", ("1886-05-04T19:30", None, None, None, None, "evening"), "l1", ["p2", "p7"], "At the square", 0.9, ["c1"])], EVENTS)
    claims = spark.createDataFrame([("c1", "s2"), ("c2", "s2"), ("c3", "s1")], "id string, source_id string")
    refs = [("ANNIE", None, "witness", 0.3), ("Bob", "p2", None, None), (None, None, "x", 1.0), ("Zed", None, None, None)]
    evs = [event("rally", page_refs=["pp. 4-5", "4"], supporting_quote="q"), event("Walk", location_label="12 lake st", participant_labels=["Bob", "nobody"], participant_person_ids=["p1", "", "p2"]), event("Order filed", confidence=0.2)]
    brief = spark.createDataFrame([("s1", None, "", "sum", None, None, "", [" b ", "a", "b", None], refs, [], evs, [])], BRIEF)
    pool = [nav.pool(nav.scope(x), x, labels) for x, labels in ((people, nav.PERSON_LABELS), (places, nav.LOCATION_LABELS))]
    return pages, nav.build(pages, brief, claims, *pool, nav.pool(nav.scope_events(events, claims), events, nav.EVENT_LABELS))


def test_navigation(spark):
    pages, df = built(spark)
    assert df.schema["navigation"].dataType.simpleString() == StructType.fromDDL(f"n {nav.NAVIGATION}")["n"].dataType.simpleString()
    got = {r["source_id"]: r["navigation"] for r in df.collect()}
    a, b = got["s1"], got["s2"]
    assert (a["brief_title"], a["navigation_summary"], a["document_role"], a["topics"]) == ("Testimony", "sum", "testimony", ["a", "b"])
    assert tuple(a["document_date"]) == ("July 16, 1886", "1886-07-16", "day")
    assert tuple(a["document_order"]) == ("I", 3, 8, "pp. 3-8")
    assert [(p["label"], p["canonical_id"]) for p in a["primary_people"]] == [("Ann", "p1"), ("Bob", "p2"), ("Zed", None)]
    rally, walk = a["referenced_events"]
    assert (rally["canonical_id"], rally["location_label"], rally["participant_labels"], rally["page_refs"], rally["supporting_quote"]) == ("e1", "Market", ["Bob", "p7"], ["4"], "q")
    assert (rally["event_time"]["normalized_date"], rally["event_time"]["precision"], rally["event_time"]["original_text"]) == ("1886-05-04", "unknown", "evening")
    assert (walk["location_id"], walk["location_label"], walk["participant_person_ids"]) == ("l1", "Market", ["p1", "p2"])
    assert [(d["label"], d["event_kind"]) for d in a["document_events"]] == [("Order filed", "filing")]
    assert (a["claim_count"], a["event_reference_count"], a["document_event_count"]) == (1, 2, 1)
    assert a["confidence"] == round((0.3 + 0.9 + 0.2) / 3, 3)
    # no briefing: the source's own entities; people of other sources stay identifiers
    assert (b["document_role"], b["document_date"]["precision"], b["claim_count"]) == ("legal_document", "unknown", 2)
    assert [(p["label"], p["role_or_relationship"]) for p in b["primary_people"]] == [("Ann", "cook, maid")]
    assert [(e["label"], e["location_label"], e["participant_labels"]) for e in b["referenced_events"]] == [("Rally", "Market", ["p2", "p7"])]


def test_catalogue_fallback(spark):
    pages, df = built(spark)
    got = {r["source_id"]: r["navigation"] for r in nav.with_fallback(pages, df.where("source_id = 's2'")).collect()}
    assert [(p["label"], p["role_or_relationship"]) for p in got["s1"]["primary_people"]] == [("Ann", "witness")]
    assert tuple(got["s1"]["document_order"]) == ("I", 3, 8, "pp. 3-8") and got["s1"]["claim_count"] == 0
    assert got["s2"]["event_reference_count"] == 1


def test_own_entities_hide_shared_ones_of_their_id(spark):
    shape = "ordinal int, id string, name string"
    own = spark.createDataFrame([("s", 0, "a", "X")], "source_id string, " + shape)
    pool = nav.pool(own, spark.createDataFrame([(0, "a", "Y"), (1, "b", "Y (2)"), (2, None, "W")], shape), ["name"])
    refs = spark.createDataFrame([("s", 0, None, "y"), ("s", 1, "a", "q"), ("t", 2, None, "Y"), ("s", 3, "?", "w"), ("s", 4, None, None)], "source_id string, pos int, c string, l string")
    found = nav.find(refs, ["source_id", "pos"], F.col("c"), F.col("l"), pool).collect()
    assert {r["pos"]: r["e"] and (r["e"]["id"], r["e"]["name"]) for r in found} == {0: ("b", "Y (2)"), 1: ("a", "X"), 2: ("a", "Y"), 3: (None, "W"), 4: None}
