"""What a reader navigates a source by: people, places, events, dates and order, from briefings and entity pools.

References and entities are child tables, so every lookup is an equi-join. An entity is looked for first among those of the
reference's own source (scoped), then among those of the whole run (shared); a shared entity that the source has itself
doesn't count again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions.text import contains_any, document_role, label_variants, normalize_label, number_range, or_null, page_range, page_refs_of, parse_date
from lamplight.operators.resolve import first_wins, participants

# Fixed values.
DOCUMENT_EVENT_TERMS = ["introduced into evidence", "introduction of", "publication", "published", "filing", "filed", "catalog", "page copying", "transcript", "change of venue", "petition", "motion", "order", "arraignment", "remand", "grand jury presentment", "empaneling", "swearing of the cook county grand jury"]
DOCUMENT_EVENT_KINDS = [
    ("publication", ["publication", "published"]),
    ("filing", ["filing", "filed"]),
    ("evidence_introduction", ["introduced into evidence", "introduction of", "exhibit"]),
    ("source_description", ["catalog", "page copying", "source", "transcript"]),
    ("court_procedure", ["petition", "motion", "order", "arraignment", "remand", "grand jury", "empaneling"]),
    ("document_creation", ["created", "creation", "drawn", "made"]),
]
HISTORICAL_EXCLUDED_TYPES = ["evidence", "exhibit", "testimony", "source", "document"]
HISTORICAL_EXCLUDED_TITLES = ["introduced into evidence", "diagram of", "testimony of"]
PERSON_LABELS, LOCATION_LABELS, EVENT_LABELS = ["display_name", "alternate_names"], ["name", "address_1886", "address_1887", "modern_address"], ["title"]
FALLBACK_ENTITIES = 8

TIME = "struct<start: string, end: string, normalized_date: string, precision: string, original_text: string, display: string>"
ENTITY_REF = "struct<label: string, canonical_id: string, role_or_relationship: string, confidence: double>"
#: What an event reference of a briefing has; document events have the kind too.
EVENT_REF = f"struct<label: string, canonical_id: string, event_kind: string, event_time: {TIME}, location_label: string, location_id: string, participant_labels: array<string>, participant_person_ids: array<string>, summary: string, supporting_quote: string, page_refs: array<string>, confidence: double>"
STRINGS = "array<string>"
_SHOWN_TIME = "struct<start: string, end: string, normalized_date: string, precision: string, original_text: string>"
_SHOWN_EVENT = f"event_time: {_SHOWN_TIME}, location_label: string, location_id: string, participant_labels: array<string>, participant_person_ids: array<string>, summary: string, supporting_quote: string, page_refs: array<string>, confidence: double"
#: What build makes, as a type: for sources that are read, or that there are none of.
NAVIGATION = (
    "struct<brief_title: string, navigation_summary: string, document_date: struct<original_text: string, normalized_date: string, precision: string>, "
    "document_order: struct<volume: string, page_start: int, page_end: int, sequence_label: string>, document_role: string, topics: array<string>, "
    f"primary_people: array<{ENTITY_REF}>, primary_locations: array<{ENTITY_REF}>, referenced_events: array<struct<label: string, canonical_id: string, {_SHOWN_EVENT}>>, "
    f"document_events: array<struct<label: string, event_kind: string, {_SHOWN_EVENT}>>, claim_count: bigint, event_reference_count: bigint, document_event_count: bigint, confidence: double>"
)


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(STRINGS))


def event_time(t: Column) -> Column:
    """A time as references carry it: the start's day is its normalized date."""
    start = F.coalesce(or_null(t["start"]), or_null(t["normalized_date"]))
    return F.struct(start.alias("start"), t["end"].alias("end"), F.substring(start, 1, 10).alias("normalized_date"), F.coalesce(or_null(t["precision"]), F.lit("unknown")).alias("precision"), F.coalesce(or_null(t["display"]), t["original_text"]).alias("original_text"))


def document_event_text(label: Column, summary: Column) -> Column:
    return normalize_label(F.concat(F.coalesce(label, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))


def is_document_event(label: Column, summary: Column) -> Column:
    return contains_any(document_event_text(label, summary), DOCUMENT_EVENT_TERMS)


def document_event_kind(label: Column, summary: Column) -> Column:
    text = document_event_text(label, summary)
    return F.coalesce(*(F.when(contains_any(text, terms), kind) for kind, terms in DOCUMENT_EVENT_KINDS), F.lit("other_document_event"))


def document_date(given: Column, metadata: Column) -> Column:
    """The briefing's date, else that of the metadata; its day, if any, by the date rules."""
    text = F.coalesce(or_null(given["original_text"]), or_null(metadata["date_text"]))
    day = F.coalesce(or_null(given["normalized_date"]), parse_date(text))
    return F.struct(text.alias("original_text"), day.alias("normalized_date"), F.coalesce(or_null(given["precision"]), F.when(day.isNotNull(), "day").otherwise("unknown")).alias("precision"))


def document_order(given: Column, metadata: Column) -> Column:
    """Volume and pages: the metadata's before the briefing's."""
    pages = page_range(metadata["pages"])
    label = F.when(pages["start"].isNotNull(), metadata["pages"]).otherwise(given["sequence_label"])
    return F.struct(F.coalesce(or_null(metadata["volume"]), given["volume"]).alias("volume"), F.coalesce(pages["start"], given["page_start"]).alias("page_start"), F.coalesce(pages["end"], given["page_end"]).alias("page_end"), label.alias("sequence_label"))


# ---- pools


@dataclass(frozen=True)
class Pool:
    """Entities to look in: scoped (source_id, ordinal, id, labels, e) and shared (ordinal, id, labels, e), the latter once
    per id; e is the entity's row."""

    scoped: DataFrame
    shared: DataFrame


def labels_of(columns: list[str], df: DataFrame) -> Column:
    """All labels of an entity, arrays among them, in the order of the columns."""
    return F.concat(*(_list(F.col(c)) if df.schema[c].dataType.simpleString() == STRINGS else F.array(F.col(c)) for c in columns))


def label_of(columns: list[str], df: DataFrame, entity: str = "e") -> Column:
    """The first label of an entity that isn't empty."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema[entity].dataType}
    return F.coalesce(*(F.get(F.filter(F.col(f"{entity}.{c}"), lambda x: F.coalesce(x, F.lit("")) != ""), 0) if fields[c] == STRINGS else or_null(F.col(f"{entity}.{c}")) for c in columns))


def pool(scoped: DataFrame, shared: DataFrame, labels: list[str]) -> Pool:
    """scoped: entities with source_id and ordinal; shared: with ordinal. Ids come once, first wins; entities without stay."""

    def shape(df: DataFrame, keys: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in ("source_id", "ordinal")]
        return first_wins(df.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), "id", labels_of(labels, df).alias("labels"), F.struct(*rest).alias("e")), [*keys, "id"], ["ordinal"])

    return Pool(shape(scoped, ["source_id"]), shape(shared, []))


def scope(entities: DataFrame) -> DataFrame:
    """Entities per source of their source_ids."""
    return entities.withColumn("source_id", F.explode(F.array_distinct("source_ids")))


def scope_events(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Events per source that any of their claims comes from."""
    link = claims.select(F.col("id").alias("_claim"), "source_id").where("_claim is not null").distinct()
    ids = events.select("ordinal", F.explode(F.array_distinct("claim_ids")).alias("_claim")).join(link, "_claim").select("ordinal", "source_id").distinct()
    return events.join(ids, "ordinal")


def find(refs: DataFrame, keys: list[str], canonical: Column, label: Column, within: Pool) -> DataFrame:
    """refs (source_id among keys) with e, the entity found or null: by id, else the first in pool order that shares a label
    variant."""
    base = refs.select(*keys, or_null(canonical).alias("_id"), label.alias("_label"))
    ids = base.where("_id is not null").select(*keys, F.col("_id").alias("id"))
    variants = base.select(*keys, F.explode(label_variants(F.col("_label"))).alias("_v"))
    own, all_ = (p.select(*(c for c in ("source_id",) if c in p.columns), "ordinal", "id", "e", F.explode(F.array_distinct(F.flatten(F.transform("labels", lambda x: label_variants(x))))).alias("_v")) for p in (within.scoped, within.shared))
    hits = [
        ids.join(within.scoped, ["source_id", "id"]),
        ids.join(within.shared, "id"),
        variants.join(own, ["source_id", "_v"]),
        variants.join(all_, "_v").join(within.scoped.select("source_id", "id").distinct(), ["source_id", "id"], "left_anti"),
    ]
    every = None
    for rank, h in enumerate(hits):
        one = h.select(*keys, F.struct(F.lit(rank).alias("r"), "ordinal").alias("_at"), "e")
        every = one if every is None else every.unionByName(one)
    return refs.join(every.groupBy(*keys).agg(F.min_by("e", "_at").alias("e")), keys, "left")


def by_id(rows: DataFrame, column: str, within: Pool, name: str, shared: bool = True) -> DataFrame:
    """rows with the entity of an id as name; of the source's own first, of all unless shared is off."""
    out = rows.join(within.scoped.where("id is not null").select("source_id", F.col("id").alias(column), F.col("e").alias("_own")), ["source_id", column], "left")
    if not shared:
        return out.withColumnRenamed("_own", name)
    return out.join(within.shared.where("id is not null").select(F.col("id").alias(column), F.col("e").alias("_all")), column, "left").withColumn(name, F.coalesce("_own", "_all")).drop("_own", "_all")


# ---- references


def _rows(briefings: DataFrame, column: str) -> DataFrame:
    return briefings.select("source_id", F.posexplode(column).alias("pos", "r")).where("r is not null").select("source_id", "pos", "r.*")


def _gather(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """(source_id, name): rows as an array in order."""
    return rows.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("r")))), lambda x: x["r"]).alias(name))


ENTITY_FIELDS = ["label", "canonical_id", "role_or_relationship", "confidence"]
EVENT_FIELDS = ["label", "canonical_id", "event_time", "location_label", "location_id", "participant_labels", "participant_person_ids", "summary", "supporting_quote", "page_refs", "confidence"]
DOCUMENT_EVENT_FIELDS = ["event_kind" if c == "canonical_id" else c for c in EVENT_FIELDS]


def entity_refs(refs: DataFrame, within: Pool, labels: list[str]) -> DataFrame:
    """refs (source_id, pos, ENTITY_FIELDS) under the label and id of what they name; those with neither go."""
    found = find(refs, ["source_id", "pos"], F.col("canonical_id"), F.col("label"), within)
    held = F.col("e").isNotNull()
    out = found.withColumns({"label": F.when(held, label_of(labels, found)).otherwise(F.col("label")), "canonical_id": F.when(held, F.col("e.id")).otherwise(F.col("canonical_id"))})
    return out.where("label <> '' or canonical_id <> ''").select("source_id", "pos", *ENTITY_FIELDS)


def event_views(events: DataFrame, people: Pool, places: Pool, shared: bool) -> DataFrame:
    """(source_id, pos, EVENT_FIELDS) of events (source_id, pos, id, title, time, ...): names of place and participants by
    id; an unknown participant shows as the id."""
    placed = by_id(events, "location_id", places, "_place", shared)
    each = by_id(events.select("source_id", "pos", F.posexplode("participant_person_ids").alias("k", "_who")), "_who", people, "_person", shared)
    named = each.groupBy("source_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce(or_null(F.col("_person.display_name")), "_who").alias("n")))), lambda x: x["n"]).alias("_names"))
    out = placed.join(named, ["source_id", "pos"], "left")
    view = [F.col("title").alias("label"), F.col("id").alias("canonical_id"), event_time(F.col("time")).alias("event_time"), F.col("_place.name").alias("location_label"), "location_id", _list(F.col("_names")).alias("participant_labels"), _list(F.col("participant_person_ids")).alias("participant_person_ids"), F.coalesce("description", F.lit("")).alias("summary"), _none("string").alias("supporting_quote"), F.array().cast(STRINGS).alias("page_refs"), F.col("confidence").cast("double").alias("confidence")]
    return out.select("source_id", "pos", *view)


def described(refs: DataFrame, people: Pool, places: Pool) -> DataFrame:
    """Event references with place and participants found by their own labels."""
    placed = find(refs, ["source_id", "pos"], F.col("location_id"), F.col("location_label"), places)
    each = find(refs.select("source_id", "pos", F.posexplode("participant_labels").alias("k", "_label")), ["source_id", "pos", "k"], _none("string"), F.col("_label"), people)
    ids = each.where("e.id <> ''").groupBy("source_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("e.id").alias("i")))), lambda x: x["i"]).alias("_ids"))
    out, held = placed.join(ids, ["source_id", "pos"], "left"), F.col("e").isNotNull()
    given = F.filter(_list(F.col("participant_person_ids")), lambda x: F.coalesce(x, F.lit("")) != "")
    return out.withColumns({
        "event_time": event_time(F.col("event_time")),
        "location_label": F.when(held, or_null(F.col("e.name"))).otherwise(F.col("location_label")),
        "location_id": F.when(held, F.col("e.id")).otherwise(F.col("location_id")),
        "participant_labels": _list(F.col("participant_labels")),
        "participant_person_ids": participants(given, F.col("_ids")),
        "summary": F.coalesce("summary", F.lit("")),
        "page_refs": page_refs_of(F.col("page_refs")),
    })


def event_refs(refs: DataFrame, events: Pool, people: Pool, places: Pool) -> DataFrame:
    """References to events: those that name a known one show it, with their own quote and pages; others as described."""
    found = find(refs, ["source_id", "pos"], F.col("canonical_id"), F.col("label"), events)
    known = event_views(found.where("e is not null").select("source_id", "pos", "e.*"), people, places, True).drop("supporting_quote", "page_refs")
    known = known.join(refs.select("source_id", "pos", "supporting_quote", page_refs_of(F.col("page_refs")).alias("page_refs")), ["source_id", "pos"])
    other = described(found.where("e is null").drop("e"), people, places)
    both = known.select("source_id", "pos", *EVENT_FIELDS).unionByName(other.select("source_id", "pos", *EVENT_FIELDS))
    return both.where("label <> ''")


def document_event_refs(refs: DataFrame, people: Pool, places: Pool) -> DataFrame:
    kind = F.coalesce(or_null(F.col("event_kind")), document_event_kind(F.col("label"), F.col("summary")))
    return described(refs.withColumn("event_kind", kind), people, places).where("label <> ''").select("source_id", "pos", *DOCUMENT_EVENT_FIELDS)


def average_confidence(*arrays: Column) -> Column:
    """The mean of all confidences there are, to 3 places; null of none."""
    every = F.filter(F.concat(*(F.transform(a, lambda x: x["confidence"]) for a in arrays)), lambda x: x.isNotNull())
    return F.when(F.size(every) > 0, F.round(F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / F.size(every), 3))


def build(pages: DataFrame, briefings: DataFrame, claims: DataFrame, people: Pool, places: Pool, events: Pool) -> DataFrame:
    """(source_id, navigation) per page. pages: source_id, title, source_type, metadata; briefings: source_id, the scalars,
    and arrays of ENTITY_REF and EVENT_REF; claims: source_id. A source without a briefing, or with a part of one, shows its
    own entities, eight at most. Document events are told from others where the briefing doesn't."""
    raw, dated = _rows(briefings, "referenced_events"), _rows(briefings, "document_events")
    undecided = briefings.where(F.coalesce(F.size("document_events"), F.lit(0)) <= 0).select("source_id")
    mixed = raw.withColumn("_document", is_document_event(F.col("label"), F.col("summary"))).join(undecided.withColumn("_open", F.lit(True)), "source_id", "left")
    as_document = F.coalesce("_open", F.lit(False)) & F.col("_document")
    told = dated.unionByName(mixed.where(as_document).drop("_document", "_open"))

    def first_of(entities: DataFrame, label: list[str], role: Column) -> DataFrame:
        few = F.slice(F.array_sort(F.collect_list(F.struct("ordinal", "e"))), 1, FALLBACK_ENTITIES)
        rows = entities.groupBy("source_id").agg(few.alias("few")).select("source_id", F.posexplode("few").alias("pos", "x")).select("source_id", "pos", "x.e")
        out = rows.select("source_id", "pos", F.coalesce(*(or_null(F.col(f"e.{c}")) for c in label)).alias("label"), F.col("e.id").alias("canonical_id"), role.alias("role_or_relationship"), F.col("e.confidence").cast("double").alias("confidence"))
        return out.where("label <> ''")

    roles = or_null(F.array_join(F.slice(_list(F.col("e.roles")), 1, 2), ", "))
    few = F.slice(F.array_sort(F.collect_list(F.struct("ordinal", "e"))), 1, FALLBACK_ENTITIES)
    own_events = events.scoped.groupBy("source_id").agg(few.alias("few")).select("source_id", F.posexplode("few").alias("pos", "x")).select("source_id", "pos", "x.e.*")
    parts = {
        "primary_people": (entity_refs(_rows(briefings, "primary_people"), people, PERSON_LABELS), ENTITY_FIELDS),
        "own_people": (first_of(people.scoped, ["display_name", "id"], roles), ENTITY_FIELDS),
        "primary_locations": (entity_refs(_rows(briefings, "primary_locations"), places, LOCATION_LABELS), ENTITY_FIELDS),
        "own_locations": (first_of(places.scoped, ["name", "id"], F.col("e.location_type")), ENTITY_FIELDS),
        "referenced_events": (event_refs(mixed.where(~as_document).drop("_document", "_open"), events, people, places), EVENT_FIELDS),
        "own_events": (event_views(own_events, people, places, False), EVENT_FIELDS),
        "document_events": (document_event_refs(told, people, places), DOCUMENT_EVENT_FIELDS),
    }
    b = briefings.select("source_id", F.struct(*(c for c in briefings.columns if c not in ("source_id", "primary_people", "primary_locations", "referenced_events", "document_events"))).alias("b"))
    out = pages.select("source_id", "title", "source_type", "metadata").join(b, "source_id", "left").join(claims.groupBy("source_id").agg(F.count("*").alias("claims")), "source_id", "left")
    for name, (rows, fields) in parts.items():
        out = out.join(_gather(rows, fields, name), "source_id", "left")

    def full(name: str, other: str | None = None) -> Column:
        kind = out.schema[name].dataType
        return F.coalesce(name, *([F.col(other).cast(kind)] if other else []), F.array().cast(kind))

    out = out.withColumns({"primary_people": full("primary_people", "own_people"), "primary_locations": full("primary_locations", "own_locations"), "referenced_events": full("referenced_events", "own_events"), "document_events": full("document_events")})
    lists = [F.col(c) for c in ("primary_people", "primary_locations", "referenced_events", "document_events")]
    nav = F.struct(
        F.coalesce(or_null(F.col("b.brief_title")), "title").alias("brief_title"),
        F.coalesce(or_null(F.col("b.navigation_summary")), or_null(F.col("b.summary")), F.lit("")).alias("navigation_summary"),
        document_date(F.col("b.document_date"), F.col("metadata")).alias("document_date"),
        document_order(F.col("b.document_order"), F.col("metadata")).alias("document_order"),
        F.coalesce(or_null(F.col("b.document_role")), document_role(F.col("source_type"), F.col("title"))).alias("document_role"),
        F.array_sort(F.array_distinct(F.filter(F.transform(_list(F.col("b.topics")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))).alias("topics"),
        *lists,
        F.coalesce("claims", F.lit(0)).cast("long").alias("claim_count"),
        F.size("referenced_events").cast("long").alias("event_reference_count"),
        F.size("document_events").cast("long").alias("document_event_count"),
        average_confidence(*lists).alias("confidence"),
    )
    return out.select("source_id", nav.alias("navigation"))


def with_fallback(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """The catalogue: pages (source_id, title, source_type, metadata, ...) with the navigation of sources (source_id,
    navigation) where there is any, and what follows from the page itself where a field is missing. Unlike in building,
    the navigation's volume and pages come before the metadata's."""
    both = pages.join(sources.select("source_id", "navigation"), "source_id", "left")
    n, m = F.col("navigation"), F.col("metadata")
    kinds = {f.name: f.dataType for f in sources.schema["navigation"].dataType}
    pages_ = number_range(m["pages"])
    text = F.coalesce(or_null(n["document_date"]["original_text"]), m["date_text"])
    day = F.coalesce(or_null(n["document_date"]["normalized_date"]), parse_date(text))
    order = n["document_order"]
    witness = F.when(or_null(m["witness_name"]).isNotNull(), F.array(F.struct(m["witness_name"].alias("label"), _none("string").alias("canonical_id"), F.lit("witness").alias("role_or_relationship"), _none("double").alias("confidence"))))

    def filled(name: str, other: Column | None = None) -> Column:
        empty = F.array().cast(kinds[name])
        return F.coalesce(F.when(F.size(n[name]) > 0, n[name]), *([] if other is None else [other.cast(kinds[name])]), empty).alias(name)

    out = F.struct(
        F.coalesce(or_null(n["brief_title"]), "title").alias("brief_title"),
        F.coalesce(n["navigation_summary"], F.lit("")).alias("navigation_summary"),
        F.struct(text.alias("original_text"), day.alias("normalized_date"), F.coalesce(or_null(n["document_date"]["precision"]), F.when(day.isNotNull(), "day").otherwise("unknown")).alias("precision")).alias("document_date"),
        F.struct(F.coalesce(or_null(order["volume"]), m["volume"]).alias("volume"), F.coalesce(order["page_start"], pages_["start"]).alias("page_start"), F.coalesce(order["page_end"], pages_["end"]).alias("page_end"), F.coalesce(or_null(order["sequence_label"]), m["pages"]).alias("sequence_label")).alias("document_order"),
        F.coalesce(or_null(n["document_role"]), document_role(F.col("source_type"), F.col("title"))).alias("document_role"),
        filled("topics"),
        filled("primary_people", witness),
        filled("primary_locations"),
        filled("referenced_events"),
        filled("document_events"),
        F.coalesce(n["claim_count"], F.lit(0)).cast("long").alias("claim_count"),
        F.coalesce(F.nullif(n["event_reference_count"], F.lit(0)), F.when(F.size(n["referenced_events"]) > 0, F.size(n["referenced_events"])), F.lit(0)).cast("long").alias("event_reference_count"),
        n["confidence"].alias("confidence"),
    )
    return both.withColumn("navigation", out)
