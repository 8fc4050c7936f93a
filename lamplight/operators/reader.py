"""What a reader asks of published sources: filters, facets, timelines, details, maps. Sources are (source_id, place, title,
source_type, url, metadata, navigation), place their order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions.text import normalize_label, or_null
from lamplight.operators.timeline import date_range, haystack

UNDATED_SOURCE, UNDATED_EVENT = "Unknown Date", "Undated Events"


@dataclass(frozen=True)
class Filters:
    """What is asked for; None asks for nothing."""

    query: str | None = None
    source_type: str | None = None
    person: str | None = None
    location: str | None = None
    event: str | None = None
    topic: str | None = None
    start: str | None = None
    end: str | None = None


def pages_matching(pages: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """Pages whose id contains any token; ValueError if there is none."""
    any_ = F.lit(False)
    for t in tokens:
        any_ |= F.col(key).contains(t)
    out = pages.where(any_)
    if out.isEmpty():
        raise ValueError(f"no page matches {tokens}")
    return out


def without_contents(pages: DataFrame) -> DataFrame:
    """Pages but tables of contents; a page without a type stays."""
    return pages.where(~F.col("source_type").eqNullSafe("toc"))


def has_entity(items: Column, value: str) -> Column:
    return F.coalesce(F.exists(items, lambda x: x["canonical_id"].eqNullSafe(value) | x["label"].eqNullSafe(value)), F.lit(False))


def _day(time: Column) -> Column:
    return F.substring(F.coalesce(or_null(time["start"]), F.lit("undated")), 1, 10)


def event_key(ref: Column) -> Column:
    """An event's id, or its day, label and place."""
    return F.coalesce(or_null(ref["canonical_id"]), F.concat_ws("|", _day(ref["event_time"]), normalize_label(ref["label"]), normalize_label(ref["location_label"])))


def document_event_key(ref: Column) -> Column:
    return F.concat_ws("|", _day(ref["event_time"]), *(normalize_label(ref[c]) for c in ("event_kind", "label", "location_label")))


def is_event(ref: Column, value: str) -> Column:
    return ref["canonical_id"].eqNullSafe(value) | ref["label"].eqNullSafe(value) | (event_key(ref) == value)


def source_matches(f: Filters, dates: bool = True) -> Column:
    """Whether a source passes every filter that is set; its date only with dates. Undated sources pass no date filter."""
    n = F.col("navigation")
    out = F.lit(True)
    if f.query:
        lists = ("primary_people", "primary_locations", "referenced_events", "document_events")
        labels = F.concat(*(F.coalesce(F.transform(n[c], lambda x: x["label"]), F.array().cast("array<string>")) for c in lists))
        text = haystack(F.col("title"), F.col("source_type"), F.col("url"), n["brief_title"], n["navigation_summary"], F.array_join(n["topics"], " "), F.array_join(labels, " "))
        out &= text.contains(f.query.lower())
    if f.source_type:
        out &= F.col("source_type") == f.source_type
    if f.person:
        out &= has_entity(n["primary_people"], f.person)
    if f.location:
        out &= has_entity(n["primary_locations"], f.location)
    if f.event:
        out &= F.coalesce(F.exists(n["referenced_events"], lambda x: is_event(x, f.event)), F.lit(False))
    if f.topic:
        out &= F.coalesce(F.array_contains(n["topics"], f.topic), F.lit(False))
    return out & date_range(n["document_date"]["normalized_date"], f.start, f.end) if dates else out


def sources(df: DataFrame, f: Filters) -> DataFrame:
    return df.where(source_matches(f))


def timeline(df: DataFrame, f: Filters, documents: bool = False) -> DataFrame:
    """(key, ref, sources, place) of the events that matching sources refer to, or of document events: the first reference
    stands for its event, sources list the event's in order, place is the event's by date (undated last) and label.

    Dates here are the events': a source's own date doesn't count.
    """
    column = "document_events" if documents else "referenced_events"
    refs = df.where(source_matches(f, dates=False)).select("source_id", "place", F.posexplode(f"navigation.{column}").alias("pos", "ref"))
    if f.event and not documents:
        refs = refs.where(is_event(F.col("ref"), f.event))
    start = or_null(F.substring(F.col("ref.event_time.start"), 1, 10))
    refs = refs.where(date_range(start, f.start, f.end)).withColumn("key", document_event_key(F.col("ref")) if documents else event_key(F.col("ref")))
    at = F.struct("place", "pos")
    groups = refs.groupBy("key").agg(F.min_by("ref", at).alias("ref"), F.transform(F.array_sort(F.collect_list(F.struct("place", "pos", "source_id"))), lambda x: x["source_id"]).alias("sources"))
    day = or_null(F.substring(F.col("ref.event_time.start"), 1, 10))
    return groups.withColumns({"day": day, "group": F.coalesce(day, F.lit(UNDATED_EVENT))})


def timeline_order() -> list[Column]:
    return [F.col("day").asc_nulls_last(), F.collate(F.col("ref.label"), "UNICODE")]


def source_groups(df: DataFrame) -> DataFrame:
    """Sources with the group they are shown in: their day."""
    return df.withColumn("group", F.coalesce(or_null(F.col("navigation.document_date.normalized_date")), F.lit(UNDATED_SOURCE)))


def first_chips(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def confidence_label(c: Column) -> Column:
    """A confidence in percent; none if there is none."""
    return F.when(c.isNotNull(), F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("% confidence")))


def source_line(nav: Column, metadata: Column) -> Column:
    """Date, witness, volume and pages of a source, those there are."""
    order, dated = nav["document_order"], nav["document_date"]
    return F.concat_ws(" · ", F.coalesce(or_null(dated["normalized_date"]), or_null(dated["original_text"]), F.lit("Unknown date")), or_null(metadata["witness_name"]), F.concat(F.lit("Vol. "), or_null(order["volume"])), F.concat(F.lit("pp. "), or_null(order["sequence_label"])))


def event_line(ref: Column) -> Column:
    time = ref["event_time"]
    return F.concat_ws(" · ", F.coalesce(or_null(F.substring(time["start"], 1, 10)), or_null(time["original_text"]), F.lit("Undated")), or_null(ref["location_label"]), confidence_label(ref["confidence"]))


def page_jump(segments: DataFrame, key: str, page: str) -> DataFrame:
    """(key, index) of the first segment of each document on a page."""
    return segments.where(F.col("page_ref") == page).groupBy(key).agg(F.min("index").alias("index"))


def by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key; source ids must look like ones."""
    if not value.startswith("source_"):
        raise ValueError(f"{value!r} is no source id")
    return df.where(F.col(key) == value).limit(1)


def of_kind(mentions: DataFrame, kind: str | None) -> DataFrame:
    return mentions.where(F.col("kind") == kind) if kind else mentions


def mapped_events(events: DataFrame, locations: DataFrame) -> DataFrame:
    """Events at places with both coordinates: lat, lng, and the first participant as primary_person."""
    at = locations.where("coordinates.lat is not null and coordinates.lng is not null").groupBy(F.col("id").alias("location_id")).agg(F.max_by(F.struct(F.col("name").alias("location_name"), "coordinates.lat", "coordinates.lng"), "ordinal").alias("_at"))
    return events.join(at, "location_id").select(*events.columns, "_at.*", F.get("participant_person_ids", 0).alias("primary_person"))


def bounds(mapped: DataFrame) -> DataFrame:
    return mapped.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))


def person_pills(events: DataFrame, people: DataFrame) -> DataFrame:
    """(id, pills): participants' names in order; an unknown one shows as the id. Of people with one id, the last counts."""
    names = people.where("id is not null").groupBy(F.col("id").alias("_who")).agg(F.max_by("display_name", "ordinal").alias("_name"))
    each = events.select("id", F.posexplode("participant_person_ids").alias("k", "_who")).join(names, "_who", "left")
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("_name", "_who").alias("n")))), lambda x: x["n"]).alias("pills"))


def claim_details(claims: DataFrame, people: DataFrame, sources_: DataFrame) -> DataFrame:
    """Claims with reporter (name, else id, else unknown) and source (id, url): their own, else by source_id."""
    names = people.where("id is not null").groupBy(F.col("id").alias("reported_by_person_id")).agg(F.max_by("display_name", "ordinal").alias("_name"))
    known = sources_.select("source_id", F.struct(F.col("source_id").alias("id"), "url").alias("_source"))
    out = claims.join(names, "reported_by_person_id", "left").join(known, "source_id", "left")
    own = F.when(F.col("source").isNotNull(), F.struct(F.col("source.id").alias("id"), F.col("source.url").alias("url")))
    return out.withColumns({"reporter": F.coalesce("_name", or_null(F.col("reported_by_person_id")), F.lit("unknown")), "source": F.coalesce(own, "_source")}).drop("_name", "_source")


def in_document_order(audit: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Audit rows (key, unit_id) with the place of their unit (key, unit_id, unit_index); units that are unknown come last."""
    out = audit.join(units.select(key, "unit_id", "unit_index"), [key, "unit_id"], "left")
    w = Window.partitionBy(key).orderBy(F.col("unit_index").asc_nulls_last(), "unit_id")
    return out.withColumn("place", F.row_number().over(w) - 1).drop("unit_index")
