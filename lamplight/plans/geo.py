"""Places on the map: modern addresses and coordinates from two external services, whose clients are injected."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions.scores import geocode_confidence
from lamplight.functions.text import or_null
from lamplight.operators.resolve import first_wins
from lamplight.plans.stages import call

# Fixed values.
METHOD, PROVIDER = "google_maps_geocoding", "google_maps"
SKIPPED = "skipped_existing_google_coordinates"
COORDINATES = "struct<lat: double, lng: double, confidence: double, method: string, provider: string, place_id: string, raw_response_id: string>"
GEOCODING = "struct<status: string, query: string, formatted_address: string, location_type: string, llm_call_id: string, google_response_id: string, error: string>"
RECORD = "struct<status: string, llm_status: string, google_status: string, cost_usd: double, error: string>"
NO_QUERY = "LLM did not produce a modern geocoding query"


def has_coordinates(c: Column) -> Column:
    return F.coalesce(c["lat"].isNotNull() & c["lng"].isNotNull() & (c["method"] == METHOD), F.lit(False))


def address_prompt(fields: list[str]) -> Column:
    """A request for the modern address of a place, as JSON of what is known of it."""
    return F.concat(F.lit("Give the modern address of this place as JSON with modern_query, modern_address, confidence: "), F.to_json(F.struct(*fields)))


def apply(df: DataFrame) -> DataFrame:
    """Locations under what the services said of them: columns _m (modern_query, modern_address, confidence), _answer (the
    geocoder's JSON), _ok, _query, _error and the two calls' ids."""
    base = "$.results[0]"
    point = lambda k: F.get_json_object("_answer", f"{base}.geometry.location.{k}").try_cast("double")
    kind, address = F.get_json_object("_answer", f"{base}.geometry.location_type"), F.get_json_object("_answer", f"{base}.formatted_address")
    found = F.struct(point("lat").alias("lat"), point("lng").alias("lng"), geocode_confidence(kind, F.col("_m.confidence")).alias("confidence"), F.lit(METHOD).alias("method"), F.lit(PROVIDER).alias("provider"), F.get_json_object("_answer", f"{base}.place_id").alias("place_id"), F.col("_google_id").alias("raw_response_id"))
    null = F.lit(None).cast("string")
    good = F.struct(F.lit("success").alias("status"), F.col("_query").alias("query"), address.alias("formatted_address"), kind.alias("location_type"), F.col("_llm_id").alias("llm_call_id"), F.col("_google_id").alias("google_response_id"), null.alias("error"))
    bad = F.struct(F.lit("error").alias("status"), null.alias("query"), null.alias("formatted_address"), null.alias("location_type"), F.col("_llm_id").alias("llm_call_id"), F.col("_google_id").alias("google_response_id"), F.col("_error").alias("error"))
    modern = F.coalesce(F.when(F.col("_ok"), or_null(address)), or_null(F.col("_m.modern_address")), "modern_address")
    return df.withColumns({"coordinates": F.when(F.col("_ok"), found).otherwise(F.col("coordinates").cast(COORDINATES)), "geocoding": F.when(F.col("_ok"), good).otherwise(bad).cast(GEOCODING), "modern_address": modern})


def geolocate(locations: DataFrame, modernize: Callable[[str], dict], geocode: Callable[[str], str], order: str, price: Callable[[Column, Column], Column] | None = None, known: list[str] | None = None, force: bool = False) -> DataFrame:
    """Locations (id, modern_address, coordinates, order, ...), one per id, with geocoding and record.

    modernize(prompt) returns {output: JSON of modern_query, modern_address, confidence; input_tokens; output_tokens};
    geocode(query) returns the geocoder's JSON. Either may raise: that is the location's record. Places that have coordinates
    from this geocoder are left as they are, unless force. Services are called once a row and evaluation: save the result
    before using it twice.
    """
    each = first_wins(locations.where("id is not null"), ["id"], [order])
    each = each.withColumn("coordinates", _shaped(each))
    wanted = F.lit(True) if force else ~has_coordinates(F.col("coordinates"))
    todo, kept = each.where(wanted), each.where(~wanted)
    fields = known or [c for c in ("id", "name", "address_1886", "address_1887", "location_type") if c in each.columns]
    asked = call(todo.withColumn("_prompt", address_prompt(fields)), "id", "_prompt", modernize, attempts=1)
    cost = price(F.col("input_tokens"), F.col("output_tokens")) if price else F.lit(0.0)
    asked = asked.select("id", F.when(F.col("status") == "success", F.from_json("output", "modern_query string, modern_address string, confidence double")).alias("_m"), F.col("status").alias("_llm_status"), F.col("error").alias("_llm_error"), cost.alias("_cost"))
    asked = asked.withColumn("_query", F.coalesce(or_null(F.col("_m.modern_query")), or_null(F.col("_m.modern_address"))))

    def answer(query: str) -> dict:
        if not query:
            raise ValueError(NO_QUERY)
        text = geocode(query)
        got = json.loads(text)
        if got.get("status") != "OK" or not got.get("results"):
            raise ValueError(got.get("error_message") or got.get("status") or text)
        return {"output": text}

    found = call(asked, "id", "_query", answer, attempts=1)
    reason = F.regexp_replace("error", "^[A-Za-z]+: ", "")
    found = found.select("id", F.col("output").alias("_answer"), (F.col("status") == "success").alias("_ok"), reason.alias("_error"))
    ids = {"_llm_id": F.concat("id", F.lit("_modern_address")), "_google_id": F.concat("id", F.lit("_google_geocode"))}
    done = apply(todo.join(asked, "id").join(found, "id").withColumns(ids))
    status = F.when(F.col("_ok"), "success").otherwise("error")
    record = F.struct(status.alias("status"), F.col("_llm_status").alias("llm_status"), status.alias("google_status"), F.col("_cost").alias("cost_usd"), F.coalesce("_error", "_llm_error").alias("error"))
    skipped = F.struct(F.lit(SKIPPED).alias("status"), F.lit(None).cast("string").alias("llm_status"), F.lit(None).cast("string").alias("google_status"), F.lit(0.0).alias("cost_usd"), F.lit(None).cast("string").alias("error"))
    old = F.col("geocoding").cast(GEOCODING) if "geocoding" in each.columns else F.lit(None).cast(GEOCODING)
    columns = [c for c in each.columns if c != "geocoding"]
    return done.select(*columns, "geocoding", record.cast(RECORD).alias("record")).unionByName(kept.select(*columns, old.alias("geocoding"), skipped.cast(RECORD).alias("record")))


def _shaped(df: DataFrame) -> Column:
    """The coordinates' struct with all its fields, those it lacks null."""
    kind = df.schema["coordinates"].dataType
    held = {f.name for f in kind}
    fields = [x.strip().split(": ") for x in COORDINATES.removeprefix("struct<").removesuffix(">").split(",")]
    return F.struct(*((F.col(f"coordinates.{n}") if n in held else F.lit(None)).cast(t).alias(n) for n, t in fields))


def summary(records: DataFrame) -> DataFrame:
    """One row: locations, successes, errors, skipped and cost of records (a column record)."""
    s = F.col("record.status")
    return records.agg(F.count("*").alias("locations"), F.count_if(s == "success").alias("successes"), F.count_if(s == "error").alias("errors"), F.count_if(s.startswith("skipped")).alias("skipped"), F.round(F.coalesce(F.sum("record.cost_usd"), F.lit(0.0)), 8).alias("cost_usd"))
