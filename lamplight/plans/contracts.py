"""Contracts of external services' answers as JSON schemas: what a strict service takes, and columns that follow it."""

from __future__ import annotations

import copy
import json
from pathlib import Path

# Keywords that strict services refuse.
REFUSED = ["$schema", "$id", "default", "examples", "format", "maximum", "maxItems", "maxLength", "minimum", "minItems", "minLength", "multipleOf", "pattern", "title", "uniqueItems"]


def load(folder: str, name: str, parts: dict[str, str] | None = None) -> dict:
    """A schema by file name; parts puts other files at places in it (`properties.x` steps, as "people.items")."""
    schema = json.loads((Path(folder) / name).read_text(encoding="utf-8"))
    for place, other in (parts or {}).items():
        *steps, last = place.split(".")
        at = schema
        for step in steps:
            at = at["items"] if step == "items" else at["properties"][step]
        (at if last == "items" else at["properties"])[last] = json.loads((Path(folder) / other).read_text(encoding="utf-8"))
    return schema


def strict(schema: dict) -> dict:
    """A copy that a strict service takes: without refused keywords and optional properties, everything else required."""
    out = {k: copy.deepcopy(v) for k, v in schema.items() if k not in REFUSED}
    if isinstance(out.get("properties"), dict):
        wanted = schema.get("required", list(out["properties"]))
        out["properties"] = {k: strict(v) for k, v in out["properties"].items() if k in wanted}
        out |= {"additionalProperties": False, "required": list(out["properties"])}
    for key in ("items", "additionalProperties"):
        if isinstance(out.get(key), dict):
            out[key] = strict(out[key])
    for key in ("anyOf", "oneOf", "allOf"):
        if key in out:
            out[key] = [strict(x) for x in out[key]]
    return out


def ddl(schema: dict) -> str:
    """The Spark type of what a schema describes; what it leaves open is a variant."""
    kinds = schema.get("type")
    kind = next((k for k in ([kinds] if isinstance(kinds, str) else kinds or []) if k != "null"), None)
    if kind == "object" and schema.get("properties"):
        return "struct<" + ", ".join(f"`{k}`: {ddl(v)}" for k, v in schema["properties"].items()) + ">"
    if kind == "array":
        return f"array<{ddl(schema.get('items', {}))}>"
    return {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}.get(kind, "variant")
