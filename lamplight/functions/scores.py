"""Measures: text fidelity, costs, confidences."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lamplight.functions.text import MARKER_LINE, lines

# Fixed values.
RATIO_BAR, RECALL_BAR = 0.92, 0.95
GEOCODE_BASE = {"ROOFTOP": 0.95, "RANGE_INTERPOLATED": 0.8, "GEOMETRIC_CENTER": 0.7, "APPROXIMATE": 0.55}
GEOCODE_OTHER = 0.5
#: US dollars per million tokens in and out, by model.
PRICES = {
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "gpt-4.1-nano": (0.10, 0.40),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1": (2.00, 8.00),
    "gpt-5-nano": (0.05, 0.40),
    "gpt-5-mini": (0.25, 2.00),
    "gpt-5": (1.25, 10.00),
    "gpt-5-pro": (15.00, 120.00),
    "gpt-5.1": (1.25, 10.00),
    "gpt-5.2": (1.75, 14.00),
    "gpt-5.4-nano": (0.20, 1.25),
    "gpt-5.4-mini": (0.75, 4.50),
    "gpt-5.4": (2.50, 15.00),
    "gpt-5.4-pro": (30.00, 180.00),
    "gpt-5.5": (5.00, 30.00),
    "gpt-5.5-pro": (30.00, 180.00),
    "o3-mini": (1.10, 4.40),
    "o4-mini": (1.10, 4.40),
    "o3": (2.00, 8.00),
}
WORD = r"[\p{L}\p{N}_]+"


def comparable(text: Column) -> Column:
    """A text for comparison: no page markers, single blanks, lower case."""
    return F.lower(F.array_join(F.filter(lines(text), lambda x: ~x.rlike(MARKER_LINE)), " "))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0))


def token_recall(expected: Column, actual: Column) -> Column:
    """The share of the distinct words of expected that actual has; 1 if there is none."""
    pair = F.struct(tokens(expected).alias("e"), tokens(actual).alias("a"))  # an array of one, so that each side is split once
    return F.get(F.transform(F.array(pair), lambda p: F.when(F.size(p["e"]) == 0, 1.0).otherwise(F.size(F.array_intersect(p["e"], p["a"])) / F.size(p["e"]))), 0)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks of two texts; of nulls, as of empty texts."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def verdicts(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """df with recall, ratio and valid: invalid only if both bars are missed, so the slow ratio is asked for after recall fails.
    Step by step, so that no text is prepared twice."""
    out = df.withColumns({"_a": comparable(F.col(expected)), "_b": comparable(F.col(actual))})
    out = out.withColumn("recall", token_recall(F.col("_a"), F.col("_b")))
    asked = F.col("recall") < RECALL_BAR
    out = out.withColumn("ratio", F.when(asked, similarity(F.when(asked, F.col("_a")), F.when(asked, F.col("_b")))))
    return out.withColumn("valid", (F.col("recall") >= RECALL_BAR) | (F.col("ratio") >= RATIO_BAR)).drop("_a", "_b")


def estimate_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens, ...) with cost_usd by prices (model, input_per_m, output_per_m); 0 if unknown."""
    cost = (F.col("input_tokens") * F.col("input_per_m") + F.col("output_tokens") * F.col("output_per_m")) / 1e6
    return usage.join(F.broadcast(prices), "model", "left").withColumn("cost_usd", F.coalesce(F.round(cost, 8), F.lit(0.0))).drop("input_per_m", "output_per_m")


def list_price(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """US dollars by PRICES; 0 for a model that isn't listed."""
    rate = lambda i: F.coalesce(*(F.when(model == m, p[i]) for m, p in PRICES.items()), F.lit(0.0))
    return input_tokens / 1e6 * rate(0) + output_tokens / 1e6 * rate(1)


def geocode_confidence(kind: Column, model: Column) -> Column:
    """The lesser of what the kind of place allows and the model's confidence; 0 or null of the model leaves the first."""
    base = F.coalesce(*(F.when(kind == k, v) for k, v in GEOCODE_BASE.items()), F.lit(GEOCODE_OTHER))
    return F.round(F.least(base, F.coalesce(F.nullif(model, F.lit(0.0)), base)), 2)


def colour(identifier: Column, palette: int = 8) -> Column:
    """A palette index: the sum of the characters' codes."""
    return F.aggregate(F.split(identifier, ""), F.lit(0), lambda a, c: (a + F.ascii(c)) % palette)
