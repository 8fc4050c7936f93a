"""Stages that call an external service: the client is injected, rows never raise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "output string, status string, error string, attempts int, input_tokens long, output_tokens long"


def call(requests: DataFrame, key: str, prompt: str, client: Callable[[str], dict], attempts: int = 2) -> DataFrame:
    """key and OUT per request. client(prompt) returns {output, input_tokens, output_tokens} or raises; failures are rows
    with status error, retries sum their usage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[prompt], strict=True):
                row = {key: k, "output": None, "status": "error", "error": None, "attempts": 0, "input_tokens": 0, "output_tokens": 0}
                while row["status"] == "error" and row["attempts"] < attempts:
                    row["attempts"] += 1
                    try:
                        got = client(text)
                        row |= {"output": got.get("output"), "status": "success", "error": None}
                        usage = got
                    except Exception as e:  # a service's failure is this row's result
                        row["error"], usage = f"{type(e).__name__}: {e}", getattr(e, "usage", {})
                    for c in ("input_tokens", "output_tokens"):
                        row[c] += int(usage.get(c, 0))
                rows.append(row)
            yield pd.DataFrame(rows, columns=[key, *(x.split()[0] for x in OUT.split(", "))])

    return requests.select(key, prompt).mapInPandas(run, f"{key} {requests.schema[key].dataType.simpleString()}, {OUT}")


def resume(requests: DataFrame, audits: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(reused audits, requests still to make): a successful audit with an output is reused."""
    good = audits.where((F.col("status") == "success") & (F.coalesce("output", F.lit("")) != ""))
    return requests.select(key).join(good, key), requests.join(good, key, "left_anti")
