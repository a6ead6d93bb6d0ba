"""Figures as claims: nested metrics flattened to named, formatted texts, and templates that
must not be left with a gap. Metrics are a handful of aggregates, so this runs on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

GAP = re.compile(r"\{\{\s*([\w.]+)\s*\}\}")


def flatten(metrics: Mapping, prefix: str = "") -> dict[str, object]:
    """Nested metrics by dotted name; members of lists by their place."""
    out: dict[str, object] = {}
    for k, v in metrics.items():
        name = f"{prefix}{k}"
        if isinstance(v, Mapping):
            out |= flatten(v, f"{name}.")
        elif isinstance(v, list | tuple):
            out |= flatten({str(i): x for i, x in enumerate(v)}, f"{name}.")
        else:
            out[name] = v
    return out


def written(value: object) -> str:
    """Counts with thousands apart, fractions to four digits, other values as they are."""
    if isinstance(value, bool) or value is None:
        return str(value).lower() if value is not None else "n/a"
    if isinstance(value, int):
        return f"{value:,}"
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def render(template: str, metrics: Mapping) -> str:
    """The template with its {{ names }} filled; an error that lists those without a value."""
    known = flatten(metrics)
    if lack := sorted({x for x in GAP.findall(template) if x not in known}):
        raise KeyError(f"no value for: {', '.join(lack)}")
    return GAP.sub(lambda m: written(known[m[1]]), template)


def of_row(df: DataFrame) -> dict[str, object]:
    """The metrics of a frame of one row."""
    return df.first().asDict(recursive=True)


def table(spark: SparkSession, metrics: Mapping) -> DataFrame:
    """name, text of every claim."""
    return spark.createDataFrame([(k, written(v)) for k, v in flatten(metrics).items()], "name string, text string")


def write_report(spark: SparkSession, metrics: Mapping, path: str) -> None:
    """The metrics as a JSON document, in whatever store the session can reach."""
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    """A JSON document of metrics, read back as an input."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one document
