"""Queries kept as SQL text in files, each under a line '-- name: NAME'; the same text is
run by Spark here and by another engine as its check."""

from __future__ import annotations

import os
import re

from ..operators.keys import same_rows
from .registry import QUERIES, SQL, Tables, query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def named(path: str) -> dict[str, str]:
    with open(path, encoding="utf-8") as f:
        parts = re.split(r"^-- name: (\w+)\s*$", f.read(), flags=re.M)[1:]
    return {name: sql.strip() for name, sql in zip(parts[::2], parts[1::2], strict=True)}


def run(spark, folder: str, sql: str):
    """The statement over the folder's tables, which are bound to it and named in no catalogue;
    columns of decimal sums as numbers."""
    t = Tables(spark, folder)
    used = [name for name in TABLES if re.search(rf"\b(?:FROM|JOIN) {name}\b", sql)]
    bound = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", sql)
    df = spark.sql(bound, **{name: getattr(t, name) for name in used})
    return df.withColumns({c: df[c].cast("double") for c, k in df.dtypes if k.startswith("decimal")})


for _name, _sql in named(os.path.join(os.path.dirname(__file__), "crosscheck.sql")).items():
    QUERIES[_name] = lambda spark, folder, _sql=_sql: run(spark, folder, _sql)
    SQL[_name] = _sql


@query("SELECT 'several types' AS check, true AS same UNION ALL SELECT 'mean by group', true")
def sql_against_frames(t: Tables):
    """The same questions through SQL text and through the DataFrame API, row by row."""
    from pyspark.sql import functions as F

    a = run(t.spark, t.folder, SQL["sql_several_types"])
    b = QUERIES["multi_value_entities"](t.spark, t.folder)
    c = run(t.spark, t.folder, SQL["sql_mean_by_group"])
    d = t.events.groupBy("event_type").agg(F.count("value").alias("known"), F.round(F.avg("value"), 6).alias("mean"))
    return t.spark.createDataFrame([("several types", same_rows(a, b)), ("mean by group", same_rows(c, d))], "check string, same boolean")
