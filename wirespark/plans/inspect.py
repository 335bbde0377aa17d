"""What a physical plan does, for tests that guard it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df: DataFrame) -> int:
    return len(re.findall(r"\bExchange (?:hash|range|RoundRobin|Single)", text(df)))


def read_columns(df: DataFrame) -> set[str]:
    return {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<(.*?)>(?:\s|$)", text(df)) for c in re.split(r",(?![^<]*>)", s) if c}


def pushed_filters(df: DataFrame) -> list[str]:
    return [f for s in re.findall(r"PushedFilters: \[(.*?)\](?:,|\s|$)", text(df)) for f in re.split(r", (?=[A-Z])", s) if f]


def python_nodes(df: DataFrame) -> list[str]:
    return re.findall(r"\b(\w*(?:Python|Pandas|Arrow)\w*)\b", text(df))
