"""Named counters as a side result of a DataFrame that is computed anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, group: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df, and an Observation of how many of its rows fulfil each condition; its values come with df's first action."""
    seen = Observation(group)
    return df.observe(seen, *[F.count_if(c).alias(n) for n, c in counters.items()]), seen
