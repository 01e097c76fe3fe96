"""What a physical plan does, for tests and for looking before running."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def plan_nodes(df: DataFrame) -> Counter:
    """Operators of the physical plan with their numbers, as Spark would start it."""
    text = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    return Counter(re.findall(r"^[\s:+*|-]*(?:\(\d+\)\s*)?([A-Z]\w+)", text, re.M))


def reads_columns(df: DataFrame) -> list[str]:
    """ReadSchema of each file scan."""
    return re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().executedPlan().toString())  # noqa: SLF001
