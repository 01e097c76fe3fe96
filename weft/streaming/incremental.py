"""Products kept up to date while entries arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_spmv(entries: DataFrame, b: DataFrame) -> DataFrame:
    """(i, x) of a stream of entries (i, j, v) times a fixed vector (j, b); run it with output mode `update` or `complete`.

    An entry that is sent again is one more addend, so a changed value is sent as its difference. State is one sum a row.
    """
    return entries.join(b.select("j", "b"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("b")).alias("x"))
