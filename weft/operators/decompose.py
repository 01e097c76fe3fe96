"""Splitting a matrix by the density of windows into parts that suit different formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import kept
from ..tensor import SparseTensor


def window_parts(a: SparseTensor, thresholds: list[float], kind: str = "block", rows: int = 1, cols: int = 1) -> DataFrame:
    """(i, j, v, part): each entry with the number of the first threshold over its window's density (entries over places, relative to the densest window), else the last part.

    kind: block (rows x cols), row (rows x all columns) or column (all rows x cols). Windows at an edge count with full size.
    """
    keys: dict[str, Column] = {}
    if kind in ("block", "row"):
        keys["_wi"] = F.floor(F.col("i") / rows)
    if kind in ("block", "column"):
        keys["_wj"] = F.floor(F.col("j") / cols)
    if not keys:
        raise ValueError(f"windows of kind {kind!r} aren't supported (block, row, column)")
    d = a.df.withColumns(keys)
    count = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    # all windows have one size, so relative density is relative count
    most = count.agg(F.max("_n").alias("_most"))
    share = count.crossJoin(F.broadcast(most)).withColumn("_d", F.col("_n") / F.col("_most"))
    part = F.lit(len(thresholds))
    for k in reversed(range(len(thresholds))):
        part = F.when(F.col("_d") < thresholds[k], k).otherwise(part)
    share = share.select(*keys, part.cast("int").alias("part"))
    return d.join(share, list(keys)).select("i", "j", "v", "part")


def decompose(a: SparseTensor, thresholds: list[float], kind: str = "block", rows: int = 1, cols: int = 1) -> list[SparseTensor]:
    """The k + 1 parts of a matrix for k ascending thresholds. Entries are marked with their part once, in the shared folder, and not again for each part and array."""
    if sorted(thresholds) != list(thresholds):
        raise ValueError("thresholds must ascend")
    d = kept(window_parts(a, thresholds, kind, rows, cols), "parts")
    return [SparseTensor(d.where(F.col("part") == k).select("i", "j", "v"), a.shape) for k in range(len(thresholds) + 1)]


def decompose_bdia(a: SparseTensor, block: int, threshold: float) -> list[SparseTensor]:
    """[dense diagonals of row blocks, rest]: a diagonal of a block of rows goes to the first part if at least `threshold` of its `block` places hold entries."""
    d = a.df.withColumn("_b", F.floor(F.col("i") / block)).withColumn("_d", F.col("j") - F.col("i"))
    full = d.groupBy("_b", "_d").agg((F.countDistinct("i") / block).alias("_f"))
    d = d.join(full, ["_b", "_d"])
    cut = lambda c: SparseTensor(d.where(c).select("i", "j", "v"), a.shape)
    return [cut(F.col("_f") >= threshold), cut(F.col("_f") < threshold)]


def decompose_bell(a: SparseTensor, block: int, block_threshold: float, col_threshold: float) -> list[SparseTensor]:
    """[block ELL, rest]: a block goes to the first part if at least block_threshold of its places hold entries and its block row keeps at most
    col_threshold of all block columns (the leftmost ones)."""
    from .indirect import enumerate_slots

    d = a.df.withColumn("_r", F.floor(F.col("i") / block)).withColumn("_c", F.floor(F.col("j") / block))
    good = d.select("_r", "_c", "i", "j").distinct().groupBy("_r", "_c").agg((F.count("*") / (block * block)).alias("_f")).where(F.col("_f") >= block_threshold)
    slots = enumerate_slots(good.select(F.col("_r").alias("i"), F.col("_c").alias("j"), F.col("_f").alias("v")))
    limit = int(col_threshold * -(-a.shape[1] // block))
    keep = slots.where(F.col("slot") < limit).select(F.col("i").alias("_r"), F.col("j").alias("_c"))
    one, two = d.join(keep, ["_r", "_c"], "left_semi"), d.join(keep, ["_r", "_c"], "left_anti")
    return [SparseTensor(x.select("i", "j", "v"), a.shape) for x in (one, two)]
