"""The steps that formats are made of, as functions from DataFrame to DataFrame on level columns l0, l1, ... and v."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dense import dense
from .indirect import enumerate_slots, pack, partition, reorder, schedule, sums, unpack  # noqa: F401


def _levels(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[0] == "l" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def swap(df: DataFrame, a: int, b: int) -> DataFrame:
    """Exchange two levels."""
    return df.withColumns({f"l{a}": F.col(f"l{b}"), f"l{b}": F.col(f"l{a}")})


def add(df: DataFrame, target: int, source: int) -> DataFrame:
    return df.withColumn(f"l{target}", F.col(f"l{target}") + F.col(f"l{source}"))


def sub(df: DataFrame, target: int, source: int) -> DataFrame:
    return df.withColumn(f"l{target}", F.col(f"l{target}") - F.col(f"l{source}"))


def neg(df: DataFrame, level: int) -> DataFrame:
    return df.withColumn(f"l{level}", -F.col(f"l{level}"))


def tile_split(df: DataFrame, level: int, by: int) -> DataFrame:
    """Level -> quotient and, as a new level after it, rest (floor, so negative coordinates are right too)."""
    out, shift = [], 0
    for k, c in enumerate(_levels(df)):
        if k == level:
            out += [F.floor(F.col(c) / by).cast("long").alias(f"l{k}"), F.pmod(F.col(c), F.lit(by)).cast("long").alias(f"l{k + 1}")]
            shift = 1
        else:
            out.append(F.col(c).alias(f"l{k + shift}"))
    return df.select(*out, "v")


def tile_merge(df: DataFrame, level: int, by: int) -> DataFrame:
    """Level and the one after it -> level * by + rest."""
    out = []
    for k, c in enumerate(_levels(df)):
        if k == level:
            out.append((F.col(c) * by + F.col(f"l{k + 1}")).alias(c))
        elif k != level + 1:
            out.append(F.col(c).alias(f"l{k - (k > level)}"))
    return df.select(*out, "v")


def move(df: DataFrame, source: int, target: int) -> DataFrame:
    """Take a level to an earlier place. Order is not stored in a DataFrame; it follows from the level order wherever positions are asked for."""
    order = _levels(df)
    order.insert(target, order.pop(source))
    return df.select(*[F.col(c).alias(f"l{k}") for k, c in enumerate(order)], "v")


def fuse(df: DataFrame, level: int) -> DataFrame:
    """(l0..level, n): distinct prefixes with the number of entries below."""
    return df.groupBy(*_levels(df)[: level + 1]).agg(F.count("*").alias("n"))


def separate(prefixes: DataFrame, df: DataFrame, level: int) -> DataFrame:
    """Entries again, each with its prefix: the inverse of fuse."""
    return df.join(prefixes.drop("n"), [f"l{k}" for k in range(level + 1)])


def trim(counts: DataFrame) -> DataFrame:
    """Drop empty positions of a dense level."""
    return counts.where("n > 0")


def grow(prefixes: DataFrame, size: int, level: int = 0) -> DataFrame:
    """A stored level as a dense one: every position, empty ones with 0."""
    c = f"l{level}"
    every = prefixes.sparkSession.range(size).select(F.col("id").alias(c))
    return every.join(prefixes, c, "left").select(c, F.coalesce("n", F.lit(0)).alias("n"))


def vectorize(df: DataFrame, level: int, size: int) -> DataFrame:
    """(l0.., block): one dense block of `size` places along `level` for each prefix; duplicates are summed."""
    keys = _levels(df)[:level]
    laid = df.repartition(*keys) if keys else df  # one shuffle for the sums and the blocks
    cells = laid.groupBy(*keys, f"l{level}").agg(F.sum("v").alias("v"))
    return dense(cells, keys, f"l{level}", size, {"block": "v"})


def devectorize(blocks: DataFrame, level: int) -> DataFrame:
    """Blocks as coordinates again; stored zeros are lost."""
    keys = [c for c in blocks.columns if c != "block"]
    return blocks.select(*keys, F.posexplode("block").alias(f"l{level}", "v")).withColumn(f"l{level}", F.col(f"l{level}").cast("long")).where("v <> 0")


def pad(df: DataFrame, level: int, size: int) -> DataFrame:
    """Explicit zeros at every empty position of `level` under each prefix of the levels before it."""
    keys = _levels(df)[:level]
    grid = df.select(*keys).distinct().withColumn(f"l{level}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    return grid.join(df, [*keys, f"l{level}"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
