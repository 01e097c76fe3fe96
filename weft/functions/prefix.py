"""Running sums and positions in a sort order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

#: Keys in a block of a two-step running sum.
BLOCK = 1 << 16
#: Blocks of a dense running sum in one task, as long as MOST_TASKS suffice.
BLOCKS_A_TASK, MOST_TASKS = 16, 4096


def running(df: DataFrame, key: str, value: str, name: str, bound: int | None = None) -> DataFrame:
    """Add `name`: the sum of value over all smaller keys (key: unique whole numbers, below `bound` if that is given).

    Within blocks of the key, then over block totals, which are 1 / BLOCK of the keys; where the bound leaves more than BLOCK blocks, block totals are summed the same way.
    Where it leaves one block, there are no totals to add.
    """
    if bound and bound <= BLOCK:
        one = F.sum(value).over(Window.partitionBy(F.floor(F.col(key) / BLOCK)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn(name, F.coalesce(one, F.lit(0)).cast("long"))
    b = df.withColumn("_block", F.floor(F.col(key) / BLOCK).cast("long"))
    before = lambda w, v: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = b.groupBy("_block").agg(F.sum(value).alias("_t"))
    if bound and bound // BLOCK > BLOCK:
        totals = running(totals.select(F.col("_block").alias("_b"), "_t"), "_b", "_t", "_sum", bound // BLOCK + 1).select(F.col("_b").alias("_block"), F.col("_sum").alias("_base"))
    else:
        totals = totals.select("_block", before(Window.orderBy("_block"), "_t").alias("_base"))
    inner = before(Window.partitionBy("_block").orderBy(key), value)
    return b.withColumn("_in", inner).join(totals, "_block").withColumn(name, (F.col("_in") + F.col("_base")).cast("long")).drop("_block", "_in", "_base")


def positioned(df: DataFrame, order: list[str], lead: Column, name: str = "pos", bound: int | None = None) -> DataFrame:
    """Add `name`: the row's place (from 0) in the order. `lead` is a whole number (below `bound`) that never falls along the order; rows are numbered inside each
    of its values and moved up by the rows before, so the work of one task is bounded by one value of lead, not by the table."""
    d = df.withColumn("_lead", lead.cast("long"))
    start = running(d.groupBy("_lead").agg(F.count("*").alias("_n")), "_lead", "_n", "_start", bound).select("_lead", "_start")
    rn = F.row_number().over(Window.partitionBy("_lead").orderBy(*order)) - 1
    return d.withColumn("_rn", rn).join(start, "_lead").withColumn(name, F.col("_rn") + F.col("_start")).drop("_lead", "_rn", "_start")


def ordered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Add `name`: the row's place (from 0) in the order. Rows are sorted by ranges of the order and kept in the shared folder with their place inside their range;
    places are then moved up by the rows of the ranges before, whose counts (one for each task of the sort) come to the driver."""
    return placed(df.sort(*order), name)


def placed(df: DataFrame, name: str = "pos") -> DataFrame:
    """Add `name` to rows that lie in their order already: sorted inside partitions, partition after partition."""
    d = kept(df.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    shifts, before = [], 0
    for r in sorted(d.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        shifts += [0] * (r.part - len(shifts)) + [before - (r.part << 33)]
        before += r.n
    shift = F.get(F.array(*[F.lit(x).cast("long") for x in shifts or [0]]), part)
    return d.select((F.col("_id") + shift).alias(name), *[c for c in df.columns])


def steps(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """(pos, past, x): the sums of value over all smaller keys, for each of the positions 0 to size - 1, as runs: pos up to past (not included) hold x.

    No run crosses a multiple of BLOCK, so the number of runs is that of different keys and of blocks, and no run is long. Keys are whole numbers from 0 to size - 2.
    """
    spark, blocks = df.sparkSession, (size - 1) // BLOCK + 1
    block = F.floor(F.col("pos") / BLOCK).cast("long").alias("_cut")
    at = df.select((F.col(key) + 1).alias("pos"), F.col(value).alias("_n")).select(block, "pos", "_n").groupBy("_cut", "pos").agg(F.sum("_n").alias("_n"))
    every = spark.range(blocks).select(F.col("id").alias("_cut"), F.lit(0).cast("long").alias("_n"))
    totals = running(at.select("_cut", "_n").unionByName(every).groupBy("_cut").agg(F.sum("_n").alias("_n")), "_cut", "_n", "_before", blocks)
    marks = totals.select("_cut", (F.col("_cut") * BLOCK).alias("pos"), F.col("_before").alias("_n"))
    d = at.unionByName(marks).repartition(min(blocks // BLOCKS_A_TASK + 1, MOST_TASKS), "_cut")
    w = Window.partitionBy("_cut").orderBy("pos")
    x = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.least((F.col("_cut") + 1) * BLOCK, F.lit(size))
    return d.select("pos", F.coalesce(F.lead("pos").over(w), end).alias("past"), x.alias("x")).where("past > pos")


def unrolled(runs: DataFrame) -> DataFrame:
    """(pos, x) of each position of such runs."""
    return runs.select(F.explode(F.sequence(F.col("pos"), F.col("past") - 1)).alias("pos"), "x")
