"""Levels made from data: counts, slots, ranks and schedules of rows; and the formats that use them."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dense import dense
from ..functions.prefix import positioned

#: Rows in index order that are scheduled together.
ROWS_AT_ONCE = 1 << 16


def sums(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, nnz): entries of each prefix."""
    return df.groupBy(*keys).agg(F.count("*").alias("nnz"))


def row_counts(tensor, level: int = 0) -> DataFrame:
    """(i, nnz) of every row, empty ones too; level 1: of every column."""
    every = tensor.df.sparkSession.range(tensor.shape[level]).select(F.col("id").alias("i"))
    n = sums(tensor.df.select(F.col("ij"[level]).alias("i")), "i")
    return every.join(n, "i", "left").select("i", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def enumerate_slots(df: DataFrame, key: str = "i", along: str = "j", name: str = "slot", run: int = 4096) -> DataFrame:
    """Add `name`: the number of an entry inside its key, in the order of `along` (then v). A key is numbered in runs of `along`, so a row with very many entries isn't one task."""
    d = df.withColumn("_run", F.floor(F.col(along) / run))
    n = d.groupBy(key, "_run").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(key, "_run", before.alias("_before"))
    rn = F.row_number().over(Window.partitionBy(key, "_run").orderBy(along, "v")) - 1
    return d.withColumn("_rn", rn).join(n, [key, "_run"]).withColumn(name, (F.col("_rn") + F.col("_before")).cast("long")).drop("_run", "_rn", "_before")


def reorder(counts: DataFrame) -> DataFrame:
    """(i, nnz, rank): rank of rows by falling nnz, ties to the lower row. Ranks are counted inside each nnz, so no window spans all rows."""
    top = counts.agg(F.max("nnz")).first()[0] or 0
    d = counts.withColumn("_down", F.lit(top) - F.col("nnz")).withColumn("_part", F.floor(F.col("i") / 65536))
    parts = d.agg(F.max("_part")).first()[0] or 0
    return positioned(d, ["_down", "i"], F.col("_down") * (parts + 1) + F.col("_part"), "rank").select("i", "nnz", "rank")


def schedule(counts: DataFrame, buckets: int, order: str = "i", limit: int | None = None) -> DataFrame:
    """(i, nnz, bucket): rows in order, each to the bucket with the fewest entries so far (ties to the lower bucket). Over `limit` rows, if given, this raises ValueError.

    By "rank" (falling nnz, from reorder) equal rows are placed together: the driver gets the number of rows of each nnz, and a row finds its bucket from its rank.
    In index order each choice depends on all before it, so rows are dealt in runs of ROWS_AT_ONCE indexes that start with empty buckets: each run is balanced on its own, as
    its rows alone would be, and runs are independent groups.
    """
    if limit is not None and (n := counts.count()) > limit:
        raise ValueError(f"{n} rows to schedule, more than {limit}")
    return _by_runs(counts, buckets) if order == "rank" else _in_order(counts, buckets)


def _in_order(counts: DataFrame, buckets: int) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i", kind="stable")
        heap, out = [(0, b) for b in range(buckets)], []
        for x in g.nnz.tolist():
            load, b = heap[0]
            heapq.heapreplace(heap, (load + x, b))
            out.append(b)
        return pd.DataFrame({"i": g.i, "nnz": g.nnz, "bucket": np.array(out, np.int32)})

    d = counts.select(F.col("i").cast("long"), F.col("nnz").cast("long"))
    return d.groupBy(F.floor(F.col("i") / ROWS_AT_ONCE)).applyInPandas(run, "i long, nnz long, bucket int")


def _steady(loads: np.ndarray, x: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows of x entries until no bucket is below the fullest one, loads then, order of the buckets from there on)."""
    n = -(-(loads.max() - loads) // x)
    level = loads + n * x
    return int(n.sum()), level, np.lexsort((np.arange(len(loads)), level))


def _uneven(loads: np.ndarray, x: int, r: np.ndarray) -> np.ndarray:
    """Bucket of the r-th row of x entries, before the loads are steady: rows go to places (load + t * x, bucket) in their order, so the load at place r is searched for."""

    def upto(v):
        return sum(np.maximum((v - load) // x + 1, 0) for load in loads)

    lo, hi = np.full(len(r), loads.min()), np.full(len(r), loads.max())
    while (lo < hi).any():
        mid = (lo + hi) // 2
        enough = upto(mid) > r
        lo, hi = np.where(enough, lo, mid + 1), np.where(enough, mid, hi)
    left, out = r - upto(lo - 1), np.full(len(r), -1)
    for b, load in enumerate(loads):
        here = (lo >= load) & ((lo - load) % x == 0)
        out[here & (left == 0) & (out < 0)] = b
        left = left - here
    return out


def _placed(loads: np.ndarray, x: int, r: np.ndarray) -> np.ndarray:
    """Bucket of the r-th of rows that all have x entries."""
    if x == 0:
        return np.full(len(r), loads.argmin())
    start, _, order = _steady(loads, x)
    out = order[(r - start) % len(loads)]
    early = r < start
    if early.any():
        out[early] = _uneven(loads, x, r[early])
    return out


def _after(loads: np.ndarray, x: int, n: int) -> np.ndarray:
    """Loads after n rows of x entries."""
    if x == 0:
        return loads
    start, level, order = _steady(loads, x)
    if n >= start:
        out = level + x * ((n - start) // len(loads))
        out[order[: (n - start) % len(loads)]] += x
        return out
    lo, hi = int(loads.min()), int(loads.max())
    upto = lambda v: np.maximum((v - loads) // x + 1, 0)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if upto(mid).sum() > n else (mid + 1, hi)
    rows = upto(lo - 1)
    here = np.flatnonzero((lo >= loads) & ((lo - loads) % x == 0))
    rows[here[: n - rows.sum()]] += 1
    return loads + x * rows


def _by_runs(counts: DataFrame, buckets: int) -> DataFrame:
    runs, loads, first = {}, np.zeros(buckets, np.int64), 0
    for x, n in sorted(counts.groupBy("nnz").agg(F.count("*").alias("n")).collect(), reverse=True):
        runs[x] = (first, loads)
        loads, first = _after(loads, x, n), first + n
    held = counts.sparkSession.sparkContext.broadcast(runs)

    def run(batches):
        for t in batches:
            nnz, rank = t.column("nnz").to_numpy(), t.column("rank").to_numpy()
            out = np.empty(len(nnz), np.int64)
            for x in np.unique(nnz):
                first, loads = held.value[int(x)]
                at = nnz == x
                out[at] = _placed(loads, int(x), rank[at] - first)
            yield pa.RecordBatch.from_arrays([t.column("i"), t.column("nnz"), pa.array(out.astype(np.int32))], ["i", "nnz", "bucket"])

    return counts.select(*(F.col(c).cast("long").alias(c) for c in ("i", "nnz", "rank"))).mapInArrow(run, "i long, nnz long, bucket int")


def pack(df: DataFrame, start: int, end: int, name: str = "packed") -> DataFrame:
    """Draw level columns start..end together into one struct."""
    cols = [f"l{k}" for k in range(start, end + 1)]
    return df.withColumn(name, F.struct(*cols)).drop(*cols)


def unpack(df: DataFrame, name: str = "packed") -> DataFrame:
    """Level columns again."""
    return df.select(*[c for c in df.columns if c != name], f"{name}.*")


def partition(df: DataFrame, parts: int, *levels: str) -> DataFrame:
    """Lay rows out by level columns."""
    return df.repartition(parts, *levels)


def with_indirect(tensor) -> DataFrame:
    """Level columns and v of a format whose first level comes from the data: slots (enumerate), or scheduled buckets of rows, reordered before if asked.

    The option sum says which index is counted: 0, rows (l1 is i, l2 is j), or 1, columns (numbered along rows; l1 and l2 are still i and j).
    """
    o = tensor.encoding.indirect
    level = o.get("sum", 0)
    key, along = "ij"[level], "ij"[1 - level]
    if o.get("enumerate"):
        return enumerate_slots(tensor.df, key, along).select(F.col("slot").alias("l0"), F.col("i").alias("l1"), F.col("j").alias("l2"), "v")
    if not o.get("schedule"):
        raise ValueError(f"{tensor.encoding.name}: an indirect level needs enumerate or schedule")
    counts = row_counts(tensor, level)
    if o.get("reorder"):
        counts = reorder(counts)
    rows = schedule(counts, o["schedule"], "rank" if o.get("reorder") else "i").select(F.col("i").alias(key), F.col("bucket").cast("long").alias("l0"))
    return tensor.df.join(rows, key).select("l0", F.col("i").alias("l1"), F.col("j").alias("l2"), "v")


def ell_arrays(tensor, chunk: int = 1 << 16) -> DataFrame:
    """(slot, chunk, crd, values): the slot-major arrays of ELL, one place for each row, in chunks of that many rows; places without an entry hold 0.

    A chunk without any entry isn't stored. The last chunk ends with the last row.
    """
    m = max(1, tensor.shape[0])
    chunk = min(chunk, m)
    d = enumerate_slots(tensor.df).withColumn("chunk", F.floor(F.col("i") / chunk)).withColumn("_at", F.pmod("i", F.lit(chunk)))
    out = dense(d, ["slot", "chunk"], "_at", chunk, {"crd": "j", "values": "v"})
    left = F.least(F.lit(chunk), m - F.col("chunk") * chunk).cast("int")
    return out.select("slot", "chunk", F.slice("crd", 1, left).alias("crd"), F.slice("values", 1, left).alias("values"))


def bell(tensor, r: int, c: int) -> DataFrame:
    """(slot, block_row, block_col, block): block ELL; tiles of r x c, numbered inside their block row, with dense values."""
    from ..encoding import bcsr

    b = tensor.convert(bcsr(r, c)).storage().blocks().select("l0", "l1", "block")
    d = enumerate_slots(b.select(F.col("l0").alias("i"), F.col("l1").alias("j"), F.col("block").alias("v")))
    return d.select("slot", F.col("i").alias("block_row"), F.col("j").alias("block_col"), F.col("v").alias("block"))


def serpens(tensor, lanes: int) -> DataFrame:
    """(group, lane, slot, i, j, v): rows by falling nnz, dealt to lanes of groups by rank, entries numbered inside a row."""
    ranks = reorder(row_counts(tensor)).select("i", "rank")
    d = enumerate_slots(tensor.df).join(ranks, "i")
    return d.select(F.floor(F.col("rank") / lanes).alias("group"), F.pmod("rank", F.lit(lanes)).alias("lane"), "slot", "i", "j", "v")
