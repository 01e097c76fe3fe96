"""K-d tree shards: recursive splits at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, numbered, stash

#: Histogram cells of one node in one refinement pass, and of all nodes together: what a pass brings to the driver.
CELLS, ALL_CELLS = 1024, 1 << 22
#: Rows of a table that is broadcast without Spark's own look at its size (under 2 MB).
SMALL = 1 << 16
_DIMS = ("q_bytes", "q_lang", "q_source", "q_doc")


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unit = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(2**31))  # noqa: E731  a category's fixed place on its axis
    lang, source = (unit(c) if c in docs.columns else F.lit(0).cast("long") for c in ("lang", "source"))
    return docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("g"), lang.alias("lang_at"), source.alias("source_at"),
    )


@dataclass
class Tree:
    """Splits by node number (1 is the root; 2n and 2n + 1 are below n): dimension, and the first key of the right side. shard names the leaves."""

    dim: dict[int, int] = field(default_factory=dict)
    cut: dict[int, int] = field(default_factory=dict)
    shard: dict[int, int] = field(default_factory=dict)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array(sorted(self.dim), np.int64)
        return n, np.array([self.dim[k] for k in n], np.int64), np.array([self.cut[k] for k in n], np.int64)


def keys_of(b: pa.RecordBatch) -> np.ndarray:
    """[dimension, unit]: a unit's place on each axis, the dimension and then the tie hash."""
    tie = b.column("tie").to_numpy()
    return np.stack([(b.column(c).to_numpy() << 32) + tie for c in _DIMS])


def descend(keys: np.ndarray, splits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The node of each unit, from the root down."""
    node, dim, cut = splits
    at, go = np.ones(keys.shape[1], np.int64), np.arange(keys.shape[1])
    while len(node) and len(go):
        k = np.minimum(np.searchsorted(node, at[go]), len(node) - 1)
        inner = node[k] == at[go]
        go, k = go[inner], k[inner]
        at[go] = 2 * at[go] + (keys[dim[k], go] >= cut[k])
    return at


def _extents(units: DataFrame, splits, nodes: np.ndarray) -> dict[int, tuple]:
    """{node: (bytes, least and greatest place per dimension)} of the nodes asked for that hold units; one row a node comes to the driver."""
    held = units.sparkSession.sparkContext.broadcast((splits, nodes))

    def run(batches):
        splits, nodes = held.value
        w, lo, hi = np.zeros(len(nodes), np.int64), np.full((len(_DIMS), len(nodes)), 2**63 - 1), np.full((len(_DIMS), len(nodes)), -1)
        for b in batches:
            keys = keys_of(b)
            at = descend(keys, splits)
            k = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
            ok = nodes[k] == at
            np.add.at(w, k[ok], b.column("w").to_numpy()[ok])
            for d in range(len(_DIMS)):
                np.minimum.at(lo[d], k[ok], keys[d][ok])
                np.maximum.at(hi[d], k[ok], keys[d][ok])
        use = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[use]), pa.array(w[use]), *[pa.array(x[d][use]) for d in range(len(_DIMS)) for x in (lo, hi)]], ["node", "w", *(f"{x}{d}" for d in range(len(_DIMS)) for x in ("lo", "hi"))])

    cols = [f"{x}{d}" for d in range(len(_DIMS)) for x in ("lo", "hi")]
    part = units.mapInArrow(run, "node long, w long, " + ", ".join(f"{c} long" for c in cols))
    rows = part.groupBy("node").agg(F.sum("w").alias("w"), *[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in cols]).collect()
    return {r["node"]: (r["w"], [(r[f"lo{d}"], r[f"hi{d}"]) for d in range(len(_DIMS))]) for r in rows}


def _histogram(units: DataFrame, splits, nodes: np.ndarray, dim: np.ndarray, lo: np.ndarray, width: np.ndarray, cells: int) -> np.ndarray:
    """[node, cell]: bytes in `cells` cells of `width` keys from `lo` on, along each node's dimension. Tasks send the cells that hold something."""
    held = units.sparkSession.sparkContext.broadcast((splits, nodes, dim, lo, width))

    def run(batches):
        splits, nodes, dim, lo, width = held.value
        out = np.zeros(len(nodes) * cells)
        for b in batches:
            keys = keys_of(b)
            at = descend(keys, splits)
            k = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
            ok = np.flatnonzero(nodes[k] == at)
            k = k[ok]
            key = keys[dim[k], ok]
            cell = (key - lo[k]) // width[k]
            inside = (key >= lo[k]) & (cell < cells)
            out += np.bincount((k * cells + cell)[inside], b.column("w").to_numpy()[ok][inside], len(out))
        use = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(use), pa.array(out[use].astype(np.int64))], ["at", "w"])

    t = units.mapInArrow(run, "at long, w long").groupBy("at").agg(F.sum("w").alias("w")).toArrow()
    out = np.zeros(len(nodes) * cells, np.int64)
    out[t.column("at").to_numpy()] = t.column("w").to_numpy()
    return out.reshape(len(nodes), cells)


def _medians(units: DataFrame, splits, nodes: np.ndarray, dim: np.ndarray, first: np.ndarray, past: np.ndarray, total: np.ndarray, want: np.ndarray, near: np.ndarray) -> np.ndarray:
    """First key of the right side of each node, where the left side comes closest to `want` bytes; both sides hold something.

    Histograms are refined until the cell in which the median lies is one key, or holds at most `near` bytes.
    """
    lo, hi, left, cut = first.copy(), past.copy(), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    todo = np.arange(len(nodes))
    while len(todo):
        cells = max(2, min(CELLS, ALL_CELLS // len(todo)))
        width = np.maximum(1, -(-(hi[todo] - lo[todo]) // cells))
        h = _histogram(units, splits, nodes[todo], dim[todo], lo[todo], width, cells)
        upto = left[todo][:, None] + np.cumsum(h, axis=1)
        c = np.minimum((upto < want[todo][:, None]).sum(axis=1), cells - 1)
        row = np.arange(len(todo))
        after, own = upto[row, c], h[row, c]
        before = after - own
        go_after = (before == 0) | (after < total[todo]) & (after - want[todo] <= want[todo] - before)
        splits_here = (width == 1) | (own <= near[todo]) & ~((before == 0) & (after == total[todo]))
        start = lo[todo] + c * width
        cut[todo] = start + go_after * width
        lo[todo], hi[todo], left[todo] = start, np.minimum(hi[todo], start + width), before
        todo = todo[~splits_here]
    return cut


def grow(units: DataFrame, shards: int | None, target_bytes: int | None) -> Tree:
    """The tree over units (w, q_bytes, q_lang, q_source, q_doc, tie). It is split until it has `shards` leaves, or until leaves hold at most `target_bytes`.

    A node of k leaves (in the second case bytes / target_bytes, rounded up) is cut along the dimension that is widest relative to the whole table, where the left side has
    k // 2 of k parts of the bytes. Nodes whose units share one place can't be split. A level takes one job for extents and a few for histograms; units aren't rewritten.
    The driver holds the tree, and of a pass at most ALL_CELLS numbers (two a node beyond that).
    """
    tree, order = Tree(), {}
    open_: dict[int, int] = {1: shards or 0}
    base: list[int] = []
    while open_:
        splits = tree.arrays()
        found = _extents(units, splits, np.array(sorted(open_), np.int64))
        base = base or [max(1, (hi - lo) >> 32) for lo, hi in found[1][1]] if found else base
        nodes, k = [], []
        for n, leaves in open_.items():
            if n not in found:
                continue
            w, ext = found[n]
            leaves = leaves if shards else -(-w // target_bytes)
            if leaves > 1 and any(lo < hi for lo, hi in ext):
                nodes.append(n)
                k.append(leaves)
            else:
                order[n] = leaves
        if not nodes:
            break
        nodes, k = np.array(nodes, np.int64), np.array(k, np.int64)
        by = np.argsort(nodes)
        nodes, k = nodes[by], k[by]
        dim = np.array([max(range(len(_DIMS)), key=lambda d: (found[n][1][d][0] < found[n][1][d][1], ((found[n][1][d][1] >> 32) - (found[n][1][d][0] >> 32)) / base[d], -d)) for n in nodes])  # noqa: B023
        first, past = (np.array([found[n][1][d][i] + i for n, d in zip(nodes, dim)], np.int64) for i in (0, 1))
        total = np.array([found[n][0] for n in nodes], np.int64)
        cut = _medians(units, splits, nodes, dim, first, past, total, total * (k // 2) / k, total / k / 2000)
        for n, d, c in zip(nodes.tolist(), dim.tolist(), cut.tolist()):
            tree.dim[n], tree.cut[n] = d, c
        open_ = {int(x): int(y) for n, m in zip(nodes, k) for x, y in ((2 * n, m // 2), (2 * n + 1, m - m // 2))}
    _name(tree, order, shards)
    return tree


def _name(tree: Tree, leaves: dict[int, int], shards: int | None) -> None:
    """Number the leaves from left to right; with a fixed number of shards each node has a range of its own, whatever its sides hold."""
    todo, at = [(1, 0, shards or 0)], 0
    while todo:
        n, first, k = todo.pop()
        if n in tree.dim:
            todo += [(2 * n + 1, first + k // 2, k - k // 2), (2 * n, first, k // 2)]
        elif n in leaves:
            tree.shard[n] = first if shards else at
            at += 1


def units_of(base: DataFrame, cap: int, most: int, lo_id: int | None, hi_id: int | None) -> tuple[DataFrame, DataFrame]:
    """(documents with their salt, units): documents of one text are one unit, dealt into salted parts of about `cap` bytes if it has more (at most `most` texts do)."""
    big = base.groupBy("g").agg(F.sum("size").alias("b"), F.count("*").alias("r")).where((F.col("b") > cap) & (F.col("r") > 1))
    big = stash(big.select("g", F.ceil(F.col("b") / cap).alias("parts")), "big")
    salted = base.join(F.broadcast(big) if most <= SMALL else big, "g", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    span = max(1, (hi_id or 0) - (lo_id or 0))
    scale = lambda c: F.floor(c * (2**31 - 1)).cast("long")
    units = salted.groupBy("g", "salt").agg(F.sum("size").alias("w"), F.min("doc_id").alias("d"), F.min_by(F.struct("size", "lang_at", "source_at"), "doc_id").alias("m"))
    place = scale(F.coalesce((F.col("d") - F.lit(lo_id)) / span, F.lit(0.0)))
    m = F.coalesce("m", F.struct(F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("lang_at"), F.lit(0).cast("long").alias("source_at")))
    units = units.select(
        "g", "salt", "w", F.pmod(F.xxhash64("g", "salt"), F.lit(2**32)).alias("tie"), scale(F.log2(m["size"]) / 64).alias("q_bytes"),
        m["lang_at"].alias("q_lang"), m["source_at"].alias("q_source"), place.alias("q_doc"),
    )
    return salted, units


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, grain: int = 4) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each document, under the law `bytes`.

    Size is the text's UTF-8 bytes plus 1 (null text: 1). The tree is split until leaves hold at most `target_bytes`, or until there are `shards` leaves of equal shares.
    Documents with equal texts are one unit and stay together, unless they alone have over 1/grain of a leaf's bytes: such a text is dealt into salted parts of that size, so
    it may hold any share of the rows and leaves still come out near equal. A unit's place: bytes (log), language, source (hashed) and least doc_id.

    Null lang or source, or no such column: one category. Empty input: no rows. Rows that repeat a doc_id are dealt like others; rows without a doc_id have the least place.
    """
    shards = None if target_bytes else shards
    base = stash(_sized(docs), "sized")
    total, lo_id, hi_id = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.min("doc_id"), F.max("doc_id")).first()
    leaf = target_bytes or -(-total // shards)
    salted, units = units_of(base, max(1, leaf // grain), -(-total // max(1, leaf)) * grain, lo_id, hi_id)
    units = stash(units, "units")
    tree = grow(units, shards, target_bytes)
    splits = tree.arrays()
    leaves = np.array(sorted(tree.shard), np.int64)
    held = docs.sparkSession.sparkContext.broadcast((splits, leaves, np.array([tree.shard[n] for n in leaves], np.int32)))

    def run(batches):
        splits, leaves, shard = held.value
        for b in batches:
            s = shard[np.searchsorted(leaves, descend(keys_of(b), splits))]
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("salt"), pa.array(s)], ["g", "salt", "shard"])

    placed = stash(units.mapInArrow(run, "g long, salt int, shard int"), "placed")
    drop_stash(units)
    out = numbered(salted.join(placed, ["g", "salt"]).select("doc_id", "size", "text_crc32", "shard"), ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot", buckets=256)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
