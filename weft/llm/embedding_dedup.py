"""Near-duplicate vectors by a pivot-permutation index with exact verification."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_stash, stash

#: Bounds of the number of reference points, which grows with the square root of the rows.
FEWEST, MOST = 64, 1024
_VECTOR = "g long, h long, id long, label string, dim int, copies long, embedding array<double>"


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Pivots:
    """Reference points of one dimension: the centre that vectors are moved by, unit points, and how many of the nearest points make lists and descriptions."""

    centre: np.ndarray
    points: np.ndarray
    lists: int
    depth: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """The nearest points of unit vectors, nearest first."""
        return np.argsort(-((x - self.centre) @ self.points.T), axis=1, kind="stable")[:, : self.depth]


def _share(a: np.ndarray, b: np.ndarray, k: int, m: int) -> np.ndarray:
    """For each row: how many of m points are among the first k of both."""
    row = np.arange(len(a))[:, None]
    x, y = np.zeros((2, len(a), m), np.int8)
    x[row, a[:, :k]] = 1
    y[row, b[:, :k]] = 1
    return (x & y).sum(axis=1)


def choose_pivots(vectors: DataFrame, pivots: int, sample: int, threshold: float, shared: int, goal: float = 0.995) -> dict[int, Pivots]:
    """{dimension: Pivots} from the `sample` vectors with the smallest id hashes.

    Vectors are moved by their common centre before they are described, so a direction that all share doesn't draw the reference points together. The points are chosen one
    after another, each the vector farthest from those before: copies of one vector give one point, and there are `pivots` of them wherever so many vectors differ.
    Then sampled vectors are turned by just the threshold's angle in a random direction, and of numbers of points and lists the cheapest is taken (by the squares of list lengths, and
    the number of postings) with which at least `goal` of them would be found again; where none reaches that, the one that finds most.
    """
    rows = vectors.select("dim", "embedding").orderBy(F.xxhash64("g", "h"), "g", "h").limit(sample).collect()
    out = {}
    for d in {r["dim"] for r in rows}:
        x = unit_rows(np.array([r["embedding"] for r in rows if r["dim"] == d], np.float64))
        centre = x.mean(axis=0) if len(x) > 1 else np.zeros(d)
        z = x - centre
        n = np.linalg.norm(z, axis=1)
        z = z[n > 1e-9] / n[n > 1e-9, None]
        chosen, near = [], np.full(len(z), -2.0)
        while len(chosen) < min(pivots, len(z)) and near.min() < 1 - 1e-9:
            chosen.append(int(near.argmin()))
            near = np.maximum(near, z @ z[chosen[-1]])
        points = z[chosen] if chosen else np.eye(1, d)
        rng = np.random.default_rng(d)
        r = rng.normal(size=x[:2048].shape)
        r -= (r * x[:2048]).sum(axis=1, keepdims=True) * x[:2048]
        c = min(threshold, 1.0)
        turned = unit_rows(c * x[:2048] + math.sqrt(1 - c * c) * r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12))
        tried = []
        m = len(points)
        while True:
            for lists in (3, 4, 5, 6, 8, 12):
                p = Pivots(centre, points[:m], lists, 2 * lists)
                a, b = p.order(x[:2048]), p.order(turned)
                found = ((_share(a, b, lists, m) >= min(2, m)) & (_share(a, b, 2 * lists, m) >= min(shared, m))).mean()
                top = np.zeros((len(a), m), np.float32)
                top[np.arange(len(a))[:, None], a[:, :lists]] = 1
                both = np.triu(top.T @ top, 1)
                tried.append((found < goal, -found if found < goal else float((both**2).sum()) / len(a) ** 2 + lists * lists / 1000, -len(tried), p))
            if m <= 16:
                break
            m = max(16, m // 2)
        out[d] = min(tried)[3]
    return out


def described(vectors: DataFrame, pivots: dict[int, Pivots]) -> DataFrame:
    """(g, h, id, label, dim, copies, embedding, near, lists): near holds the nearest points of a vector, nearest first; lists the pairs of points that it is listed under.

    A dimension that no sampled vector has takes the directions of its axes, of both signs, as reference points.
    """
    held = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                near: list = [None] * c.num_rows
                lists: list = [None] * c.num_rows
                e, dims = c.column("embedding").to_pylist(), np.array(c.column("dim").to_pylist())
                for d in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == d)
                    p = held.value.get(d) or Pivots(np.zeros(d), np.concatenate([np.eye(d), -np.eye(d)]), min(8, d), 16)
                    for r, t in zip(rows, p.order(unit_rows(np.array([e[r] for r in rows], np.float64))).tolist()):
                        first = sorted(t[: p.lists])
                        near[r] = t
                        lists[r] = [x << 20 | y for x, y in combinations(first, 2)] or [first[0] << 20 | first[0]]
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(near, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int64()))], [*c.schema.names, "near", "lists"])

    return vectors.mapInArrow(run, f"{_VECTOR}, near array<int>, lists array<long>")


def _block(p: int, q: int, left: pd.DataFrame, right: pd.DataFrame | None, threshold: float, shared: int) -> pd.DataFrame:
    """(g, h, n, id, root): the links of each vector inside a block of the list of pivots p < q, and the smallest id that the block connects it with.

    A pair is a candidate if its descriptions share at least `shared` pivots (all, if they are shorter), and belongs to the list of the two smallest pivots that both are listed
    under; p = q is the list of vectors with a single pivot. A vector that stands for copies links as often.
    """
    both = left if right is None else pd.concat([left, right], ignore_index=True)
    n, ids = len(both), both.id.to_numpy()
    used, at = np.unique(np.concatenate(both.near.to_list()), return_inverse=True)
    deep, top = np.zeros((n, len(used)), np.float32), np.zeros((n, len(used)), np.float32)
    start = 0
    for i, x in enumerate(both.near):
        deep[i, at[start : start + len(x)]] = 1
        start += len(x)
    listed = [{v for k in x for v in (k >> 20, k & 0xFFFFF)} for x in both.lists]
    for i, x in enumerate(listed):
        top[i, np.searchsorted(used, list(x))] = 1
    e = unit_rows(np.stack(both.embedding.to_numpy()).astype(np.float64))
    least = min(shared, min(map(len, both.near)))
    before = top[:, (used < q) & (used != p)]
    ok = (deep @ deep.T >= least) & (before @ before.T == 0)
    np.fill_diagonal(ok, False)
    if right is not None:
        side = np.arange(n) < len(left)
        ok &= side[:, None] != side[None, :]
    ok &= e @ e.T >= threshold
    count = ok @ both.copies.to_numpy()
    root, todo = np.full(n, -1), np.argsort(ids, kind="stable")
    for s in todo:
        if root[s] < 0 and count[s]:
            front = np.array([s])
            while len(front):
                root[front] = s
                front = np.flatnonzero(ok[front].any(axis=0) & (root < 0))
    has = count > 0
    return pd.DataFrame({"g": both.g.to_numpy()[has], "h": both.h.to_numpy()[has], "n": count[has], "id": ids[has], "root": ids[root[has]]})


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, pivots: int | None = None, sample: int = 4096, shared: int = 4, chunk: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row; links join vectors of one label with a cosine (double precision) of at least `threshold`.

    1. Rows with equal label and components are one vector, named by the smallest vec_id, that counts as often as it has ids. Equal vectors link.
    2. Every vector is described by its nearest of `pivots` reference points (by default at most twice the square root of the vectors, FEWEST to MOST) and stands in one inverted
       list for each pair of its first points, kept per label. So lists shorten with the square of the number of points.
    3. Pairs in a list that share at least `shared` points are verified. A list longer than `chunk` is dealt into chunks by hash, and each pair of chunks is a block of its own: blocks
       stay small whatever a label or a group of near copies holds, and give counts and spanning links, never all pairs.
    The points come from a bounded sample of `sample` vectors; all vectors are indexed.

    Null, empty or zero vectors, vectors with null or non-finite components, and vectors without a label or a vec_id link with nothing (n_links 0, kept). Vectors of different
    lengths never link. label may be of any type that has a string form. Rows that repeat a vec_id with the same vector are one vector and give equal rows; with another
    vector they are a further vector, whose links are its own and whose component is that of the id. Empty input gives no rows. Other columns are ignored.
    """
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)  # -0.0 and 0.0 are one number
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), e.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # 128 bits name a label and a vector
    rows = rows.withColumn("g", F.when(usable, F.xxhash64("label", "embedding"))).withColumn("h", F.when(usable, F.xxhash64("embedding", "label", F.lit(7))))
    ids = rows.where("g is not null").groupBy("vec_id", "g", "h").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    distinct = ids.groupBy("g", "h").agg(F.min("vec_id").alias("id"), F.first("label").alias("label"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    distinct = stash(distinct.select("g", "h", "id", "label", F.size("embedding").alias("dim"), "copies", "embedding"), "vectors")
    n = distinct.count()
    if pivots is None:
        pivots = min(MOST, max(FEWEST, 2 * math.isqrt(n)))
    index = stash(described(distinct, choose_pivots(distinct, pivots, sample, threshold, shared)), "index")

    keys = ["label", "dim", "list"]
    posted = index.withColumn("list", F.explode("lists"))
    length = posted.groupBy(*keys).agg(F.count("*").alias("m")).where("m > 1").select(*keys, F.ceil(F.col("m") / chunk).cast("int").alias("c"))
    length = stash(length, "lists")
    own = F.pmod("g", F.col("c")).cast("int")
    dealt = posted.join(length, keys).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    dealt = dealt.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "g", "h", "id", "copies", "embedding", "near", "lists")

    def run(key, t):
        p, q, i, j = int(key[2]) >> 20, int(key[2]) & 0xFFFFF, key[3], key[4]
        if i == j:
            return _block(p, q, t, None, threshold, shared)
        return _block(p, q, t[t.own == i], t[t.own == j], threshold, shared)

    found = stash(dealt.groupBy(*keys, "i", "j").applyInPandas(run, "g long, h long, n long, id long, root long"), "found")
    count = found.groupBy("g", "h").agg(F.sum("n").alias("n"))
    members = stash(distinct.select("g", "h", "id", "copies").join(count, ["g", "h"], "left").select("g", "h", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "members")
    # an id may have several vectors, which then are in one component
    links = found.select("id", "root").unionByName(rows.join(members.select("g", "h", "id"), ["g", "h"]).select("vec_id", F.col("id").alias("root")).toDF("id", "root"))
    comps = components(links, "id", "root")
    drop_stash(index, length, found, distinct)
    out = rows.join(members.drop("id"), ["g", "h"], "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    cid = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(cid == F.col("vec_id"), F.lit(True)).alias("kept"))
