"""Near-duplicate documents by MinHash bands with sequential Bayesian verification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_stash, merged_components, stash
from .common import word_hash as _hash

_U = np.uint64


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words (words: no ASCII white space; A-Z in lower case).

    Fewer words than `size`: the whole sequence is one shingle. Null, empty or blank: the empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(_hash.__getitem__, words), dtype=_U, count=len(words))
    k = min(size, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    s = np.full(n, k, _U)
    for i in range(k):
        s = (s ^ h[i : i + n]) * _U(0x9E3779B97F4A7C15)
        s ^= s >> _U(29)
    s *= _U(0xD6E8FEB86659FD93)
    return np.unique(s ^ (s >> _U(32)))


def hash_params(n: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**32, (2, n), dtype=_U).astype(np.uint32) | np.uint32(1)


def signature(s: np.ndarray, params: np.ndarray) -> np.ndarray:
    """One minimum for each hash function, over the whole set, in blocks that bound memory for very long texts."""
    out = np.full(params.shape[1], 0xFFFFFFFF, np.uint32)
    x = (s >> _U(32)).astype(np.uint32)
    for i in range(0, len(x), 256):
        v = x[i : i + 256, None] * params[0][None, :]
        v ^= v >> np.uint32(15)
        v *= params[1]
        np.minimum(out, v.min(axis=0), out=out)
    return out


def least_matches(hashes: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """For each number of compared hashes: the fewest matches with P(similarity >= threshold | matches) >= miss, under a uniform prior.

    The posterior is Beta(m + 1, n - m + 1); its tail above the threshold is a binomial sum.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        # P(Beta(m+1, n-m+1) >= t) = P(Bin(n+1, t) <= m)
        acc, m = 0.0, 0
        while m <= n:
            acc += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if acc >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def features(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, fp, sig) of each document: set size, 128-bit fingerprint of the set, signature bytes (null for the empty set)."""
    params = hash_params(bands * rows)
    schema = "doc_id long, n long, fp binary, sig binary"

    def run(batches):
        for b in batches:
            ids, n, fp, sig = b.column(0), [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), size)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s, params).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "fp", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def band_rows(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, key, id, n): one row for each class and band; key is a hash of the band's number and minima."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 4 * rows * i + 1, 4 * rows)) for i in range(bands)])
    return reps.select("id", "n", F.posexplode(keys).alias("band", "key"))


def bayes_pruned(pairs: DataFrame, sigs: DataFrame, hashes: int, batch: int, num: int, den: int, miss: float) -> DataFrame:
    """(a, b, m): candidates that no batch of signature values ruled out; m matches of all hashes."""
    steps = least_matches(hashes, batch, num / den, miss)

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint32).reshape(t.num_rows, hashes) for i in (2, 3))
            alive, m, done = np.arange(t.num_rows), np.zeros(t.num_rows, np.int64), 0
            for n, least in steps:
                m[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                alive, done = alive[m[alive] >= least], n
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(alive)), t.column(1).take(pa.array(alive)), pa.array(m[alive])], ["a", "b", "m"])

    s = sigs.select("id", "sig")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long, m long")


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (ids.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, s): the shingle sets of the documents with these ids (and of a few others). Texts are never shuffled.

    The ids go to the tasks as a filter of at most 2^26 bits, sized by their number; it may let others pass, never drops one of them, and the joins that
    follow are exact. A filter that fills up only means that more sets are made.
    """
    bits = min(26, max(16, (16 * ids.count()).bit_length()))

    def mark(batches):
        for b in batches:
            h = _slots(b.column(0).to_numpy(), bits)
            w, inv = np.unique(h >> _U(6), return_inverse=True)
            v = np.zeros(len(w), _U)
            np.bitwise_or.at(v, inv, _U(1) << (h & _U(63)))
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(v.view(np.int64))], ["w", "v"])

    words = ids.mapInArrow(mark, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).collect()
    table = np.zeros(1 << (bits - 6), _U)
    for r in words:
        table[r["w"]] = np.int64(r["v"]).view(_U)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            h = _slots(i, bits)
            at = np.flatnonzero(held.value[(h >> _U(6)).astype(np.int64)] >> (h & _U(63)) & _U(1))
            for k in range(0, len(at), 256):
                t = b.take(pa.array(at[k : k + 256]))
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array([shingle_set(x.as_py(), size).tobytes() for x in t.column(1)], pa.binary())], ["id", "s"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).mapInArrow(run, "id long, s binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union on the full shingle sets. Sets are made again, only for documents in a pair."""

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                i = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * i >= num * (len(x) + len(y) - i))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], ["a", "b"])

    pairs = stash(pairs.select("a", "b"), "pairs")
    s = stash(full_sets(docs, pairs.select("a").union(pairs.select("b")).distinct(), size), "sets")
    both = pairs.join(s.toDF("b", "sb"), "b").join(s.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")
    out = stash(both.mapInArrow(run, "a long, b long"), "links")
    drop_stash(s, pairs)
    return out


def _strays(g: pd.DataFrame, band: int, rows: int, steps: list, num: int, den: int) -> pd.DataFrame:
    """Links of a block of a large bucket: strays (role s) against members (role m) of other components; one link for each stray and component.

    A pair that meets in an earlier band was looked at there. Signatures prune as elsewhere; the rest is decided on the full sets, against one table of the block's shingles.
    """
    m, x = g[g.role == "m"], g[g.role == "s"]
    if not len(m) or not len(x):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    sm, sx = (np.stack([np.frombuffer(v, np.uint32) for v in t.sig]) for t in (m, x))
    cm, ids = m.comp.to_numpy(), m.id.to_numpy()
    sets = [np.frombuffer(v, _U) for v in m.s]
    size = np.array([len(v) for v in sets])
    every = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    out = []
    for i, (id_, comp, s) in enumerate(zip(x.id, x.comp, x.s)):
        ok = cm != comp
        same = sm == sx[i]
        ok &= ~same[:, : band * rows].reshape(len(m), band, rows).all(axis=2).any(axis=1)
        for n, least in steps:
            ok &= same[:, :n].sum(axis=1) >= least
        if not ok.any():
            continue
        s = np.frombuffer(s, _U)
        at = np.minimum(np.searchsorted(s, every), len(s) - 1)
        common = np.add.reduceat((s[at] == every).astype(np.int64), starts)
        ok &= den * common >= num * (len(s) + size - common)
        if ok.any():
            _, first = np.unique(cm[ok], return_index=True)
            out += [(min(id_, o), max(id_, o)) for o in ids[ok][first]]
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def minhash_dedup(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 5, batch: int = 32, miss: float = 1e-6, small: int = 32, chunk: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document.

    Two documents link when den * |intersection| >= num * |union| of their distinct shingles. A pair at a similarity of 0.8 meets in no band with
    probability (1 - 0.8^rows)^bands = 3e-6, and `miss` is the posterior probability under which a candidate is pruned; every link is confirmed on the full sets.

    1. Documents with equal sets are one class, named by its smallest doc_id; only classes go on.
    2. In each band bucket all members are candidates of its smallest member; pairs are pruned in signature batches, then verified, and components follow.
    3. Buckets that still hold several components are searched for links between these, each pair with at least one member outside the bucket's commonest component. Buckets of at most
       `small` members give such pairs as rows (under `small` a member); larger ones are dealt into blocks of strays and members of about `chunk` each, which decide on full
       sets inside the task and return links alone. So no candidate is left out and no group of copies is spread into pairs.

    Null, empty and blank texts have the empty set: n_shingles 0, linked with nothing, kept. doc_id is expected to be unique and not null; rows that repeat a doc_id with
    the same text give repeated rows. Other columns of docs are ignored, so clashing names do no harm.
    """
    hashes = bands * rows
    feats = stash(features(docs, shingle, bands, rows), "features")
    classes = stash(feats.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    reps = stash(feats.where("fp is not null").join(classes.select("id"), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "n", "sig").dropDuplicates(["id"]), "reps")
    bucket = band_rows(reps, bands, rows)
    near = lambda x, y: (F.least(x, y) * den >= F.greatest(x, y) * num)  # noqa: E731  sets of other sizes can't reach the similarity

    several = stash(bucket.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("p"), F.min_by("n", "id").alias("pn")).where("c > 1"), "buckets")
    members = stash(bucket.join(several.select("key", "p", "pn"), "key"), "members")
    stars = members.where((F.col("p") < F.col("id")) & near(F.col("n"), F.col("pn"))).select(F.col("p").alias("a"), F.col("id").alias("b")).distinct()
    stars = stash(stars, "stars")
    pool = stash(bayes_pruned(stars, reps, hashes, batch, num, den, miss), "pool")

    best = pool.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("m"), "a"))).where("r = 1")
    first = verified(best, docs, shingle, num, den)
    comps = components(first)

    def labelled(df: DataFrame, id_: str, name: str) -> DataFrame:
        return df.join(comps.select(F.col("node").alias(id_), F.col("comp").alias(name)), id_, "left").withColumn(name, F.coalesce(name, id_))

    rest = labelled(labelled(pool.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    rest = rest.join(best.select("a", "b"), ["a", "b"], "left_anti")
    more = verified(rest, docs, shingle, num, den)
    comps = merged_components(comps, more)
    drop_stash(first, more)

    counts = labelled(members.select("band", "key", "id", "n"), "id", "comp")
    counts = stash(counts, "labelled")
    per = counts.groupBy("key", "comp").agg(F.count("*").alias("k"))
    main = per.groupBy("key").agg(F.count("*").alias("nc"), F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("m"), F.max("k").alias("k")).where("nc > 1").select("key", "main", "m", (F.col("m") - F.col("k")).alias("out"))
    open_ = stash(counts.join(main, "key"), "open")

    few = open_.where(F.col("m") <= small)
    x, y = few.where("comp <> main").select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx")), few.select("key", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"))
    cross = x.join(y, (x.key == y.key) & (x.cx != y.cy) & near(x.nx, y.ny)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pool2 = stash(bayes_pruned(cross.join(stars, ["a", "b"], "left_anti"), reps, hashes, batch, num, den, miss), "pool")
    few_links = verified(pool2, docs, shingle, num, den)

    many = open_.where(F.col("m") > small).withColumn("si", F.ceil(F.col("out") / chunk).cast("int")).withColumn("mi", F.ceil(F.col("m") / chunk).cast("int"))
    large = stash(full_sets(docs, many.select("id").distinct(), shingle).join(reps.select("id", "sig"), "id"), "large")
    spot = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    over = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sides = many.where("comp <> main").withColumn("role", F.lit("s")).withColumn("i", spot("si")).withColumn("j", over("mi"))
    sides = sides.unionByName(many.withColumn("role", F.lit("m")).withColumn("j", spot("mi")).withColumn("i", over("si")))
    steps = least_matches(hashes, batch, num / den, miss)
    blocks = sides.select("band", "key", "i", "j", "role", "id", "comp").join(large, "id").groupBy("band", "key", "i", "j")
    many_links = stash(blocks.applyInPandas(lambda k, g: _strays(g, int(k[0]), rows, steps, num, den), "a long, b long"), "links")
    comps = merged_components(comps, few_links.unionByName(many_links))

    named = stash(labelled(classes, "id", "component_id").select("fp", "component_id"), "named")
    drop_stash(classes, reps, several, members, stars, pool, pool2, counts, open_, large, few_links, many_links, comps)
    out = feats.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(named, "fp", "left")
    cid = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), (cid == F.col("doc_id")).alias("kept"))
