"""Small helpers that the operators share: stored intermediates, word caches, ranks and components."""

from __future__ import annotations

import weakref

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import new_path

#: Entries a word cache of one Python worker holds before it starts again (about 30 MB for numbers).
CACHE_ENTRIES = 150_000


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path  # noqa: SLF001
    return out


def drop_stash(*frames: DataFrame) -> None:
    """Delete the files of stashes that no later result reads."""
    for df in frames:
        path = getattr(df, "_stash", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)  # noqa: SLF001


#: Word caches of this Python worker with their owners, and the owner that fills them now.
_caches: list[tuple[str, weakref.ref]] = []
_turn = [""]


def cached_for(owner: str, cache: dict) -> None:
    """Enter a cache of an operator (the module that owns it) in this worker's list."""
    _caches.append((owner, weakref.ref(cache)))


def take_turn(owner: str) -> None:
    """Clear the caches of all other operators. A Python worker outlives the stages of a pipeline: without this it holds what every operator before has cached."""
    if _turn[0] == owner:
        return
    _turn[0] = owner
    _caches[:] = [(o, r) for o, r in _caches if r() is not None]
    for o, r in _caches:
        if o != owner and (c := r()):
            c.clear()
    pa.default_memory_pool().release_unused()


class Memo(dict):
    """A bounded cache around a function of one key, for use with map(memo.__getitem__, keys). It belongs to the module of the function; see take_turn."""

    def __init__(self, f, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.f, self.limit, self.owner = f, limit, f.__module__
        cached_for(self.owner, self)

    def __missing__(self, key):
        if _turn[0] != self.owner:
            take_turn(self.owner)
        if len(self) >= self.limit:
            self.clear()
        v = self[key] = self.f(key)
        return v


#: 64-bit hash of a word's bytes; one cache for all operators that hash words.
word_hash = Memo(xxhash.xxh3_64_intdigest)


def cell(v: Column, bits: int = 6) -> Column:
    """Lower end of the sketch cell of a whole number: exact under 2^bits, then 2^(bits - 1) cells an octave (relative error under 2^(1 - bits))."""
    shift = F.greatest(F.length(F.bin(v)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, buckets: int = 64) -> DataFrame:
    """Add `name`: a gapless number from 0 within each combination of `keys`.

    Rows of a key are split over `buckets` by their hash, numbered inside the bucket, and moved up by the rows of the buckets before,
    so that a key with a third of all rows isn't one task. `order` must be unique within a key for a repeatable result.
    """
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, "_bucket", before.alias("_before"))
    rn = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return b.withColumn("_rn", rn).join(counts, [*keys, "_bucket"]).withColumn(name, (F.col("_rn") + F.col("_before")).cast("long")).drop("_bucket", "_rn", "_before")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table (two long columns): (node, comp), comp the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each a group-by over edges that are written to the shared folder. A node's
    neighbours are never gathered: only their minimum is, and the edges are joined to it. Ends when a round leaves the edges as they are.
    """
    spark = links.sparkSession
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stash(e, "edges")
    first = e
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    if mark[0] == 0:
        return spark.createDataFrame([], "node long, comp long")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(small_least, "u").select("v", "m").union(small_least.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        nxt = stash(small, "edges")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if e is not first or now == mark:
            drop_stash(e)
        e = nxt
        if now == mark:
            break
        mark = now
    drop_stash(first)
    return stash(e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct(), "components")


def merged_components(comps: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components (node, comp) of the graph of `comps` with further links: only the links between different components are followed."""

    def named(df: DataFrame, c: str, to: str) -> DataFrame:
        return df.join(comps.select(F.col("node").alias(c), F.col("comp").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))

    ends = stash(named(named(links.select(a, b), a, "_x"), b, "_y"), "ends")
    over = components(ends.where("_x <> _y"), "_x", "_y").toDF("comp", "least")
    every = comps.unionByName(ends.select(F.col(a).alias("node"), F.col("_x").alias("comp"))).unionByName(ends.select(F.col(b).alias("node"), F.col("_y").alias("comp"))).distinct()
    out = stash(every.join(over, "comp", "left").select("node", F.coalesce("least", "comp").alias("comp")), "components")
    drop_stash(ends)
    return out
