"""Sparse linear algebra as joins and aggregations. The format of an operand changes only how results are laid out, never the plan's meaning."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..encoding import COO, Encoding
from ..functions.shared import kept
from ..tensor import SparseTensor, whole

#: Entries of one key that are gathered in a row before products are formed.
_LIST = 4096
#: Entries in a range of contracted keys.
_RANGE = 1 << 20

REDUCTIONS = {"sum": F.sum, "product": F.product, "and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor}


def spmv(a: SparseTensor, b: DataFrame, dense: bool = False) -> DataFrame:
    """(i, x): x(i) = sum of A(i, j) * b(j), b as (j, b). Spark broadcasts b by its measured size, else joins by key. dense: rows without entries give 0."""
    x = a.df.join(b.select("j", "b"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("b")).alias("x"))
    if not dense:
        return x
    every = a.df.sparkSession.range(a.shape[0]).select(F.col("id").alias("i"))
    return every.join(x, "i", "left").select("i", F.coalesce("x", F.lit(0.0)).alias("x"))


def spmm(a: SparseTensor, b: DataFrame) -> DataFrame:
    """(i, j, x): A times a dense matrix in long form (k, j, b)."""
    return a.df.withColumnRenamed("j", "k").join(b.select("k", "j", "b"), "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("b")).alias("x"))


def spmm_rows(a: SparseTensor, b: DataFrame, width: int, chunk: int = 32) -> DataFrame:
    """(i, row): the same with rows of B as arrays (k, row) of `width` numbers, at any width: rows are cut into chunks of columns, entries are joined once, and each row of the
    aggregate sums one chunk, so the plan doesn't grow with the width."""
    chunk = min(chunk, max(width, 1))
    parts = F.transform(F.sequence(F.lit(0), F.lit(max(width - 1, 0) // chunk)), lambda c: F.struct(c.alias("c"), F.slice("row", c * chunk + 1, chunk).alias("x")))
    d = a.df.withColumnRenamed("j", "k").join(b.select("k", parts.alias("_parts")), "k").select("i", "v", F.explode("_parts").alias("_p"))
    each = d.groupBy("i", F.col("_p.c").alias("c")).agg(*[F.sum(F.col("v") * F.get("_p.x", F.lit(n))).alias(f"_{n}") for n in range(chunk)])
    rows = each.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("c", F.array(*[f"_{n}" for n in range(chunk)]).alias("x")))).alias("p"))
    return rows.select("i", F.slice(F.flatten(F.transform("p", lambda x: x["x"])), 1, width).alias("row"))


def spgemm(a: SparseTensor, b: SparseTensor, out: Encoding = COO) -> SparseTensor:
    """C = A * B. Duplicates are summed first, which only shrinks the product; stored zeros of the result stay. Of a matrix and its transpose half of the products are formed."""
    x = a.df.select(F.col("j").alias("k"), "i", F.col("v").alias("av"))
    y = b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("bv"))
    c = _summed_products(x, y, ["k"], ["i", "j"], b.turned is a or a.turned is b)
    return SparseTensor(c.select("i", "j", "v"), (a.shape[0], b.shape[1]), out)


def _summed_products(x: DataFrame, y: DataFrame, on: list[str], out: list[str], same: bool) -> DataFrame:
    """(out, v): sums of the products of x and y (on, index columns, value). same: both hold the same entries with one index each, so the result is symmetric: one triangle
    is summed and the other one copied from it."""
    xv, yv = x.columns[-1], y.columns[-1]
    d, v = _products(x, y, on, (xv, yv), same), F.sum(F.col(xv) * F.col(yv)).alias("v")
    if not same:
        return d.groupBy(*out).agg(v)
    i, j = (F.col(c) for c in out)
    c = d.select(F.least(i, j).alias(out[0]), F.greatest(i, j).alias(out[1]), xv, yv).groupBy(*out).agg(v)
    one, two = F.struct(*out), F.struct(j.alias(out[0]), i.alias(out[1]))
    return c.select(F.explode(F.when(i == j, F.array(one)).otherwise(F.array(one, two))).alias("_at"), "v").select("_at.*", "v")


def _products(x: DataFrame, y: DataFrame, on: list[str], sums: tuple = (), same: bool = False) -> DataFrame:
    """The join of x and y, laid out for a sum over `on`: each task holds the products of a range of `on`, so that equal places of the result, which neighbouring keys
    tend to share, meet before they are shuffled.

    The entries of both sides are shuffled to the ranges once and gathered there in two lists for each key: never a product, and no list. A key of more than _LIST entries is
    cut into parts, and its pairs of parts (_p, _q) go to the ranges as keys do, so no key is one row or one task. sums: the value columns, where equal entries of a side are
    to be summed first. same: x and y (on, index, value) hold the same entries; they are sent once, and of two products that differ in their order one is formed.
    """
    xs, ys = ([c for c in d.columns if c not in on] for d in (x, y))
    x, y = (d.where(" AND ".join(f"`{c}` IS NOT NULL" for c in on)) for d in (x, y))
    many, ranges = _parts(x, None if same else y, on)
    cut, tag, cells = [*on, "_p", "_q"], "_own" if same else "_left", xs if same else xs + ys
    part = lambda cols, n: F.pmod(F.xxhash64(*([c for c in cols if c not in sums] or cols)), F.coalesce(n, F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    if many is None:
        cut = on
    else:
        x, y = (d.join(many, on, "left") for d in (x, y))
    if same:
        d = x
        if many is not None:
            d = d.select(*on, part(xs, F.col("_ps")).alias("_own"), each(F.col("_ps")).alias("_to"), *xs)
            d = d.select(*on, F.least("_own", "_to").alias("_p"), F.greatest("_own", "_to").alias("_q"), "_own", *xs)
    else:
        if many is not None:
            x = x.select(*on, part(xs, F.col("_ps")).alias("_p"), each(F.col("_qs")).alias("_q"), *xs)
            y = y.select(*on, each(F.col("_ps")).alias("_p"), part(ys, F.col("_qs")).alias("_q"), *ys)
        d = x.withColumn("_left", F.lit(True)).unionByName(y.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    d = d.repartitionByRange(ranges, *cut)
    if sums:
        tags = [tag] if tag in d.columns else []
        d = d.groupBy(*cut, *tags, *[c for c in cells if c not in sums]).agg(*[F.sum(c).alias(c) for c in cells if c in sums])
    left, right = F.struct(*xs), F.struct(*[F.col(a).alias(b) for a, b in zip(xs, ys)]) if same else F.struct(*ys)
    if same and many is None:
        d = d.groupBy(*cut).agg(F.collect_list(left).alias("_x")).withColumn("_y", F.transform("_x", lambda e: F.struct(*[e[a].alias(b) for a, b in zip(xs, ys)])))
    else:
        ours, theirs = (F.col(tag) == F.col("_p"), F.col(tag) == F.col("_q")) if same else (F.col(tag), ~F.col(tag))
        d = d.groupBy(*cut).agg(F.collect_list(F.when(ours, left)).alias("_x"), F.collect_list(F.when(theirs, right)).alias("_y"))
    d = d.select(*cut, F.explode("_x").alias("_x"), "_y").select(*cut, "_x", F.explode("_y").alias("_y"))
    if same:  # inside a part, pairs whose indices rise; of two parts, all
        rising = F.col(f"_x.{xs[0]}") <= F.col(f"_y.{ys[0]}")
        d = d.where(rising if many is None else (F.col("_p") < F.col("_q")) | rising)
    return d.select(*on, *[F.col(f"_x.{c}").alias(c) for c in xs], *[F.col(f"_y.{c}").alias(c) for c in ys])


def _parts(x: DataFrame, y: DataFrame | None, on: list[str]) -> tuple[DataFrame | None, int]:
    """((on, _ps, _qs), ranges): how many parts the keys with more than _LIST entries on a side have (None: there are no such keys), and how many ranges to form: by the number
    of entries, and with few entries as many as cores. y None: it is as x. Entries are counted in one pass, and only keys with parts are kept."""
    count = lambda d, a, b: d.select(*on, F.lit(a).cast("long").alias("_a"), F.lit(b).cast("long").alias("_b"))
    ones = count(x, 1, 1) if y is None else count(x, 1, 0).unionByName(count(y, 0, 1))
    seen, cut = Observation(), (F.least("_a", "_b") > 0) & (F.greatest("_a", "_b") > _LIST)
    n = ones.groupBy(*on).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    n = n.observe(seen, F.sum(F.col("_a") + F.col("_b") * int(y is not None)).alias("entries"), F.count(F.when(cut, 1)).alias("keys"))
    many = kept(n.where(cut).select(*on, F.ceil(F.col("_a") / _LIST).cast("int").alias("_ps"), F.ceil(F.col("_b") / _LIST).cast("int").alias("_qs")), "parts")
    entries = seen.get["entries"] or 0
    few = min(x.sparkSession.sparkContext.defaultParallelism, entries // _LIST + 1)
    return many if seen.get["keys"] else None, max(entries // _RANGE + 1, few)


def spgemm_rows(a: SparseTensor, b: SparseTensor) -> int:
    """Rows that the join of spgemm makes: sum over k of entries in column k of A times entries in row k of B. Ask before a large product."""
    x = a.coalesced().df.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("p"))
    y = b.coalesced().df.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("q"))
    return x.join(y, "k").agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0))).first()[0]


def ewise_add(a: SparseTensor, b: SparseTensor, sign: int = 1) -> SparseTensor:
    """A + B (sign -1: A - B) on the union of their entries, duplicates summed: neither operand needs to be coalesced before."""
    d = a.df.select("i", "j", "v").unionByName(b.df.select("i", "j", (F.col("v") * sign).alias("v")))
    return SparseTensor(d.groupBy("i", "j").agg(F.sum("v").alias("v")), a.shape, a.encoding)


def ewise_sub(a: SparseTensor, b: SparseTensor) -> SparseTensor:
    return ewise_add(a, b, -1)


def ewise_mul(a: SparseTensor, b: SparseTensor) -> SparseTensor:
    """A times B place by place, on the intersection of their entries (duplicates summed first)."""
    x, y = a.coalesced().df, b.coalesced().df.withColumnRenamed("v", "w")
    return SparseTensor(x.join(y, ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v")), a.shape, a.encoding)


def reduce(a: SparseTensor, how: str, along: str = "j", value: Column | None = None) -> DataFrame:
    """(i or j, x): reduce the stored entries along an index by sum, product, and, or, xor (the last three on whole numbers)."""
    keep = "i" if along == "j" else "j"
    return a.df.groupBy(keep).agg(REDUCTIONS[how](value if value is not None else F.col("v")).alias("x"))


def einsum(expression: str, *operands: DataFrame, combine=None, how: str = "sum") -> DataFrame:
    """A general product such as 'ij,jk->ik'. Operands have a column for each index and v. A product of operands is an inner join on shared indices, then
    a reduction over those that the result doesn't name; 'ij+ij->ij' adds terms on the union of their entries. combine takes the value columns. Of 'ik,jk->ij' with one
    DataFrame under two sets of names, half of the products are formed."""
    left, out = expression.replace(" ", "").split("->")
    if "+" in left:
        terms = left.split("+")
        if any(set(t) != set(out) for t in terms):
            raise ValueError("terms of a sum need the indices of the result")
        d = fold(DataFrame.unionByName, [x.select(*out, "v") for x in operands])
        return d.groupBy(*out).agg(F.sum("v").alias("v"))
    names = left.split(",")
    if len(names) != len(operands):
        raise ValueError("as many operands as terms")
    if missing := set(out) - set(left):
        raise ValueError(f"no operand has {sorted(missing)}")
    have = set(names[0])
    for n in names[1:]:
        if not have & set(n):
            raise ValueError("an operand shares no index with those before it")
        have |= set(n)
    parts = [x.select(*n, F.col("v").alias(f"_v{k}")) for k, (n, x) in enumerate(zip(names, operands))]
    if len(parts) == 2 and combine is None and how == "sum" and not (on := set(names[0]) & set(names[1])) <= set(out) and all(p.dtypes[-1][1] == "double" for p in parts):
        on, ends = sorted(on), [[c for c in n if c not in on] for n in names]
        x, y = (p.select(*on, *e, p.columns[-1]) for p, e in zip(parts, ends))
        return _summed_products(x, y, on, list(out), all(len(e) == 1 for e in ends) and set(out) == set(ends[0] + ends[1]) and x.sameSemantics(y))
    d, have = parts[0], set(names[0])
    for p, n in zip(parts[1:], names[1:]):
        on = sorted(have & set(n))
        d, have = d.join(p, on) if set(on) <= set(out) else _products(d, p, on), have | set(n)
    values = [F.col(f"_v{k}") for k in range(len(parts))]
    v = combine(*values) if combine else fold(lambda x, y: x * y, values)
    return d.groupBy(*out).agg(REDUCTIONS[how](v).alias("v"))


def hybrid_spmv(parts: list[SparseTensor], b: DataFrame, dense: bool = False) -> DataFrame:
    """SpMV of a split matrix: the parts, whatever their formats, are one matrix."""
    return spmv(whole(parts), b, dense)


def hybrid_spmm(parts: list[SparseTensor], b: DataFrame) -> DataFrame:
    return spmm(whole(parts), b)


def blocks_spmv(blocks: DataFrame, tensor: SparseTensor, b: DataFrame) -> DataFrame:
    """SpMV straight from stored dense blocks (pos, l0.., block) of `tensor`'s format, as DIA and block formats keep them; zeros in blocks are skipped."""
    return spmv(from_blocks(blocks, tensor), b)


def blocks_spmm(blocks: DataFrame, tensor: SparseTensor, b: DataFrame) -> DataFrame:
    return spmm(from_blocks(blocks, tensor), b)


def from_blocks(blocks: DataFrame, tensor: SparseTensor) -> SparseTensor:
    """Coordinates of stored blocks; stored zeros can't be told from padding and are lost."""
    e, ranges = tensor.encoding, tensor.encoding.ranges(tensor.shape)
    d = blocks.select("*", F.posexplode("block").alias("_at", "v")).where("v <> 0")
    rest = F.col("_at").cast("long")
    for k in reversed(range(e.trim[1] + 1, len(e.levels))):
        lo, size = ranges[k]
        d = d.withColumn(f"l{k}", F.pmod(rest, F.lit(size).cast("long")) + lo)
        rest = F.floor(rest / size)
    return SparseTensor.from_levels(d, tensor.shape, e)
