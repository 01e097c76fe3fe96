"""Registered queries of the sparse-matrix engine, each with the SQL it is held against.

The matrices are views of the driver's tables: supplier x part quantities (with duplicates), customer x order, order x part, label x vector. Values that are
summed are whole numbers held as doubles, so the order of summation can't change a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding as enc
from .functions.shared import new_path
from .operators import decompose as dec
from .operators import indirect, kernels
from .operators import primitives as prim
from .sources import mtx
from .tensor import SparseTensor, struct_convert, whole


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _shape(spark, d) -> tuple[int, int]:
    """One past the largest supplier and part keys, from the key tables."""
    m = _t(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] + 1
    return m, _t(spark, d, "part").agg(F.max("p_partkey")).first()[0] + 1


def _supp_part(spark, d, value="l_quantity", where=None) -> SparseTensor:
    df = _t(spark, d, "lineitem")
    if where is not None:
        df = df.where(where)
    return SparseTensor.from_table(df, "l_suppkey", "l_partkey", F.col(value).cast("double"), _shape(spark, d))


def _whole(spark, d) -> SparseTensor:
    return _supp_part(spark, d).coalesced()


def _entries(spark, d) -> SparseTensor:
    """The same matrix for formats with dense blocks, which sum duplicates themselves."""
    return _supp_part(spark, d)


def _order_line(spark, d, turned: bool = False) -> SparseTensor:
    """Order x line number quantities (turned: line number x order): a band of eight places, so dense diagonals stay in proportion to the rows."""
    n = _t(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    t = SparseTensor.from_table(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double"), (n, 8)).coalesced()
    return t.transposed() if turned else t


_SP = "SELECT l_suppkey AS i, l_partkey AS j, CAST(l_quantity AS DOUBLE) AS v FROM lineitem"
_SPC = f"SELECT i, j, sum(v) AS v FROM ({_SP}) GROUP BY i, j"
_OL = "SELECT l_orderkey AS i, CAST(l_linenumber AS BIGINT) AS j, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY 1, 2"
_LO = "SELECT CAST(l_linenumber AS BIGINT) AS i, l_orderkey AS j, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY 1, 2"
_M, _N = "(SELECT max(s_suppkey) + 1 FROM supplier)", "(SELECT max(p_partkey) + 1 FROM part)"
_ALL: dict = {}


def _query(sql: str | None):
    def add(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return add


@_query(_SP)
def coo_scan(spark, d):
    return _supp_part(spark, d).df


@_query(_SPC)
def coo_coalesce(spark, d):
    return _supp_part(spark, d).coalesced().df


@_query(f"SELECT a.i, sum(a.v * p.p_size) AS x FROM ({_SP}) a JOIN part p ON p.p_partkey = a.j GROUP BY a.i")
def spmv(spark, d):
    return kernels.spmv(_supp_part(spark, d), _sizes(spark, d))


def _sizes(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("j"), F.col("p_size").cast("double").alias("b"))


@_query(f"SELECT r.range AS i, coalesce(x, 0.0) AS x FROM range({_M}) r LEFT JOIN (SELECT a.i, sum(a.v * p.p_size) AS x FROM ({_SP}) a JOIN part p ON p.p_partkey = a.j GROUP BY a.i) s ON s.i = r.range")
def spmv_dense_out(spark, d):
    return kernels.spmv(_supp_part(spark, d), _sizes(spark, d), dense=True)


_SPMV_SPCL = f"SELECT a.i, sum(a.v * p.p_size) AS x FROM ({_SPC}) a JOIN part p ON p.p_partkey = a.j GROUP BY a.i"


def _stored_spmv(name, e):
    def f(spark, d):
        t = SparseTensor(_supp_part(spark, d).coalesced().df, _shape(spark, d), e)
        return kernels.spmv(t.stored(), _sizes(spark, d))

    f.__name__ = name
    _query(_SPMV_SPCL)(f)


for _e in (enc.CSR, enc.CSC, enc.DCSR, enc.DCSC, enc.bcsr(8, 16), enc.csb(8, 16)):
    _stored_spmv(f"spmv_{_e.name.lower()}", _e)


def _dense_vector(spark, n):
    return spark.range(n).select(F.col("id").alias("j"), (F.col("id") + 1).cast("double").alias("b"))


def _b3(n) -> str:
    return f"SELECT b.range AS k, c.range AS j, CAST(b.range * 1000 + c.range AS DOUBLE) AS b FROM range({n}) b, range(3) c"


def _dense_matrix(spark, n, w=3):
    return spark.range(n).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w - 1).cast("long"))).alias("j")).withColumn("b", (F.col("k") * 1000 + F.col("j")).cast("double"))


@_query(f"SELECT i, sum(v * (j + 1)) AS x FROM ({_OL}) GROUP BY i")
def dia_spmv(spark, d):
    t = _order_line(spark, d).convert(enc.DIA1)
    return kernels.blocks_spmv(t.storage().blocks(), t, _dense_vector(spark, 8))


@_query(f"SELECT a.i, m.j, sum(a.v * m.b) AS x FROM ({_OL}) a JOIN ({_b3(8)}) m ON m.k = a.j GROUP BY a.i, m.j")
def dia_spmm(spark, d):
    t = _order_line(spark, d).convert(enc.DIA3)
    return kernels.blocks_spmm(t.storage().blocks(), t, _dense_matrix(spark, 8))


@_query(f"SELECT i, sum(v * (j + 1)) AS x FROM ({_SPC}) GROUP BY i")
def bdia_spmv(spark, d):
    t = _whole(spark, d)
    dense, rest = dec.decompose_bdia(t, 8, 0.5)
    return kernels.hybrid_spmv([dense.convert(enc.bdia(8)).stored(), rest], _dense_vector(spark, t.shape[1]))


@_query(f"SELECT a.i, m.j, sum(a.v * m.b) AS x FROM ({_SPC}) a JOIN ({_b3(_N)}) m ON m.k = a.j GROUP BY a.i, m.j")
def bdia_spmm(spark, d):
    t = _whole(spark, d)
    dense, rest = dec.decompose_bdia(t, 8, 0.5)
    return kernels.hybrid_spmm([dense.convert(enc.bdia(8)).stored(), rest], _dense_matrix(spark, t.shape[1]))


@_query(f"SELECT a.i, m.j, sum(a.v * m.b) AS x FROM ({_SP}) a JOIN (SELECT p_partkey AS k, c.range AS j, CAST(p_size * (c.range + 1) AS DOUBLE) AS b FROM part, range(4) c) m ON m.k = a.j GROUP BY a.i, m.j")
def spmm(spark, d):
    b = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("j"), "p_size")
    return kernels.spmm(_supp_part(spark, d), b.select("k", "j", (F.col("p_size") * (F.col("j") + 1)).cast("double").alias("b")))


@_query("SELECT CAST(label AS BIGINT) AS i, CAST(k - 1 AS BIGINT) AS j, round(sum(CAST(embedding[k] AS DOUBLE)), 4) AS x FROM embeddings, range(1, 65) t(k) GROUP BY 1, 2")
def spmm_embeddings(spark, d):
    e = _t(spark, d, "embeddings")
    a = SparseTensor.from_table(e, "label", "vec_id", F.lit(1.0), (10, 0))
    r = kernels.spmm_rows(a, e.select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("row")), 64)
    return r.select("i", F.posexplode("row").alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.round("x", 4).alias("x"))


def _cust_order(spark, d):
    return SparseTensor.from_table(_t(spark, d, "orders"), "o_custkey", "o_orderkey", F.lit(1.0), (0, 0))


@_query("SELECT o_custkey AS i, l_partkey AS j, sum(CAST(l_quantity AS DOUBLE)) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def spgemm_cust_part(spark, d):
    b = SparseTensor.from_table(_t(spark, d, "lineitem"), "l_orderkey", "l_partkey", F.col("l_quantity").cast("double"), (0, 0))
    return kernels.spgemm(_cust_order(spark, d), b, enc.CSR).df


@_query(f"SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM ({_SPC}) a JOIN ({_SPC}) b ON a.j = b.j GROUP BY 1, 2")
def spgemm_self(spark, d):
    a = _supp_part(spark, d)
    return kernels.spgemm(a, a.transposed(), enc.CSC).df


@_query(f"SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM ({_SPC}) a JOIN ({_SPC}) b ON a.j = b.j GROUP BY 1, 2")
def einsum_product(spark, d):
    a = _supp_part(spark, d).df  # products of sums are sums of products: duplicates needn't be summed before
    return kernels.einsum("ik,jk->ij", a.toDF("i", "k", "v"), a.toDF("j", "k", "v"))


@_query(f"SELECT p.range AS pos, coalesce((SELECT count(*) FROM ({_SPC}) a WHERE a.i < p.range), 0) AS x FROM range({_M} + 1) p")
def csr_ptr(spark, d):
    return _supp_part(spark, d).coalesced().convert(enc.CSR).storage().ptr(0)


def _dense_ptr(key, n):
    return f"SELECT p.range AS pos, CAST(coalesce(sum(c) OVER (ORDER BY p.range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM range({n} + 1) p LEFT JOIN (SELECT {key} AS k, count(*) AS c FROM ({_SPC}) GROUP BY 1) t ON t.k = p.range"


@_query(_dense_ptr("j", _N))
def csc_ptr(spark, d):
    return _supp_part(spark, d).coalesced().convert(enc.CSC).storage().ptr(0)


@_query(f"SELECT row_number() OVER (ORDER BY j, i) - 1 AS pos, i AS x FROM ({_SPC})")
def csc_crd(spark, d):
    return _supp_part(spark, d).coalesced().convert(enc.CSC).storage().crd(1)


@_query(f"SELECT row_number() OVER (ORDER BY j, i) - 1 AS pos, v FROM ({_SPC})")
def csc_value(spark, d):
    return _supp_part(spark, d).coalesced().convert(enc.CSC).storage().value()


_D = f"SELECT i, count(*) AS c FROM ({_SPC}) GROUP BY i"


@_query(f"SELECT row_number() OVER (ORDER BY i) - 1 AS pos, CAST(coalesce(sum(c) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM ({_D}) UNION ALL SELECT count(*), CAST(coalesce(sum(c), 0) AS BIGINT) FROM ({_D})")
def dcsr_ptr(spark, d):
    return _supp_part(spark, d).coalesced().convert(enc.DCSR).storage().ptr(0)


@_query(f"SELECT i // 8 AS bi, j // 16 AS bj, (i % 8) * 16 + j % 16 AS at, v FROM ({_SPC})")
def bcsr_blocks(spark, d):
    b = _supp_part(spark, d).convert(enc.bcsr(8, 16)).storage().blocks()
    return b.select(F.col("l0").alias("bi"), F.col("l1").alias("bj"), F.posexplode("block").alias("at", "v")).where("v <> 0").withColumn("at", F.col("at").cast("long"))


@_query(
    f"WITH t AS (SELECT (i // 8) * (({_N} + 15) // 16) + j // 16 AS k, count(*) AS c FROM ({_SPC}) GROUP BY 1) "
    f"SELECT p.range AS pos, CAST(coalesce(sum(c) OVER (ORDER BY p.range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM range((({_M} + 7) // 8) * (({_N} + 15) // 16) + 1) p LEFT JOIN t ON t.k = p.range"
)
def csb_ptr(spark, d):
    return _supp_part(spark, d).coalesced().convert(enc.csb(8, 16)).storage().ptr(1)


@_query(f"SELECT j - i AS l0, count(*) AS n, sum(v) AS x FROM ({_SPC}) GROUP BY 1")
def dia_diagonals(spark, d):
    return _whole(spark, d).convert(enc.DIA1).levels().groupBy("l0").agg(F.count("*").alias("n"), F.sum("v").alias("x"))


@_query(f"SELECT i // 8 AS l0, j - i AS l1, count(*) AS n, sum(v) AS x FROM ({_SPC}) GROUP BY 1, 2")
def bdia_diagonals(spark, d):
    return _whole(spark, d).convert(enc.bdia(8)).levels().groupBy("l0", "l1").agg(F.count("*").alias("n"), F.sum("v").alias("x"))


@_query(f"SELECT i % 8 AS l0, count(*) AS n, sum(v) AS x FROM ({_SPC}) GROUP BY 1")
def c2sr_channels(spark, d):
    return _supp_part(spark, d).coalesced().convert(enc.c2sr(8)).levels().groupBy("l0").agg(F.count("*").alias("n"), F.sum("v").alias("x"))


@_query(f"SELECT row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS l0, i AS l1, j AS l2, v FROM ({_SPC})")
def ell_slots(spark, d):
    return _supp_part(spark, d).coalesced().convert(enc.ell()).levels()


@_query(f"SELECT i, nnz, row_number() OVER (ORDER BY nnz DESC, i) - 1 AS rank FROM (SELECT r.range AS i, count(a.v) AS nnz FROM range({_M}) r LEFT JOIN ({_SPC}) a ON a.i = r.range GROUP BY 1)")
def reorder_rank(spark, d):
    return indirect.reorder(indirect.row_counts(_supp_part(spark, d).coalesced()))


def _greedy(order: str) -> str:
    """(i, nnz, bucket) by taking rows in order to the bucket with the fewest entries, in runs of 65,536 rows."""
    n = f"SELECT r.range AS i, count(a.v) AS nnz FROM range({_M}) r LEFT JOIN ({_SPC}) a ON a.i = r.range GROUP BY 1"
    k, run = ("i", "// 65536") if order == "i" else ("row_number() OVER (ORDER BY nnz DESC, i) - 1", "* 0")
    low = "list_position(s.loads, list_min(s.loads))"
    return (
        f"WITH RECURSIVE n AS (SELECT i, nnz, k, k {run} AS run FROM (SELECT *, {k} AS k FROM ({n}))), "
        "s(k, run, bucket, loads) AS (SELECT CAST(min(k) - 1 AS BIGINT), CAST(run AS BIGINT), CAST(0 AS INTEGER), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) FROM n GROUP BY run UNION ALL "
        f"SELECT n.k, s.run, CAST({low} - 1 AS INTEGER), list_transform(s.loads, lambda x, p: CASE WHEN p = {low} THEN x + n.nnz ELSE x END) FROM s JOIN n ON n.k = s.k + 1 AND n.run = s.run) "
        "SELECT n.i, n.nnz, s.bucket FROM s JOIN n ON n.k = s.k"
    )


@_query(_greedy("i"))
def cisr_schedule(spark, d):
    return indirect.schedule(indirect.row_counts(_supp_part(spark, d).coalesced()), 8)


@_query(f"SELECT CAST(g.bucket AS BIGINT) AS l0, a.i AS l1, a.j AS l2, a.v FROM ({_SPC}) a JOIN ({_greedy('rank')}) g ON g.i = a.i")
def cisr_plus_levels(spark, d):
    return _supp_part(spark, d).coalesced().convert(enc.cisr_plus(8)).levels()


@_query(f"SELECT row_number() OVER (PARTITION BY i // 4 ORDER BY j // 4) - 1 AS slot, i // 4 AS block_row, j // 4 AS block_col, sum(v) AS x FROM ({_SPC}) GROUP BY i // 4, j // 4")
def bell_slots(spark, d):
    b = indirect.bell(_supp_part(spark, d), 4, 4)
    return b.select("slot", "block_row", "block_col", F.aggregate("block", F.lit(0.0), lambda a, x: a + x).alias("x"))


@_query(
    f"WITH c AS ({_SPC}), r AS (SELECT i, row_number() OVER (ORDER BY nnz DESC, i) - 1 AS k FROM (SELECT r.range AS i, count(c.v) AS nnz FROM range({_M}) r LEFT JOIN c ON c.i = r.range GROUP BY 1)) "
    'SELECT k // 4 AS "group", k % 4 AS lane, row_number() OVER (PARTITION BY c.i ORDER BY c.j) - 1 AS slot, c.i, c.j, c.v FROM c JOIN r ON r.i = c.i'
)
def serpens_lanes(spark, d):
    return indirect.serpens(_supp_part(spark, d).coalesced(), 4)


def _decompose_sql(keys):
    p = f"SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM ({_SPC})"
    return f"SELECT i, j, v, CAST(CASE WHEN n / m < 0.5 THEN 0 WHEN n / m < 0.75 THEN 1 ELSE 2 END AS INTEGER) AS part FROM (SELECT *, max(n) OVER () AS m FROM ({p}))"


@_query(_decompose_sql("i // 4, j // 8"))
def decompose_block(spark, d):
    return dec.window_parts(_supp_part(spark, d).coalesced(), [0.5, 0.75], "block", 4, 8)


@_query(_decompose_sql("i // 4"))
def decompose_row(spark, d):
    return dec.window_parts(_supp_part(spark, d).coalesced(), [0.5, 0.75], "row", rows=4)


@_query(_decompose_sql("j // 8"))
def decompose_col(spark, d):
    return dec.window_parts(_supp_part(spark, d).coalesced(), [0.5, 0.75], "column", cols=8)


@_query(f"SELECT i, j, v, CAST(CASE WHEN n >= 4 THEN 0 ELSE 1 END AS INTEGER) AS part FROM (SELECT *, count(*) OVER (PARTITION BY i // 8, j - i) AS n FROM ({_SPC}))")
def decompose_bdia(spark, d):
    one, two = dec.decompose_bdia(_whole(spark, d), 8, 0.5)
    return one.df.withColumn("part", F.lit(0)).unionByName(two.df.withColumn("part", F.lit(1)))


@_query(
    f"WITH b AS (SELECT i // 4 AS r, j // 4 AS c, count(*) / 16.0 AS f FROM ({_SPC}) GROUP BY 1, 2), "
    f"k AS (SELECT r, c FROM (SELECT r, c, row_number() OVER (PARTITION BY r ORDER BY c) AS s FROM b WHERE f >= 0.25) WHERE s <= CAST(floor(0.1 * (({_N} + 3) // 4)) AS BIGINT)) "
    f"SELECT a.i, a.j, a.v, CAST(CASE WHEN k.r IS NULL THEN 1 ELSE 0 END AS INTEGER) AS part FROM ({_SPC}) a LEFT JOIN k ON k.r = a.i // 4 AND k.c = a.j // 4"
)
def decompose_bell(spark, d):
    one, two = dec.decompose_bell(_supp_part(spark, d).coalesced(), 4, 0.25, 0.1)
    return one.df.withColumn("part", F.lit(0)).unionByName(two.df.withColumn("part", F.lit(1)))


@_query(_SPC)
def struct_union(spark, d):
    parts = dec.decompose(_supp_part(spark, d).coalesced(), [0.5, 0.75], "block", 4, 8)
    parts = struct_convert(parts, [enc.CSR, enc.bdia(8), enc.csb(4, 8)])
    return whole([p.stored() for p in parts]).df


_FORMATS = (enc.COO, enc.CSR, enc.CSC, enc.DCSR, enc.DCSC, enc.bcsr(4, 4), enc.bcsc(2, 3), enc.bdcsr(2, 3), enc.bcoo(2, 3), enc.csb(2, 3), enc.ne_csb(2, 3), enc.csbcsr(2, 3), enc.csbdcsr(2, 3), enc.DIA1, enc.DIA2, enc.DIA3, enc.DIA4, enc.bdia(8), enc.c2sr(1024), enc.ell(), enc.HISPARSE, enc.cisr(8), enc.cisr_plus(8))


def _source(e) -> tuple:
    """(matrix, its SQL, number of rows, of columns) for a format; dense diagonals take the band of orders and line numbers."""
    orders = "(SELECT max(o_orderkey) + 1 FROM orders)"
    if e.name in ("DIA1", "DIA3"):
        return _order_line, _OL, orders, "8"
    if e.name in ("DIA2", "DIA4"):
        return lambda spark, d: _order_line(spark, d, True), _LO, "8", orders
    return _entries if e.blocks and not e.indirect else _whole, _SPC, _M, _N


def _round_trip(e):
    matrix, sql, _, _ = _source(e)

    def f(spark, d):
        return matrix(spark, d).convert(e).stored().df

    f.__name__ = f"roundtrip_{e.name.lower()}"
    _query(sql)(f)


for _e in _FORMATS:
    _round_trip(_e)


def _storage_sql(src: str, levels: list[str], trim: tuple[int, int], fuse: tuple = (), dense: tuple = (), at: str = "", block: str = "1") -> str:
    """(array, pos, x) of all arrays of a format, from its level expressions; dense: sizes of the levels before the first stored one; at: place inside a block of `block` places."""
    a, b = trim
    names = lambda k: ", ".join(f"l{x}" for x in range(k + 1))

    def same(k):
        while k < b and k not in fuse:
            k += 1
        return k

    def entries(k):
        return f"(SELECT {names(b)}, v FROM e)" if same(k) == b and not at and b not in fuse else f"(SELECT DISTINCT {names(same(k))} FROM e)"

    before = lambda key: f"CAST(coalesce(sum(c) OVER (ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS x"
    out = []
    if a == 0:
        out.append(f"SELECT 'root.ptr' AS \"array\", CAST(0 AS BIGINT) AS pos, CAST(0 AS DOUBLE) AS x UNION ALL SELECT 'root.ptr', 1, CAST(count(*) AS DOUBLE) FROM {entries(0)}")
    else:
        radix = "0"
        for k in range(a):
            radix = f"({radix}) * {dense[k]} + l{k}"
        total = " * ".join(dense[:a])
        out.append(f"SELECT 'L{a - 1}.ptr' AS \"array\", p.range AS pos, {before('p.range')} FROM range({total} + 1) p LEFT JOIN (SELECT {radix} AS k, count(*) AS c FROM {entries(a)} GROUP BY 1) t ON t.k = p.range")
    for k in range(a, b + 1):
        out.append(f"SELECT 'L{k}.crd', row_number() OVER (ORDER BY {names(k)}) - 1, CAST(l{k} AS DOUBLE) FROM {entries(k)}")
        if k < b and k in fuse:
            c = f"(SELECT {names(k)}, count(*) AS c FROM {entries(k + 1)} GROUP BY {names(k)})"
            out.append(f"SELECT 'L{k}.ptr', row_number() OVER (ORDER BY {names(k)}) - 1, {before(names(k))} FROM {c} UNION ALL SELECT 'L{k}.ptr', count(*), CAST(coalesce(sum(c), 0) AS DOUBLE) FROM {c}")
    if at:
        out.append(f"SELECT 'values', (dense_rank() OVER (ORDER BY {names(b)}) - 1) * {block} + place, v FROM (SELECT {names(b)}, place, sum(v) AS v FROM e GROUP BY ALL)")
    else:
        out.append(f"SELECT 'values', row_number() OVER (ORDER BY {names(b)}, v) - 1, v FROM e")
    cols = ", ".join(f"{x} AS l{k}" for k, x in enumerate(levels))
    return f"WITH e AS (SELECT {cols}, {at or 0} AS place, v FROM ({src})) " + " UNION ALL ".join(out)


def _storage(e, levels, dense=(), at="", block="1"):
    matrix, sql, _, _ = _source(e)

    def f(spark, d):
        return matrix(spark, d).convert(e).storage().long()

    f.__name__ = f"storage_{e.name.lower()}"
    _query(_storage_sql(sql, levels, e.trim, e.fuse, dense, at, block))(f)


def _up(n, by):
    return f"(({n} + {by - 1}) // {by})"


_TILE = ["i // 2", "j // 3", "i % 2", "j % 3"]
_IN_TILE = "(i % 2) * 3 + j % 3"
_ORDERS = "(SELECT max(o_orderkey) + 1 FROM orders)"
_storage(enc.COO, ["i", "j"])
_storage(enc.CSR, ["i", "j"], [_M])
_storage(enc.HISPARSE, ["i", "j"], [_M])
_storage(enc.CSC, ["j", "i"], [_N])
_storage(enc.DCSR, ["i", "j"])
_storage(enc.DCSC, ["j", "i"])
_storage(enc.bcsr(2, 3), _TILE[:2], [_up(_M, 2)], _IN_TILE, "6")
_storage(enc.bcsc(2, 3), ["j // 3", "i // 2"], [_up(_N, 3)], _IN_TILE, "6")
_storage(enc.bdcsr(2, 3), _TILE[:2], (), _IN_TILE, "6")
_storage(enc.bcoo(2, 3), _TILE[:2], (), _IN_TILE, "6")
_storage(enc.csb(2, 3), _TILE, [_up(_M, 2), _up(_N, 3)])
_storage(enc.ne_csb(2, 3), _TILE, [_up(_M, 2)])
_storage(enc.csbcsr(2, 3), _TILE, [_up(_M, 2), _up(_N, 3), "2"])
_storage(enc.csbdcsr(2, 3), _TILE, [_up(_M, 2), _up(_N, 3)])
_storage(enc.DIA1, ["j - i"], (), "j", "8")
_storage(enc.DIA2, ["i - j"], (), "i", "8")
_storage(enc.DIA3, ["i - j"], (), "j", "8")
_storage(enc.DIA4, ["j - i"], (), "i", "8")
_storage(enc.bdia(8), ["i // 8", "j - i"], [_up(_M, 8)], "i % 8", "8")
_storage(enc.c2sr(16), ["i % 16", "i // 16", "j"], ["16", _up(_M, 16)])


@_query(_storage_sql(f"SELECT a.i, a.j, a.v, g.bucket FROM ({_SPC}) a JOIN ({_greedy('i')}) g ON g.i = a.i", ["CAST(bucket AS BIGINT)", "i", "j"], (1, 2), (0, 1), ["8"]))
def storage_cisr(spark, d):
    return _whole(spark, d).convert(enc.cisr(8)).storage().long()


_SLOTS = f"(SELECT row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS s, i, j, v FROM ({_SPC}))"


@_query(
    f"SELECT 'root.ptr' AS \"array\", CAST(0 AS BIGINT) AS pos, CAST(0 AS DOUBLE) AS x UNION ALL SELECT 'root.ptr', 1, CAST(max(s) + 1 AS DOUBLE) FROM {_SLOTS} UNION ALL SELECT DISTINCT 'L0.crd', s, CAST(s AS DOUBLE) FROM {_SLOTS} "
    f"UNION ALL SELECT 'crd', s * {_M} + i, CAST(j AS DOUBLE) FROM {_SLOTS} UNION ALL SELECT 'values', s * {_M} + i, v FROM {_SLOTS}"
)
def storage_ell(spark, d):
    return _whole(spark, d).convert(enc.ell()).storage().long()


@_query(_storage_sql("SELECT o_custkey AS i, l_partkey AS j, sum(CAST(l_quantity AS DOUBLE)) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2", ["j", "i"], (1, 1), (0,), [_N]))
def spgemm_csc_storage(spark, d):
    n, m = _shape(spark, d)[1], _t(spark, d, "orders").agg(F.max("o_custkey")).first()[0] + 1
    a = SparseTensor.from_table(_t(spark, d, "orders"), "o_custkey", "o_orderkey", F.lit(1.0), (m, 0))
    b = SparseTensor.from_table(_t(spark, d, "lineitem"), "l_orderkey", "l_partkey", F.col("l_quantity").cast("double"), (0, n))
    return kernels.spgemm(a, b, enc.CSC).storage().long()


@_query(" UNION ALL ".join(f"SELECT '{f}' AS format, {k} AS level, count(*) AS n FROM (SELECT DISTINCT {x} FROM ({_SPC}))" for f, k, x in (("DCSR", 0, "i"), ("DCSR", 1, "i, j"), ("BCOO", 1, "i // 2, j // 3"), ("CSBDCSR", 2, "i // 2, j // 3, i % 2"))))
def storage_sizes(spark, d):
    t = _whole(spark, d)
    got = [(e.name, k, t.convert(e).storage().size(k)) for e, k in ((enc.DCSR, 0), (enc.DCSR, 1), (enc.bcoo(2, 3), 1), (enc.csbdcsr(2, 3), 2))]
    return spark.createDataFrame(got, "format string, level int, n long")


@_query(f"SELECT i % 16 AS l0, CAST(1 AS BIGINT) AS parts, count(*) AS n FROM ({_SPC}) GROUP BY 1")
def partition_c2sr(spark, d):
    laid = _whole(spark, d).convert(enc.c2sr(16)).storage().partitioned()
    return laid.withColumn("p", F.spark_partition_id()).groupBy("l0").agg(F.count_distinct("p").alias("parts"), F.count("*").alias("n"))


@_query(_SPC)
def mtx_file(spark, d):
    path = new_path(spark, "matrix.mtx")
    mtx.write_mtx(_whole(spark, d), path)
    return mtx.read_mtx(spark, path, strict=True).df


@_query(f"SELECT CAST({_M} AS BIGINT) AS m, CAST({_N} AS BIGINT) AS n")
def mtx_dims(spark, d):
    path = new_path(spark, "matrix.mtx")
    mtx.write_mtx(_whole(spark, d), path)
    return spark.createDataFrame([mtx.dims(spark, path)], "m long, n long")


@_query(_SPC)
def tns_file(spark, d):
    path = new_path(spark, "matrix.tns")
    _whole(spark, d).df.select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v").cast("string"))).write.text(path)
    return mtx.read_tns(spark, path).df


_X = f"SELECT i AS l0, j AS l1, v FROM ({_SPC})"


def _steps(name, sql, f):
    """A query of single steps on the level columns of the whole matrix."""

    def g(spark, d):
        return f(_whole(spark, d).convert(enc.COO).levels(), spark, d)

    g.__name__ = name
    _query(sql)(g)


_steps("step_add", f"SELECT l0 + l1 AS l0, l1, v FROM ({_X})", lambda x, *_: prim.add(x, 0, 1))
_steps("step_neg", f"SELECT l0, -l1 AS l1, v FROM ({_X})", lambda x, *_: prim.neg(x, 1))
_steps("step_move", f"SELECT l1 AS l0, l0 AS l1, v FROM ({_X})", lambda x, *_: prim.move(x, 1, 0))
_steps("step_merge", f"SELECT (l0 // 4) * 4 + l1 % 16 AS l0, (l1 // 16) * 4 + l0 % 4 AS l1, v FROM ({_X})", lambda x, *_: prim.tile_merge(prim.tile_merge(prim.swap(prim.tile_split(prim.tile_split(x, 1, 16), 0, 4), 1, 3), 0, 4), 1, 4).select("l0", F.col("l1"), "v"))
_steps("step_fuse", f"SELECT l0, count(*) AS n FROM ({_X}) GROUP BY 1", lambda x, *_: prim.fuse(x, 0))
_steps("step_grow", f"SELECT r.range AS l0, count(x.v) AS n FROM range({_M}) r LEFT JOIN ({_X}) x ON x.l0 = r.range GROUP BY 1", lambda x, spark, d: prim.grow(prim.fuse(x, 0), _shape(spark, d)[0]))
_steps("step_trim", f"SELECT l0, count(*) AS n FROM ({_X}) GROUP BY 1", lambda x, spark, d: prim.trim(prim.grow(prim.fuse(x, 0), _shape(spark, d)[0])))
_steps("step_separate", _X, lambda x, *_: prim.separate(prim.fuse(x, 0), x, 0).select("l0", "l1", "v"))
_steps("step_pack", _X, lambda x, *_: prim.unpack(prim.pack(x, 0, 1)).select("l0", "l1", "v"))


@_query(f"SELECT i AS l0, j AS at, v FROM ({_OL})")
def step_vectorize(spark, d):
    b = prim.vectorize(_order_line(spark, d).levels(), 1, 8)
    return b.select("l0", F.posexplode("block").alias("at", "v")).where("v <> 0").withColumn("at", F.col("at").cast("long"))


@_query(f"SELECT o.i AS l0, r.range AS l1, coalesce(x.v, 0.0) AS v FROM (SELECT DISTINCT i FROM ({_OL})) o CROSS JOIN range(8) r LEFT JOIN ({_OL}) x ON x.i = o.i AND x.j = r.range")
def step_pad(spark, d):
    return prim.pad(_order_line(spark, d).levels(), 1, 8).select("l0", "l1", "v")


@_query(_SPC)
def devectorize_blocks(spark, d):
    t = _whole(spark, d).convert(enc.bcsr(4, 4))
    return kernels.from_blocks(t.storage().blocks(), t).df


@_query(f"SELECT i % 4 AS l0, i // 4 AS l1, j - i AS l2, v FROM ({_SPC})")
def primitive_chain(spark, d):
    x = prim.sub(_whole(spark, d).convert(enc.COO).levels(), 1, 0)
    return prim.swap(prim.tile_split(x, 0, 4), 0, 1)


def _flag(spark, d, f):
    return _supp_part(spark, d, where=F.col("l_returnflag") == f).coalesced()


_FA, _FR = (f"SELECT l_suppkey AS i, l_partkey AS j, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1, 2" for f in "AR")


@_query(f"SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.v, 0) + coalesce(b.v, 0) AS v FROM ({_FA}) a FULL JOIN ({_FR}) b ON a.i = b.i AND a.j = b.j")
def ewise_add(spark, d):
    return kernels.ewise_add(*(_supp_part(spark, d, where=F.col("l_returnflag") == f) for f in "AR")).df


@_query(f"SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.v, 0) - coalesce(b.v, 0) AS v FROM ({_FA}) a FULL JOIN ({_FR}) b ON a.i = b.i AND a.j = b.j")
def ewise_sub(spark, d):
    return kernels.ewise_sub(*(_supp_part(spark, d, where=F.col("l_returnflag") == f) for f in "AR")).df


@_query(f"SELECT a.i, a.j, a.v * b.v AS v FROM ({_FA}) a JOIN ({_FR}) b ON a.i = b.i AND a.j = b.j")
def ewise_mul(spark, d):
    return kernels.ewise_mul(_flag(spark, d, "A"), _flag(spark, d, "R")).df


def _reduction(how, sql, cast):
    def f(spark, d):
        t = SparseTensor.from_table(_t(spark, d, "lineitem"), "l_orderkey", "l_suppkey", F.col("l_linenumber").cast(cast), (0, 0))
        return kernels.reduce(t, how)

    f.__name__ = f"reduce_{how}"
    _query(f"SELECT l_orderkey AS i, {sql} AS x FROM lineitem GROUP BY 1")(f)


_reduction("sum", "sum(CAST(l_linenumber AS DOUBLE))", "double")
_reduction("product", "product(CAST(l_linenumber AS DOUBLE))", "double")
_reduction("and", "bit_and(CAST(l_linenumber AS BIGINT))", "long")
_reduction("or", "bit_or(CAST(l_linenumber AS BIGINT))", "long")
_reduction("xor", "bit_xor(CAST(l_linenumber AS BIGINT))", "long")


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}
