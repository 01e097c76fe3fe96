import itertools
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft import encoding as enc
from weft.encoding import Encoding, EncodingError
from weft.functions.dense import gathered, summed_in_order
from weft.functions.prefix import ordered, running, steps, unrolled
from weft.functions.timing import timed
from weft.operators import decompose as dec
from weft.operators import indirect, kernels
from weft.operators import primitives as prim
from weft.operators.storage import _children
from weft.plans.inspect import plan_nodes
from weft.sources import mtx
from weft.streaming.incremental import streaming_spmv
from weft.tensor import SparseTensor, struct_convert, whole

#: The entries of the 4 x 6 matrix (fixed values).
ROWS = [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0), (3, 0, 5.0), (3, 3, 6.0), (3, 4, 7.0)]
TEXT = "%%MatrixMarket matrix coordinate real general\n% a comment\n4 6 7\n" + "".join(f" {i + 1}  {j + 1}\t{v}\n" for i, j, v in ROWS)

#: Storage arrays of the 4 x 6 matrix (fixed values).
ARRAYS = [
    (enc.COO, {"root.ptr": [0, 7], "L0.crd": [0, 0, 1, 1, 3, 3, 3], "L1.crd": [0, 1, 0, 1, 0, 3, 4], "values": [1, 2, 3, 4, 5, 6, 7]}),
    (enc.CSR, {"L0.ptr": [0, 2, 4, 4, 7], "L1.crd": [0, 1, 0, 1, 0, 3, 4], "values": [1, 2, 3, 4, 5, 6, 7]}),
    (enc.DCSR, {"root.ptr": [0, 3], "L0.crd": [0, 1, 3], "L0.ptr": [0, 2, 4, 7], "L1.crd": [0, 1, 0, 1, 0, 3, 4], "values": [1, 2, 3, 4, 5, 6, 7]}),
    (enc.CSC, {"L0.ptr": [0, 3, 5, 5, 6, 7, 7], "L1.crd": [0, 1, 3, 0, 1, 3, 3], "values": [1, 3, 5, 2, 4, 6, 7]}),
    (enc.DCSC, {"root.ptr": [0, 4], "L0.crd": [0, 1, 3, 4], "L0.ptr": [0, 3, 5, 6, 7], "L1.crd": [0, 1, 3, 0, 1, 3, 3], "values": [1, 3, 5, 2, 4, 6, 7]}),
    (enc.bcsr(2, 3), {"L0.ptr": [0, 1, 3], "L1.crd": [0, 0, 1], "values": [[1, 2, 0, 3, 4, 0], [0, 0, 0, 5, 0, 0], [0, 0, 0, 6, 7, 0]]}),
    (enc.bcsc(2, 3), {"L0.ptr": [0, 2, 3], "L1.crd": [0, 1, 1], "values": [[1, 2, 0, 3, 4, 0], [0, 0, 0, 5, 0, 0], [0, 0, 0, 6, 7, 0]]}),
    (enc.bdcsr(2, 3), {"root.ptr": [0, 2], "L0.crd": [0, 1], "L0.ptr": [0, 1, 3], "L1.crd": [0, 0, 1], "values": [[1, 2, 0, 3, 4, 0], [0, 0, 0, 5, 0, 0], [0, 0, 0, 6, 7, 0]]}),
    (enc.bcoo(2, 3), {"root.ptr": [0, 3], "L0.crd": [0, 1, 1], "L1.crd": [0, 0, 1], "values": [[1, 2, 0, 3, 4, 0], [0, 0, 0, 5, 0, 0], [0, 0, 0, 6, 7, 0]]}),
    (enc.csb(2, 3), {"L1.ptr": [0, 4, 4, 5, 7], "L2.crd": [0, 0, 1, 1, 1, 1, 1], "L3.crd": [0, 1, 0, 1, 0, 0, 1], "values": [1, 2, 3, 4, 5, 6, 7]}),
    (enc.csbcsr(2, 3), {"L2.ptr": [0, 2, 4, 4, 4, 4, 5, 5, 7], "L3.crd": [0, 1, 0, 1, 0, 0, 1], "values": [1, 2, 3, 4, 5, 6, 7]}),
    (enc.csbdcsr(2, 3), {"L1.ptr": [0, 2, 2, 3, 4], "L2.crd": [0, 1, 1, 1], "L2.ptr": [0, 2, 4, 5, 7], "L3.crd": [0, 1, 0, 1, 0, 0, 1], "values": [1, 2, 3, 4, 5, 6, 7]}),
    (enc.DIA1, {"root.ptr": [0, 4], "L0.crd": [-3, -1, 0, 1], "values": [[5, 0, 0, 0, 0, 0], [3, 0, 0, 0, 0, 0], [1, 4, 0, 6, 0, 0], [0, 2, 0, 0, 7, 0]]}),
    (enc.DIA2, {"root.ptr": [0, 4], "L0.crd": [-1, 0, 1, 3], "values": [[2, 0, 0, 7], [1, 4, 0, 6], [0, 3, 0, 0], [0, 0, 0, 5]]}),
    (enc.DIA3, {"root.ptr": [0, 4], "L0.crd": [-1, 0, 1, 3], "values": [[0, 2, 0, 0, 7, 0], [1, 4, 0, 6, 0, 0], [3, 0, 0, 0, 0, 0], [5, 0, 0, 0, 0, 0]]}),
    (enc.DIA4, {"root.ptr": [0, 4], "L0.crd": [-3, -1, 0, 1], "values": [[0, 0, 0, 5], [0, 3, 0, 0], [1, 4, 0, 6], [2, 0, 0, 7]]}),
    (enc.bdia(2), {"L0.ptr": [0, 3, 6], "L1.crd": [-1, 0, 1, -3, 0, 1], "values": [[0, 3], [1, 4], [2, 0], [0, 5], [0, 6], [0, 7]]}),
    (enc.HISPARSE, {"L0.ptr": [0, 2, 4, 4, 7], "values": [(0, 1), (1, 2), (0, 3), (1, 4), (0, 5), (3, 6), (4, 7)]}),
    (enc.ne_csb(2, 3), {"L0.ptr": [0, 1, 3], "L1.crd": [0, 0, 1], "L1.ptr": [0, 4, 5, 7], "L2.crd": [0, 0, 1, 1, 1, 1, 1], "L3.crd": [0, 1, 0, 1, 0, 0, 1], "values": [1, 2, 3, 4, 5, 6, 7]}),
    (enc.cisr(2), {"L0.ptr": [0, 2, 3], "L1.crd": [0, 3, 1], "L1.ptr": [0, 2, 5, 7], "L2.crd": [0, 1, 0, 3, 4, 0, 1], "values": [1, 2, 5, 6, 7, 3, 4]}),
    (enc.ell(), {"root.ptr": [0, 3], "L0.crd": [0, 1, 2], "crd": [[0, 0, 0, 0], [1, 1, 0, 3], [0, 0, 0, 4]], "values": [[1, 3, 0, 5], [2, 4, 0, 6], [0, 0, 0, 7]]}),
    (enc.c2sr(2), {"L1.ptr": [0, 2, 2, 4, 7], "L2.crd": [0, 1, 0, 1, 0, 3, 4], "values": [1, 2, 3, 4, 5, 6, 7]}),
]


@pytest.fixture(scope="module")
def small(spark):
    t = SparseTensor.from_rows(spark, ROWS, (4, 6))
    return SparseTensor(t.df.coalesce(1).cache(), t.shape)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(("e", "want"), ARRAYS, ids=[e.name for e, _ in ARRAYS])
def test_arrays(small, e, want):
    assert small.convert(e).storage().arrays() == want
    assert SparseTensor.from_arrays(want, small.shape, e).check(small)


def test_compression_changes_the_arrays(spark, small):
    """Formats of the same levels that differ in trim or fuse alone store other arrays, and each reads back from its own only."""
    kinds = [enc.COO, enc.CSR, enc.DCSR, enc.HISPARSE]
    stored = [small.convert(e).storage().arrays() for e in kinds]
    assert len({str(sorted(x.items())) for x in stored}) == len(kinds)
    with pytest.raises(KeyError):
        SparseTensor.from_arrays(stored[0], small.shape, enc.CSR)
    wrong = {**stored[1], "L0.ptr": [0, 1, 4, 4, 7]}
    assert not SparseTensor.from_arrays(wrong, small.shape, enc.CSR).check(small)


def test_formats_differ_by_their_options(small):
    assert enc.cisr(2) != enc.cisr(8) and enc.cisr(2) == enc.cisr(2) and enc.HISPARSE != enc.CSR and len({enc.cisr(2), enc.cisr(8)}) == 2
    two, eight = small.convert(enc.cisr(2)), small.convert(enc.cisr(2)).convert(enc.cisr(8))
    assert two.storage().sizes[0] == 2 and eight.storage().sizes[0] == 8
    with pytest.raises(ValueError, match="isn't known"):
        Encoding("slots", ("indirect(j)", "i", "j"), (1, 2), (0,), {"enumerate": True})._inverse() and small.convert(Encoding("slots", ("indirect(j)", "i", "j"), (1, 2), (0,), {"enumerate": True})).storage().ptr(0)
    by_column = small.convert(Encoding("columns", ("indirect(j)", "i", "j"), (0, 2), (0,), {"sum": 1, "enumerate": True}))
    assert rows(by_column.levels(), "l0", "l1", "l2") == sorted([(0, 0, 0), (0, 0, 1), (1, 1, 0), (1, 1, 1), (2, 3, 0), (0, 3, 3), (0, 3, 4)])


def test_hot_rows(spark):
    n = 20_000
    t = SparseTensor(spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS i", "id AS j", "CAST(id AS DOUBLE) AS v"), (n, n))
    for e in (enc.COO, enc.c2sr(16)):
        assert t.convert(e).stored().check(t)
    x = [r.x for r in t.storage().crd(0).orderBy("pos").collect()]
    assert x == sorted(x) and len(x) == n


def test_short_pointer_arrays_spread_in_several_tasks(spark):
    """A few pointers that spread to many entries aren't one task."""
    ptr = spark.range(65).selectExpr("id AS pos", "id * 500 AS x").coalesce(1)
    d = _children(ptr)
    assert d.rdd.getNumPartitions() == 4
    assert d.selectExpr("count(*)", "count(DISTINCT pos)", "sum(int(up = floor(pos / 500)))").first() == (32_000, 32_000, 32_000)


def test_slots_of_many_rows(spark):
    m = 1_000_000
    t = SparseTensor(spark.range(m).selectExpr("id AS i", "id % 5 AS j", "CAST(id + 1 AS DOUBLE) AS v"), (m, 5))
    start = time.perf_counter()
    got = indirect.ell_arrays(t).selectExpr("slot", "chunk", "size(crd) AS n", "aggregate(values, 0D, (a, x) -> a + x) AS s").collect()
    assert time.perf_counter() - start < 60
    assert {r.slot for r in got} == {0} and sum(r.n for r in got) == m and sum(r.s for r in got) == m * (m + 1) / 2


def test_running_over_many_blocks(spark):
    keys = [0, 5, 70_000, 2**33, 2**45 + 1, 2**50]
    d = spark.createDataFrame([(k, 1) for k in keys], "k long, n long")
    for bound in (None, 2**51):
        assert [x for _, x in rows(running(d, "k", "n", "before", bound), "k", "before")] == list(range(len(keys)))


@pytest.mark.parametrize("e", [enc.DCSC, enc.bcsc(2, 3), enc.csbdcsr(2, 3), enc.DIA3, enc.ell(), enc.cisr_plus(2)], ids=lambda e: e.name)
def test_round_trip(spark, e):
    rng = random.Random(5)
    cells = rng.sample(list(itertools.product(range(9), range(7))), 20)
    t = SparseTensor.from_rows(spark, [(i, j, float(rng.randint(1, 9))) for i, j in cells], (9, 7)).convert(e)
    assert SparseTensor.from_levels(t.levels(), t.shape, e).check(t) and t.stored().check(t)
    if e.blocks and e.name != "ELL":
        assert kernels.from_blocks(t.storage().blocks(), t).check(t)


def test_bad_encodings():
    for levels, trim in [(("i", "i"), (0, 1)), (("i floordiv 2", "j"), (0, 1)), (("i + j", "i - j"), (0, 1)), (("i", "j"), (0, 2)), (("i", "j ceildiv 2"), (0, 1)), (("i", "j +"), (0, 1))]:
        with pytest.raises(EncodingError):
            Encoding("x", levels, trim)


def test_mtx(spark, tmp_path, small):
    p = tmp_path / "m.mtx"
    p.write_text(TEXT)
    t = mtx.read_mtx(spark, str(p), strict=True)
    assert t.shape == (4, 6) and t.check(small)
    mtx.write_mtx(t, str(tmp_path / "out"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    (tmp_path / "again.mtx").write_text(text)
    assert mtx.read_mtx(spark, str(tmp_path / "again.mtx"), strict=True).check(small)
    p.write_text(TEXT.replace("general", "symmetric"))
    with pytest.raises(ValueError, match="symmetric"):
        mtx.read_mtx(spark, str(p))
    p.write_text("1 2 1\n1 2 1\n")
    with pytest.raises(ValueError, match="header"):
        mtx.read_mtx(spark, str(p), strict=True)


def test_kernels_agree_in_every_format(spark, small):
    b = spark.createDataFrame([(j, float(j + 1)) for j in range(6)], "j long, b double")
    want = [(0, 5.0), (1, 11.0), (2, 0.0), (3, 64.0)]
    for e in (enc.CSR, enc.DCSC, enc.bcsr(2, 3)):
        t = small.convert(e)
        assert rows(kernels.spmv(t.stored(), b, dense=True), "i", "x") == want
    t = small.convert(enc.DIA1)
    assert rows(kernels.blocks_spmv(t.storage().blocks(), t, b), "i", "x") == [w for w in want if w[0] != 2]


def test_spmv_wide(spark):
    # fixed values: a 4 x 256 matrix and its product with 1..256
    entries = [(1, 1, -1), (1, 127, 2), (1, 128, -3), (1, 255, 4), (2, 2, -5), (2, 254, 6), (3, 3, -7), (4, 1, 8), (4, 2, -9), (4, 4, 10), (4, 99, -11), (4, 127, 12), (4, 128, -13), (4, 129, 14), (4, 250, -15), (4, 254, 16), (4, 256, -17)]
    t = SparseTensor.from_rows(spark, [(i - 1, j - 1, float(v)) for i, j, v in entries], (4, 256))
    b = spark.range(256).selectExpr("id AS j", "CAST(id + 1 AS DOUBLE) AS b")
    assert [x for _, x in rows(kernels.spmv(t, b), "i", "x")] == [889.0, 1514.0, -21.0, -3431.0]


def test_spgemm(spark, small):
    c = kernels.spgemm(small, small.transposed())
    want = [(0, 0, 5), (0, 1, 11), (0, 3, 5), (1, 0, 11), (1, 1, 25), (1, 3, 15), (3, 0, 5), (3, 1, 15), (3, 3, 110)]
    assert rows(c.df, "i", "j", "v") == want and c.shape == (4, 4)
    assert kernels.spgemm_rows(small, small.transposed()) == 3 * 3 + 2 * 2 + 1 + 1
    e = kernels.einsum("ik,kj->ij", small.df.withColumnRenamed("j", "k"), small.transposed().df.withColumnRenamed("i", "k"))
    assert rows(e, "i", "j", "v") == want
    with pytest.raises(ValueError):
        kernels.einsum("ij,kl->il", small.df, small.df)


def test_elementwise_and_reductions(spark, small):
    twice = kernels.ewise_add(small, small)
    assert rows(twice.df, "i", "j", "v") == [(i, j, 2 * v) for i, j, v in ROWS]
    assert rows(kernels.ewise_mul(small, small).df, "i", "j", "v") == [(i, j, v * v) for i, j, v in ROWS]
    assert all(v == 0 for *_, v in rows(kernels.ewise_sub(small, small).df, "i", "j", "v"))
    assert rows(kernels.reduce(small, "product"), "i", "x") == [(0, 2.0), (1, 12.0), (3, 210.0)]
    assert rows(kernels.reduce(small, "sum", along="i"), "j", "x") == [(0, 9.0), (1, 6.0), (3, 6.0), (4, 7.0)]


def test_indirect(small):
    n = indirect.row_counts(small)
    assert rows(n, "i", "nnz") == [(0, 2), (1, 2), (2, 0), (3, 3)]
    assert [b for _, b in rows(indirect.schedule(n, 2), "i", "bucket")] == [0, 1, 0, 0]
    assert [r for _, r in rows(indirect.reorder(n), "i", "rank")] == [1, 2, 3, 0]
    assert [r.crd for r in indirect.ell_arrays(small).orderBy("slot").collect()] == [[0, 0, 0, 0], [1, 1, 0, 3], [0, 0, 0, 4]]
    assert [r["values"] for r in indirect.ell_arrays(small).orderBy("slot").collect()] == [[1, 3, 0, 5], [2, 4, 0, 6], [0, 0, 0, 7]]
    with pytest.raises(ValueError):
        indirect.schedule(n, 2, limit=3)


def greedy(nnz, buckets):
    loads, out = [0] * buckets, []
    for x in nnz:
        b = min(range(buckets), key=lambda k: (loads[k], k))
        loads[b] += x
        out.append(b)
    return out


@pytest.mark.parametrize("buckets", [1, 2, 3, 8])
def test_schedule_by_runs(spark, buckets):
    rng = random.Random(buckets)
    for most, hot in ((3, []), (40, [500, 90]), (7, [1000])):
        nnz = sorted([rng.randint(0, most) for _ in range(300)] + hot, reverse=True)
        want, loads, at = greedy(nnz, buckets), np.zeros(buckets, np.int64), 0
        for x in sorted(set(nnz), reverse=True):
            n = nnz.count(x)
            assert indirect._placed(loads, x, np.arange(n)).tolist() == want[at : at + n]
            loads, at = indirect._after(loads, x, n), at + n
            assert loads.tolist() == [sum(x for x, b in zip(nnz[:at], want[:at]) if b == k) for k in range(buckets)]
    d = spark.createDataFrame([(9 * k, x, k) for k, x in enumerate(nnz)], "i long, nnz long, rank long").repartition(3)
    assert [b for _, b in rows(indirect.schedule(d, buckets, "rank"), "i", "bucket")] == want
    assert [b for _, b in rows(indirect.schedule(d, buckets), "i", "bucket")] == want


@pytest.mark.parametrize("order", ["i", "rank"])
def test_schedule_of_many_rows(spark, order):
    d = spark.range(5_000_001).selectExpr("id AS i", "1L AS nnz", "id AS rank")
    r = indirect.schedule(d, 4, order)
    assert sorted(x[1] for x in r.groupBy("bucket").count().collect()) == [1_250_000] * 3 + [1_250_001]
    assert r.where("bucket <> i % 4").isEmpty()


def test_schedule_in_order_is_balanced(spark, monkeypatch):
    rng = random.Random(3)
    nnz = [rng.choice([0, 1, 1, 2, 30]) for _ in range(500)]
    monkeypatch.setattr(indirect, "ROWS_AT_ONCE", 100)
    d = spark.createDataFrame(list(enumerate(nnz)), "i long, nnz long").repartition(3)
    got = rows(indirect.schedule(d, 4), "i", "bucket")
    assert [i for i, _ in got] == list(range(500))
    assert [b for _, b in got] == [b for k in range(0, 500, 100) for b in greedy(nnz[k : k + 100], 4)]


def test_wide_spmm_rows(spark, small):
    b = spark.createDataFrame([(k, [float(k * 1000 + c) for c in range(1000)]) for k in range(6)], "k long, row array<double>")
    got = {r.i: r.row for r in kernels.spmm_rows(small, b, 1000).collect()}
    assert got == {i: [sum(v * (j * 1000 + c) for x, j, v in ROWS if x == i) for c in range(1000)] for i in (0, 1, 3)}


def test_tns(spark, tmp_path, small):
    p = tmp_path / "m.tns"
    p.write_text("# a comment\n" + "".join(f"{i + 1} {j + 1}  {v}\n" for i, j, v in ROWS) + "\n")
    assert mtx.read_tns(spark, str(p), (4, 6)).check(small) and mtx.read_tns(spark, str(p)).shape == (4, 5)


def test_decompose(small):
    d = dec.window_parts(small, [0.5, 0.75], "block", 2, 2)
    assert rows(d, "i", "j", "part") == [(0, 0, 2), (0, 1, 2), (1, 0, 2), (1, 1, 2), (3, 0, 0), (3, 3, 0), (3, 4, 0)]
    parts = struct_convert(dec.decompose(small, [0.5, 0.75], "block", 2, 2), [enc.CSR, enc.DIA1, enc.csb(2, 3)])
    assert whole([p.stored() for p in parts]).check(small)
    for pair in (dec.decompose_bdia(small, 2, 1.0), dec.decompose_bell(small, 2, 0.5, 1.0)):
        assert whole(pair).check(small)
    with pytest.raises(ValueError):
        dec.window_parts(small, [0.5], "skewed")


def test_primitives(small):
    x = small.levels()
    assert rows(prim.tile_merge(prim.tile_split(x, 1, 3), 1, 3), "l0", "l1", "v") == ROWS
    assert rows(prim.add(prim.sub(x, 1, 0), 1, 0), "l0", "l1", "v") == ROWS
    assert rows(prim.neg(prim.neg(x, 0), 0), "l0", "l1", "v") == ROWS
    assert rows(prim.move(prim.move(x, 1, 0), 1, 0), "l0", "l1", "v") == ROWS
    p = prim.fuse(x, 0)
    assert rows(p, "l0", "n") == [(0, 2), (1, 2), (3, 3)] and rows(prim.separate(p, x, 0), "l0", "l1", "v") == ROWS
    assert rows(prim.grow(p, 4), "l0", "n") == [(0, 2), (1, 2), (2, 0), (3, 3)] and rows(prim.trim(prim.grow(p, 4)), "l0", "n") == rows(p, "l0", "n")
    assert rows(prim.devectorize(prim.vectorize(x, 1, 6), 1), "l0", "l1", "v") == ROWS
    assert prim.pad(x, 1, 6).count() == 18


def test_empty(spark):
    t = SparseTensor.from_rows(spark, [], (3, 2))
    assert t.convert(enc.CSR).storage().arrays() == {"L0.ptr": [0, 0, 0, 0], "L1.crd": [], "values": []}
    assert t.convert(enc.COO).storage().arrays()["root.ptr"] == [0, 0]
    b = spark.createDataFrame([(0, 1.0)], "j long, b double")
    assert rows(kernels.spmv(t, b, dense=True), "i", "x") == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_plan_of_spmv(spark, small):
    b = spark.range(6).selectExpr("id AS j", "CAST(id AS DOUBLE) AS b")
    nodes = plan_nodes(kernels.spmv(small, b))
    assert nodes["BroadcastHashJoin"] == 1 and nodes["Exchange"] <= 1 and nodes["HashAggregate"] == 2
    assert small.convert(enc.COO) is small


def test_streaming_spmv(spark, tmp_path, small):
    small.df.repartition(3).write.parquet(str(tmp_path / "entries"))
    b = spark.range(6).selectExpr("id AS j", "CAST(id + 1 AS DOUBLE) AS b")
    stream = spark.readStream.schema(small.df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "entries"))
    q = streaming_spmv(stream, b).writeStream.outputMode("complete").format("memory").queryName("products").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("products"), "i", "x") == rows(kernels.spmv(small, b), "i", "x")


def test_timed_and_release(small, capsys):
    import sys

    with timed("spmv", sys.stdout):
        small.df.count()
    assert "spmv" in capsys.readouterr().out
    small.copy().release()


def test_dense_pointers_follow_the_entries(spark):
    """6.7e9 dense pointers are read back as runs, and a part of them agrees with the whole array of a small matrix."""
    at = [(0, 0), (1, 2), (3, 199_999), (65_536, 7), (100_000, 100_000), (199_999, 0), (199_999, 199_999)]
    t = SparseTensor.from_rows(spark, [(i, j, float(n + 1)) for n, (i, j) in enumerate(at)], (200_000, 200_000))
    for e in (enc.csb(2, 3), enc.csbdcsr(2, 3)):
        start = time.perf_counter()
        assert t.convert(e).stored().check(t)
        assert time.perf_counter() - start < 120
    runs = t.convert(enc.csb(2, 3)).storage()._ptr(1)
    assert "range(0, 6666700001" not in runs._jdf.queryExecution().toString().lower()


def test_runs_of_dense_sums(spark):
    n = 200_000
    keys = [0, 0, 1, 65_534, 65_535, 65_536, 131_072, 150_000, n - 2]
    runs = steps(spark.createDataFrame([(k, 1) for k in keys], "k long, n long"), "k", "n", n)
    got = np.array(sorted(unrolled(runs).collect()))
    assert (got[:, 0] == np.arange(n)).all() and (got[:, 1] == np.searchsorted(keys, np.arange(n))).all()
    assert runs.where("floor(pos / 65536) <> floor((past - 1) / 65536)").isEmpty() and runs.count() < 20


def test_order_is_kept_over_many_ranges(spark):
    d = spark.range(50_000).selectExpr("pmod(xxhash64(id), 1000) AS a", "id AS b")
    got = sorted(ordered(d, ["a", "b"]).collect())
    assert [r.pos for r in got] == list(range(50_000)) and [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in d.collect())


def test_positions_are_not_broadcast(spark):
    """Positions under the root are many where its pointers are two: the plan must not take them for small."""
    t = SparseTensor(spark.range(20_000).selectExpr("id % 3 AS i", "id AS j", "1D AS v"), (3, 20_000))
    for e in (enc.COO, enc.bcoo(2, 3), enc.DIA1, enc.DIA3):
        plan = t.convert(e).stored().df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan, e.name


def test_dense_blocks_are_not_shuffled(spark, small):
    for e in (enc.bcsr(2, 3), enc.bdia(2), enc.DIA1):
        assert "Exchange" not in small.convert(e).storage().blocks()._jdf.queryExecution().executedPlan().toString()


def test_sums_of_raw_operands(spark):
    a, b = (SparseTensor.from_rows(spark, r, (3, 3)) for r in ([(0, 0, 1.0), (0, 0, 2.0), (1, 2, 5.0)], [(0, 0, 4.0), (2, 1, 1.0), (2, 1, 1.0)]))
    assert rows(kernels.ewise_add(a, b).df, "i", "j", "v") == [(0, 0, 7.0), (1, 2, 5.0), (2, 1, 2.0)]
    assert rows(kernels.ewise_sub(a, b).df, "i", "j", "v") == [(0, 0, -1.0), (1, 2, 5.0), (2, 1, -2.0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_sums_aggregate_once(spark):
    from weft import queries as q

    for name in ("ewise_add", "ewise_sub"):
        n = plan_nodes(q.queries()[name](spark, "/root/testdata/sf0.001"))
        assert n["Exchange"] == 1 and n["HashAggregate"] == 2


def test_products_of_a_hot_key(spark):
    """One key of 10,000 entries is several lists; products are formed in ranges of the keys."""
    m = 10_000
    a = SparseTensor(spark.range(m).selectExpr("id AS i", "0L AS j", "1D AS v").union(spark.range(50).selectExpr("id AS i", "1 + id % 7 AS j", "2D AS v")), (m, 8))
    b = SparseTensor.from_rows(spark, [(k, j, float(k + j + 1)) for k in range(8) for j in range(3)], (8, 3))
    want = {(i, j): j + 1.0 + (2.0 * (1 + i % 7 + j + 1) if i < 50 else 0) for i in range(m) for j in range(3)}
    c = kernels.spgemm(a, b).df
    assert {(r.i, r.j): r.v for r in c.collect()} == want
    assert "rangepartitioning" in c._jdf.queryExecution().executedPlan().toString()
    e = kernels.einsum("ik,kj->ij", a.coalesced().df.withColumnRenamed("j", "k"), b.df.withColumnRenamed("i", "k"))
    assert {(r.i, r.j): r.v for r in e.collect()} == want


@pytest.mark.parametrize("longest", [3, 4096])
def test_products_are_shuffled_as_entries(spark, monkeypatch, longest):
    """One shuffle to the ranges and one of the sums, with keys in several lists and in one; a matrix times its transpose is the same as times any matrix."""
    monkeypatch.setattr(kernels, "_LIST", longest)
    rng = random.Random(3)
    dense = np.zeros((9, 7))
    cells = [(rng.choice((0, 2, 3, 5, 8)), rng.choice((0, 1, 1, 1, 4)), float(rng.randrange(1, 9))) for _ in range(60)]  # duplicates, empty rows and columns
    for i, j, v in cells:
        dense[i, j] += v
    a = SparseTensor.from_rows(spark, cells, (9, 7))
    other = SparseTensor(a.transposed().df, (7, 9))
    as_rows = lambda m: sorted((i, j, m[i, j]) for i, j in zip(*np.nonzero(m)))
    for x, y, want in ((a, a.transposed(), dense @ dense.T), (a.transposed(), a, dense.T @ dense), (a, other, dense @ dense.T), (other, a, dense.T @ dense)):
        c = kernels.spgemm(x, y).df
        n = plan_nodes(c)
        assert n["Exchange"] <= 2 and n["SortMergeJoin"] == 0
        assert rows(c, "i", "j", "v") == as_rows(want)
    e = kernels.einsum("ik,jk->ij", a.df.toDF("i", "k", "v"), a.df.toDF("j", "k", "v"))
    assert plan_nodes(e)["Union"] == 0 and rows(e, "i", "j", "v") == as_rows(dense @ dense.T)
    e = kernels.einsum("ik,kj->ij", a.df.toDF("i", "k", "v"), other.df.toDF("k", "j", "v"))
    assert rows(e, "i", "j", "v") == as_rows(dense @ dense.T)
    e = kernels.einsum("ik,k->i", a.df.toDF("i", "k", "v"), a.df.where("i = 2").select(F.col("j").alias("k"), "v"))
    assert rows(e, "i", "v") == sorted((i, v) for i, v in enumerate(dense @ dense[2]) if v)
    e = kernels.einsum("ik,kj->ij", a.df.toDF("i", "k", "v"), other.df.toDF("k", "j", "v"), combine=lambda x, y: F.least(x, y))
    n = spark.createDataFrame(cells, "i long, k long, v double").join(spark.createDataFrame(cells, "j long, k long, w double"), "k").groupBy("i", "j").agg(F.sum(F.least("v", "w")).alias("v"))
    assert rows(e, "i", "j", "v") == rows(n, "i", "j", "v")


def test_null_keys_meet_nothing(spark):
    a = spark.createDataFrame([(0, None, 1.0), (1, 0, 2.0)], "i long, k long, v double")
    assert rows(kernels.einsum("ik,jk->ij", a, a.toDF("j", "k", "v")), "i", "j", "v") == [(1, 1, 4.0)]
    assert kernels.einsum("ik,jk->ij", a.where("k > 5"), a.toDF("j", "k", "v")).count() == 0


def test_vectorize_shuffles_once(spark):
    x = spark.range(1000).selectExpr("id % 50 AS l0", "id % 8 AS l1", "1D AS v")
    b = prim.vectorize(x, 1, 8)
    assert plan_nodes(b)["Exchange"] == 1
    assert {r.l0: sum(r.block) for r in b.collect()} == dict.fromkeys(range(50), 20.0)


def test_parts_are_marked_once(spark):
    """The parts of a split matrix read the marked entries; none of them joins or counts the windows anew."""
    from weft.operators import decompose as dec

    a = SparseTensor.from_rows(spark, [(i, j, float(i + j + 1)) for i in range(8) for j in range(i + 1)], (8, 8))
    parts = dec.decompose(a, [0.5, 0.75], "block", 2, 2)
    got = sorted((r.i, r.j, r.v) for p in parts for r in p.df.collect())
    assert got == sorted((r.i, r.j, r.v) for r in a.df.collect())
    assert all("Exchange" not in p.df._jdf.queryExecution().toString() for p in parts)  # noqa: SLF001


def test_read_back_follows_the_entries(spark, small):
    """Pointers that don't rise are neither made nor joined with their next ones, and dense blocks aren't filled, when a matrix is read back or its numbers are listed."""
    for e in (enc.CSR, enc.csb(2, 3), enc.csbcsr(2, 3), enc.csbdcsr(2, 3), enc.bcsr(2, 3), enc.bdcsr(2, 3), enc.bdia(2), enc.cisr_plus(2)):
        n = plan_nodes(small.convert(e).stored().df)
        assert n["Window"] == n["Range"] == n["MapInArrow"] == 0, e.name
    assert plan_nodes(small.convert(enc.csbcsr(2, 3)).stored().df)["SortMergeJoin"] == 1 and plan_nodes(small.convert(enc.csbdcsr(2, 3)).stored().df)["SortMergeJoin"] == 2
    assert plan_nodes(small.convert(enc.bcoo(2, 3)).storage().long())["MapInArrow"] == 0


def test_read_back_is_the_same_by_frames(spark):
    """Raw duplicates and levels of many entries: the short way back agrees with the one over all arrays."""
    t = SparseTensor(spark.range(9_000).selectExpr("id % 7 AS i", "id % 4999 AS j", "CAST(id % 5 + 1 AS DOUBLE) AS v"), (8, 5_000))
    for e in (enc.CSR, enc.csbdcsr(2, 3), enc.bdia(8)):
        a = t.convert(e)
        assert SparseTensor.from_arrays(a.storage().frames(), t.shape, e).check(a.stored()), e.name


def test_lists_are_cut_in_order(spark):
    """Keys that end with a batch, go on over several ones or repeat places: sums and lists as by groups, without a group by."""
    d = spark.range(60_000).selectExpr("IF(id < 25000, 0, IF(id < 30000, 1, floor(id / 3))) AS a", "0L AS b", "floor(id / 2) AS at", "1D AS v").repartitionByRange(3, "a", "b").sortWithinPartitions("a", "b", "at")
    got = summed_in_order(d, ["a", "b"], "at", "v", "x")
    assert plan_nodes(got)["HashAggregate"] == plan_nodes(got)["ObjectHashAggregate"] == 0
    want = gathered(d.groupBy("a", "b", "at").agg(F.sum("v").alias("v")), ["a", "b"], "at", {"x": "v"})
    pick = lambda f: {(r.a, r.b): sorted(zip(r._at, r.x)) for r in f.collect()}
    assert pick(got) == pick(want) and got.count() == want.count()
