"""Matrix Market and .tns text files, read and written by Spark, from any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tensor import SparseTensor

HEADER = "%%MatrixMarket matrix coordinate"


def _fields(line) -> F.Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def read_mtx(spark: SparkSession, path: str, strict: bool = False) -> SparseTensor:
    """A coordinate file: comments, a line with rows, columns and entries, then entries (1-based). Duplicates and zeros stay; a pattern file has values of 1.

    strict wants the header and the number of entries right. Symmetric and complex matrices raise ValueError.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")).alias("at"))
    head = lines.where(F.col("value").startswith("%%")).orderBy("at").limit(1).collect()
    words = head[0]["value"].lower().split() if head else []
    if strict and (not head or not head[0]["value"].startswith(HEADER)):
        raise ValueError(f"{path}: the header isn't {HEADER!r}")
    if "complex" in words or any(w in words for w in ("symmetric", "hermitian", "skew-symmetric")):
        raise ValueError(f"{path}: {' '.join(words[3:])} matrices aren't supported")
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = body.orderBy("at").limit(1).collect()
    if not first:
        raise ValueError(f"{path}: no size line")
    m, n, nnz = map(int, first[0]["value"].split())
    at = first[0]["at"]
    size_line = (F.col("at.f") == at["f"]) & (F.col("at.b") == at["b"]) & (F.col("at.n") == at["n"])
    f = body.where(~size_line).select(_fields(F.col("value")).alias("x"))
    v = F.when(F.size("x") > 2, F.get("x", F.lit(2)).cast("double")).otherwise(F.lit(1.0))
    df = f.select((F.col("x")[0].cast("long") - 1).alias("i"), (F.col("x")[1].cast("long") - 1).alias("j"), v.alias("v"))
    if strict and (got := df.count()) != nnz:
        raise ValueError(f"{path}: {got} entries, the size line says {nnz}")
    return SparseTensor(df, (m, n))


def dims(spark: SparkSession, path: str) -> tuple[int, int]:
    return read_mtx(spark, path).shape


def read_tns(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> SparseTensor:
    """Lines 'i j v' (1-based) without a header."""
    f = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(_fields(F.col("value")).alias("x"))
    return SparseTensor.from_table(f.select((F.col("x")[0].cast("long") - 1).alias("i"), (F.col("x")[1].cast("long") - 1).alias("j"), F.col("x")[2].cast("double").alias("v")), "i", "j", "v", shape)


def write_mtx(tensor: SparseTensor, path: str) -> None:
    """A folder of text parts that, read in order, are one Matrix Market file in row-major order."""
    spark = tensor.df.sparkSession
    n = tensor.df.count()
    top = spark.createDataFrame([(-2, 0, f"{HEADER} real general"), (-1, 0, f"{tensor.shape[0]} {tensor.shape[1]} {n}")], "i long, j long, value string")
    rows = tensor.df.select("i", "j", F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v").cast("double").cast("string")).alias("value"))
    top.unionByName(rows).orderBy("i", "j").select("value").write.text(path)


def read_table(df: DataFrame, row: str, col: str, value: str) -> SparseTensor:
    return SparseTensor.from_table(df, row, col, value)
