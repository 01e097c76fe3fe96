"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cell, drop_stash, stash
from .common import word_hash as _hash

_U = np.uint64
_UPPER = bytes(range(65, 91))
_MARKS = string.punctuation.encode()

#: Measure: (numerator, denominator, sides). Measures are whole numbers per 1000. Sides "both": a fence below and one above; "above": one above; "above, seen": the same,
#: learnt only from documents where the measure isn't 0, because most documents have none of it.
MEASURES = {
    "marks": ("n_marks", "word_chars", "above"),
    "word_length": ("word_chars", "n_words", "both"),
    "capitals": ("n_capitals", "word_chars", "above"),
    "repeats": ("n_repeat_words", "n_words", "above, seen"),
    "dup_lines": ("n_dup_lines", "n_lines", "above, seen"),
}
#: Documents that the fences of the wider group count for beside a group's own.
PRIOR = 100
#: Spreads (q3 - q1) between a quartile and its fence.
REACH = 4
#: Significant bits of a sketch cell: relative error under 1/256.
BITS = 9


def counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_capitals (A-Z), n_marks (ASCII punctuation) of a text; null: that of an empty one."""
    b = text.encode("utf-8", "surrogatepass") if text else b""
    words = b.split()
    n = len(words)
    chars = len(text or "") - (len(b) - sum(map(len, words)))
    symbols = len(b) - len(b.translate(None, b"#*$%&|<>"))
    lines = [x for x in b.split(b"\n") if x.strip()]
    rep = 0
    if n >= 3:
        h = np.fromiter(map(_hash.__getitem__, words), dtype=_U, count=n)
        w = (h[:-2] * _U(0x9E3779B97F4A7C15) ^ h[1:-1]) * _U(0xBF58476D1CE4E5B9) ^ h[2:]
        _, inv, c = np.unique(w, return_inverse=True, return_counts=True)
        twice = c[inv] > 1
        cover = np.zeros(n, bool)
        for i in range(3):
            cover[i : n - 2 + i] |= twice
        rep = int(cover.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), rep, len(lines), len(b) - len(b.translate(None, _UPPER)), len(b) - len(b.translate(None, _MARKS))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts...) of each document."""

    def run(batches):
        for b in batches:
            rows = np.array([counts(t.as_py()) for t in b.column(3)], np.int64).reshape(b.num_rows, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(rows[:, i]) for i in range(len(_COUNTS))]], ["doc_id", "lang", "source", *_COUNTS])

    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    picked = docs.select(F.col("doc_id").cast("long"), group("lang").alias("lang"), group("source").alias("source"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def _rate(k: str) -> Column:
    n, d, _ = MEASURES[k]
    return F.expr(f"case when {d} > 0 then {n} * 1000 div {d} else 0 end")


def thresholds(m: DataFrame, least_words: int = 50, most_repeats: int = 50, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """(lang, source, lo_<measure>, hi_<measure>...): the fences q1 - reach * (q3 - q1) and q3 + reach * (q3 - q1) of each measure, from a quantile sketch of the group.

    Only documents that pass the base rules are learnt from, and documents with the same counts (copies) once, so a large group of copies doesn't narrow the fences.
    The sketch is a table of cell counts, so sketches merge by adding counts: a group's into its language's, these into that of all. The fences of a group
    of n documents are n parts its own and `prior` parts its language's, and those of a language likewise its own and those of all: no size is a switch.
    A group's cells are bounded by the measure's range, not by its rows.
    """
    once = m.where(~_base_failed(least_words, most_repeats)).select("lang", "source", *_COUNTS).distinct()
    long_ = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _rate(k).alias("v")) for k in MEASURES])).alias("x")
    seen = [k for k, (_, _, sides) in MEASURES.items() if sides.endswith("seen")]
    cells = once.select("lang", "source", long_).where(~F.col("x.measure").isin(seen) | (F.col("x.v") > 0))
    cells = stash(cells.groupBy("lang", "source", F.col("x.measure").alias("measure"), cell(F.col("x.v"), BITS).alias("cell")).agg(F.count("*").alias("c")), "sketches")

    def fences(level: list[str], name: str) -> DataFrame:
        part = Window.partitionBy(*level, "measure")
        merged = cells.groupBy(*level, "measure", "cell").agg(F.sum("c").alias("c"))
        run = merged.withColumn("upto", F.sum("c").over(part.orderBy("cell"))).withColumn("all", F.sum("c").over(part))
        q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("cell")))
        out = run.groupBy(*level, "measure").agg(q(25).alias("q1"), q(75).alias("q3"), F.first("all").alias("n"))
        spread = (F.col("q3") - F.col("q1")) * reach
        return out.select(*level, "measure", F.col("n").alias(f"n_{name}"), (F.col("q1") - spread).alias(f"lo_{name}"), (F.col("q3") + spread).alias(f"hi_{name}"))

    def blend(n: str, own: str, wide: str) -> Column:
        return (F.col(n) * F.col(own) + prior * F.col(wide)) / (F.col(n) + F.lit(float(prior)))

    langs = fences(["lang"], "l").join(fences([], "a"), "measure")
    langs = langs.select("lang", "measure", blend("n_l", "lo_l", "lo_a").alias("lo_w"), blend("n_l", "hi_l", "hi_a").alias("hi_w"))
    groups = fences(["lang", "source"], "g").join(langs, ["lang", "measure"])
    groups = groups.select("lang", "source", "measure", blend("n_g", "lo_g", "lo_w").alias("lo"), blend("n_g", "hi_g", "hi_w").alias("hi"))
    per = [F.max(F.when(F.col("measure") == k, F.col(c))).alias(f"{c}_{k}") for k in MEASURES for c in ("lo", "hi")]
    out = stash(groups.groupBy("lang", "source").agg(*per), "thresholds")
    drop_stash(cells)
    return out


def _outside() -> Column:
    """Names of the measures outside the joined fences; a measure without a fence (nothing in the group to learn it from) is inside."""

    def out(k: str) -> Column:
        v, both = _rate(k), MEASURES[k][2] == "both"
        over = v > F.col(f"hi_{k}")
        return F.when((over | (v < F.col(f"lo_{k}"))) if both else over, F.lit(k))

    return F.array_join(F.array_compact(F.array(*[out(k) for k in MEASURES])), ",")


def _base_failed(least_words: int, most_repeats: int) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def quality_rules(docs: DataFrame, least_words: int = 50, most_repeats: int = 50, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """(doc_id, counts..., base_failed, kept, failed) of each document.

    base_failed: fewer than least_words words, or over most_repeats percent of them in 3-word windows that the text holds twice. Kept: base passed and every measure
    of MEASURES inside the fences of the document's language and source, joined to it. failed names the measures outside.

    Null and empty texts have counts of 0 and fail the base. Null lang or source is a group of its own (''); without the column all rows are one group.
    Empty input gives no rows. Repeated rows are judged alike and count once in the sketches. A group without a document that passes the base has no fences and needs none. Other columns are ignored.
    """
    m = stash(measured(docs), "measured")
    t = thresholds(m, least_words, most_repeats, reach, prior)
    # a plain join: the table of thresholds is broadcast when its files are small enough, else the join is dealt by key and skew is split at run time
    j = m.join(t, ["lang", "source"], "left").withColumn("failed", _outside())
    base = _base_failed(least_words, most_repeats)
    return j.select("doc_id", *_COUNTS, base.alias("base_failed"), (~base & (F.col("failed") == "")).alias("kept"), "failed")


def keep_good(docs: DataFrame, least_words: int = 50, most_repeats: int = 50, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """The documents that quality_rules keeps, with the columns of docs. Texts are measured again on the way rather than shuffled to their verdicts."""
    m = stash(measured(docs), "measured")
    t = thresholds(m, least_words, most_repeats, reach, prior)
    drop_stash(m)
    names = docs.columns
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in names else F.lit("")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), group("lang").alias("lang"), group("source").alias("source"), F.col("text").cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                rows = np.array([counts(x.as_py()) for x in c.column(3)], np.int64).reshape(c.num_rows, len(_COUNTS))
                yield pa.RecordBatch.from_arrays([*c.columns[:3], *[pa.array(rows[:, k]) for k in range(len(_COUNTS))]], ["_row", "lang", "source", *_COUNTS])

    schema = StructType([*marked.schema.fields[:3], *[StructField(c, LongType()) for c in _COUNTS]])
    j = marked.mapInArrow(run, schema).join(t, ["lang", "source"], "left").withColumn("failed", _outside())
    return j.where(~_base_failed(least_words, most_repeats) & (F.col("failed") == "")).select("_row.*")
