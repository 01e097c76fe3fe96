"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cached_for, take_turn


#: Labelled documents that a model holds at most, terms (hashed) and latent dimensions: what is collected and broadcast is bounded by them.
SAMPLE, TERMS, LATENT = 4096, 2048, 32
#: Terms: the first slots are shapes, lengths and repeats, then runs of three bytes in lower case (spaces included), the others words and word pairs. Weights of the parts in the whole.
_FORM, _GRAMS = TERMS // 4, TERMS // 2
GRAMS, WORDS = 0.25, 0.5

_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
_SAME = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Case, digits and marks of a whole word, runs drawn together: 'Wort.' is 'Xx.'."""
    return _SAME.sub(r"\1", _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word))))


def _crc(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass"))


def _slot(term: str) -> int:
    return _crc(term) % _FORM


class _Terms(dict):
    """Words with a row each in a table of their features: slots of shape and length class (doubling from 16 on), and hash. Between texts it starts again once it holds `limit` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit
        self.clear()
        cached_for(__name__, self)

    def clear(self) -> None:
        super().clear()
        self.cols = np.zeros((3, 1024), np.int64)

    def __missing__(self, word: str) -> int:
        take_turn(__name__)
        row = self[word] = len(self)
        if row >= self.cols.shape[1]:
            self.cols = np.concatenate([self.cols, np.zeros_like(self.cols)], axis=1)
        size = len(word) if len(word) < 16 else 12 + len(word).bit_length()
        self.cols[:, row] = _shape_slot[shape(word)], _length_slot[size], _crc(word.lower())
        return row


_shape_slot, _length_slot = Memo(lambda x: _slot("s:" + x), 50_000), Memo(lambda x: _slot(f"l:{x}"))
_terms = _Terms()


def term_weights(text: str | None) -> np.ndarray:
    """Square roots of term shares: shapes and lengths of words, runs of three bytes, words and word pairs themselves, words that repeat the one before or a trigram before, lines seen before, and the length class."""
    words = (text or "").split()
    n = len(words)
    if n:
        if len(_terms) >= _terms.limit:
            _terms.clear()
        rows = np.fromiter(map(_terms.__getitem__, words), np.int64, n)
        forms, lengths, h = _terms.cols[:, rows]
        v = np.bincount(np.concatenate([forms, lengths]), minlength=TERMS) / (2 * n)
        b = np.frombuffer(f" {' '.join(words)} ".lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        runs = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(_GRAMS - _FORM)
        v[_FORM:_GRAMS] += np.bincount(runs, minlength=_GRAMS - _FORM) * (GRAMS / len(runs))
        pairs = (h[:-1] * 0x9E3779B1 + h[1:]) >> 7
        v += np.bincount(_GRAMS + np.concatenate([h, pairs]) % (TERMS - _GRAMS), minlength=TERMS) * (WORDS / (2 * n))
        v[_slot("r:next")] += np.count_nonzero(rows[1:] == rows[:-1]) / n
        if n > 2:
            three = (rows[:-2] * 0x1F123BB5 + rows[1:-1]) * 0x9E3779B1 + rows[2:]
            v[_slot("r:gram")] += (n - 2 - len(np.unique(three))) / n
        lines = text.split("\n")
        v[_slot("r:line")] += (len(lines) - len(set(lines))) / len(lines)
        v[_slot("r:word")] += 1 - len(set(words)) / n
    else:
        v = np.zeros(TERMS)
    v[_slot(f"n:{n.bit_length()}")] += 0.02
    return np.sqrt(v)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    points: np.ndarray
    labels: np.ndarray
    neighbours: int
    #: Rows that each point stands for.
    counts: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Labels of the nearest points, weighted by similarity (to the 8th power); without a similar point the share of label 1."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        s = self.latent(x.astype(np.float32)) @ self.points.T
        k = min(self.neighbours, s.shape[1])
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(s, at, 1)
        w = np.maximum(near, 0).astype(np.float64) ** 8 + 1e-9
        if (self.counts > 1).any():  # the nearest rows, as a point can stand for some
            order = np.argsort(-near, axis=1, kind="stable")
            at, w = np.take_along_axis(at, order, 1), np.take_along_axis(w, order, 1)
            c = self.counts[at]
            w = w * np.clip(self.neighbours - (np.cumsum(c, axis=1) - c), 0, c)
        return np.clip((w * self.labels[at]).sum(axis=1) / w.sum(axis=1), 0, 1)


def _axes(z: np.ndarray, n: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The LATENT strongest directions of rows z that stand for n rows each (right singular vectors), by subspace iteration from a fixed start."""
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(TERMS, 2 * LATENT)))[0].astype(np.float32)
    w = z * np.sqrt(n).astype(np.float32)[:, None]
    for _ in range(rounds if len(z) else 0):
        q = np.linalg.qr(w.T @ (w @ q))[0]
    _, _, turn = np.linalg.svd((w @ q).astype(np.float64) if len(z) else np.eye(2 * LATENT), full_matrices=False)
    axes = (q @ turn.T[:, :LATENT]).astype(np.float32)
    return np.pad(axes, ((0, 0), (0, LATENT - axes.shape[1])))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, neighbours: int = 15) -> Model:
    """Model from labelled documents (doc_id, label 0 or 1; null labels don't count), of at most `sample` with the smallest hashes of doc_id.

    Rows that repeat a labelled doc_id are one point, of their mean term weights, that counts as often as they are. They are added up in the tasks, then over tasks.
    The points' term weights come to the driver (at most sample x TERMS numbers) for inverse document frequencies and a singular value decomposition.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                at = sums.setdefault((i, y), [0, np.zeros(TERMS)])
                at[0] += 1
                at[1] += term_weights(t.as_py())
        if sums:
            ids, ys = zip(*sums)
            ns, vs = zip(*sums.values())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(ns, pa.int64()), pa.array([v.tobytes() for v in vs], pa.binary())], ["_id", "_y", "n", "v"])

    def add(t):
        n = sum(t.column("n").to_pylist())
        v = sum(np.frombuffer(x.as_py(), np.float64) for x in t.column("v")) / n
        return pa.table([t.column("_id")[:1], t.column("_y")[:1], pa.array([n], pa.int64()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["_id", "_y", "n", "v"])

    schema = "_id long, _y int, n long, v binary"
    rows = sorted(texts.join(F.broadcast(picked), "_id").select("_id", "_y", "_text").mapInArrow(run, schema).groupBy("_id", "_y").applyInArrow(add, schema).collect())
    x = np.array([np.frombuffer(r["v"], np.float32) for r in rows], np.float32).reshape(len(rows), TERMS)
    y, n = np.array([r["_y"] for r in rows], np.float64), np.array([r["n"] for r in rows], np.int64)
    idf = np.log((1 + n.sum()) / (1 + n @ (x > 0))).astype(np.float32) + 1
    m = Model(idf, _axes(x * idf, n), np.zeros((0, LATENT), np.float32), y, neighbours, n)
    m.points = m.latent(x)
    return m


def score(docs: DataFrame, model: Model, block: int = 1024) -> DataFrame:
    """(doc_id, score, predicted) of each document: exact cosines to all points, in blocks."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, block):
                c = b.slice(i, block)
                s = held.value.score(np.array([term_weights(t.as_py()) for t in c.column(1)], np.float32))
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_likely(docs: DataFrame, model: Model, least: float = 0.5, block: int = 1024) -> DataFrame:
    """The documents with a score of at least `least`, with the columns of docs; scored and filtered in one pass."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, block):
                c = b.slice(i, block)
                s = held.value.score(np.array([term_weights(t.as_py()) for t in c.column(at)], np.float32))
                yield c.filter(pa.array(s >= least))

    return docs.mapInArrow(run, docs.schema)


def crc_of_id(c: str = "doc_id"):
    return F.crc32(F.col(c).cast("long").cast("string").cast("binary"))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE, neighbours: int = 15) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document, learnt from labels of documents with crc32(doc_id as text) mod folds other than `held`.

    Scores use the text alone. Null or empty text: the votes of the nearest short documents. No usable label: 0.5 for all. A null doc_id is not held
    out. Repeated rows are scored alike; rows that repeat a labelled doc_id count each. Other columns are ignored.
    """
    model = fit(docs, labels.where(crc_of_id() % folds != held), sample=sample, neighbours=neighbours)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(crc_of_id() % folds == held, F.lit(False)).alias("held_out"), "score", "predicted")
