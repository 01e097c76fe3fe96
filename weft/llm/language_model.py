"""Text scores by a hashed maximum-entropy model with a class-factored softmax, beside add-one unigram scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cell, drop_stash, stash
from .common import word_hash as _hash

_U = np.uint64
#: The end of a text; no word holds a line feed.
END = _U(xxhash.xxh3_64_intdigest(b"\n"))
#: Words with an output of their own, in CLASSES classes by falling frequency; class 0 holds all other words. Buckets of the hashed features.
WORDS, CLASSES, NEAR, FAR, COARSE = 1024, 32, 64, 64, 8
_PER = WORDS // CLASSES
#: Most frequent words whose counts are broadcast (16 bytes each, 4 MB); counts of the others are joined.
HELD = 1 << 18
_FLUSH = 1_000_000
#: Distinct words that share a context bucket beside the held words, which have a context each.
SHARE = 64
#: Weight of the coarser distribution in each context of other words, in tokens.
PULL = 200.0
#: Tail tokens that go out together, and those of one part of the words. Tokens of the documents that are looked at together.
_CHUNK, _PART, _BLOCK = 1 << 18, 500_000, 200_000


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the words (no ASCII white space; A-Z in lower case) and of the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.empty(len(words) + 1, _U)
    h[:-1] = np.fromiter(map(_hash.__getitem__, words), dtype=_U, count=len(words))
    h[-1] = END
    return h


def _contexts(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed previous word and the one before it, of each token; 0 before the start of a text."""
    b = ((h >> _U(40)) % _U(NEAR - 1)).astype(np.int64) + 1
    p1, p2 = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    p1[1:], p2[2:] = b[:-1], b[:-2]
    p1[starts] = p2[starts] = 0
    second = starts + 1
    p2[second[second < len(h)]] = 0
    return p1, p2


def _counted(batches):
    """(h, c) of the texts, in blocks of about _FLUSH tokens."""
    held, n = [], 0

    def flush():
        all_of = np.concatenate(held)
        held.clear()
        h, c = np.unique(all_of, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    for b in batches:
        for t in b.column(0):
            held.append(tokens(t.as_py()))
            n += len(held[-1])
            if n >= _FLUSH:
                yield flush()
                n = 0
    if held:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): tokens of all documents by hash. Counted in blocks inside the tasks, then added up."""
    return docs.select(F.col("text").cast("string")).mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the most frequent tokens, sorted by hash, with their rank if they have an output (else WORDS), and totals over all."""

    h: np.ndarray
    c: np.ndarray
    rank: np.ndarray
    total: int
    distinct: int
    rare: float

    @property
    def contexts(self) -> int:
        """Number of contexts: held words, the start of a text, and buckets in proportion to the other distinct words."""
        return len(self.h) + 1 + max(64, (self.distinct - len(self.h)) // SHARE)

    def before(self, h: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of each token: the last word, and the one before it."""
        k = len(self.h)
        b = np.where(rows >= 0, rows, k + 1 + ((h >> _U(20)) % _U(self.contexts - k - 1)).astype(np.int64))
        c1, c2 = np.full(len(h), k), np.full(len(h), k)
        c1[1:], c2[2:] = b[:-1], b[:-2]
        c1[starts] = c2[starts] = k
        second = starts + 1
        c2[second[second < len(h)]] = k
        return c1, c2

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each token, -1 for those that aren't held."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)

    def ranks(self, rows: np.ndarray) -> np.ndarray:
        return np.where(rows >= 0, self.rank[np.maximum(rows, 0)], WORDS) if len(self.h) else np.full(len(rows), WORDS)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count that at most HELD words reach, from a histogram of counts: no sort, and nothing but these words leaves the tasks
    least, n = None, 0
    for r in sorted(counts.groupBy(cell(F.col("c")).alias("cell")).agg(F.count("*").alias("n")).collect(), reverse=True):
        n += r["n"]
        if n > HELD:
            break
        least = r["cell"]
    t = counts.where(F.lit(False) if least is None else F.col("c") >= least).toArrow()
    h, c = t.column("h").to_numpy().view(_U), t.column("c").to_numpy()
    order = np.lexsort((h, -c))  # falling frequency
    rank = np.empty(len(h), np.int64)
    rank[order] = np.minimum(np.arange(len(h)), WORDS)
    rare = total + distinct + 1 - float((c[rank < WORDS] + 1).sum())
    by = np.argsort(h)
    return Vocabulary(h[by], c[by], rank[by], total, distinct, rare)


def _blocks(batches, column: int, size: int = 256):
    """(rows, hashes, starts, lengths) of up to `size` documents at a time, fewer where they come to _BLOCK tokens."""
    for b in batches:
        first, each, total = 0, [], 0
        for i, t in enumerate(b.column(column)):
            each.append(tokens(t.as_py()))
            total += len(each[-1])
            if len(each) == size or total >= _BLOCK or i + 1 == b.num_rows:
                n = np.array([len(x) for x in each])
                yield b.slice(first, len(each)), np.concatenate(each), np.concatenate([[0], np.cumsum(n)[:-1]]), n
                first, each, total = i + 1, [], 0


def statistics(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(kind, ctx, y, n): how often each outcome follows each hashed context, over all documents.

    Kind 0: class y after (word before last, last word); kind 1: word y after (coarse, last word). These are all that gradients of the model need; their
    number is bounded by the buckets, whatever the corpus. Kinds 2 and 3: words without an output of their own after a last word, or after a word before last.
    """
    held = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        a, w = np.zeros(NEAR * FAR * (CLASSES + 1), np.int64), np.zeros(NEAR * COARSE * WORDS, np.int64)
        after = np.zeros((2, held.value.contexts), np.int64)
        for _, h, starts, _ in _blocks(batches, 0):
            p1, p2 = _contexts(h, starts)
            rows = held.value.find(h)
            rank = held.value.ranks(rows)
            own = rank < WORDS
            for x, c in zip(after, held.value.before(h, rows, starts)):
                np.add.at(x, c[~own], 1)
            cls = np.where(own, rank // _PER + 1, 0)
            a += np.bincount((p2 * NEAR + p1) * (CLASSES + 1) + cls, minlength=len(a))
            w += np.bincount(((p2[own] % COARSE) * NEAR + p1[own]) * WORDS + rank[own], minlength=len(w))
        for kind, x, k in ((0, a, CLASSES + 1), (1, w, WORDS), (2, after[0], 1), (3, after[1], 1)):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array((at // k).astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(x[at])], ["kind", "ctx", "y", "n"])

    cells = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind int, ctx int, y int, n long")
    return cells.groupBy("kind", "ctx", "y").agg(F.sum("n").alias("n"))


def _logits(kind: int, w: dict[str, np.ndarray], ctx: np.ndarray) -> np.ndarray:
    near, other = ctx % NEAR, ctx // NEAR
    return w[f"b{kind}"] + w[f"n{kind}"][near] + w[f"s{kind}"][other] + w[f"j{kind}"][ctx]


def _softmax(kind: int, z: np.ndarray) -> np.ndarray:
    """Over all classes, or over the words of each class."""
    z = z.reshape(len(z), -1, CLASSES + 1 if kind == 0 else _PER)
    z = z - np.maximum(z.max(axis=2, keepdims=True), -1e30)
    e = np.exp(z)
    return (e / np.maximum(e.sum(axis=2, keepdims=True), 1e-300)).reshape(len(z), -1)


def start_weights(v: Vocabulary) -> dict[str, np.ndarray]:
    """No feature weights; biases are log frequencies. Words and classes that don't exist stay impossible."""
    c = np.zeros(WORDS)
    own = v.rank < WORDS
    c[v.rank[own]] = v.c[own]
    cls = np.concatenate([[v.total - c.sum() + 1], c.reshape(CLASSES, _PER).sum(axis=1)])
    out = {}
    with np.errstate(divide="ignore"):
        for kind, y, other, bias in ((0, CLASSES + 1, FAR, np.log(cls)), (1, WORDS, COARSE, np.log(c))):
            out |= {f"b{kind}": bias, f"n{kind}": np.zeros((NEAR, y)), f"s{kind}": np.zeros((other, y)), f"j{kind}": np.zeros((other * NEAR, y))}
    return out


def gradient(kind: int, w: dict[str, np.ndarray], ctx: np.ndarray, y: np.ndarray, n: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{feature table: (rows, observed counts, expected counts)} of outcomes y that were seen n times after contexts ctx; only rows of features that occur.

    Observed less expected is the gradient of the log-likelihood by each weight.
    """
    each, at = np.unique(ctx, return_inverse=True)
    seen = np.zeros((len(each), len(w[f"b{kind}"])))
    np.add.at(seen, (at, y), n)
    p = _softmax(kind, _logits(kind, w, each))
    if kind == 0:
        mass = seen.sum(axis=1, keepdims=True)
    else:
        mass = np.repeat(seen.reshape(len(each), CLASSES, _PER).sum(axis=2), _PER, axis=1)
    out = {}
    for name, feature in (("n", each % NEAR), ("s", each // NEAR), ("j", each)):
        rows, row = np.unique(feature, return_inverse=True)
        sums = np.zeros((2, len(rows), seen.shape[1]))
        np.add.at(sums[0], row, seen)
        np.add.at(sums[1], row, mass * p)
        out[f"{name}{kind}"] = rows, sums[0], sums[1]
    return out


def train(cells: DataFrame, v: Vocabulary, steps: int = 8, rate: float = 0.6, prior: float = 20.0, parts: int = 8) -> dict[str, np.ndarray]:
    """Weights after `steps` full gradient updates. Each is one Spark job over all contexts: every partition sends observed and expected counts of the features that its contexts
    have, and the driver moves each weight by its gradient over the larger of the two plus `prior`. Contexts are dealt to `parts` partitions by hash, so a step's messages
    together have about the size of the weights, a few MB.
    """
    w = start_weights(v)
    cells = stash(cells.where("kind < 2").repartition(parts, "kind", "ctx"), "contexts")  # this part of the table is bounded by the buckets
    spark = cells.sparkSession
    for _ in range(steps):
        held = spark.sparkContext.broadcast(w)

        def run(batches):
            got = list(batches)
            if not got:
                return
            got = pa.Table.from_batches(got)
            kinds, ctxs, ys, ns = (got.column(i).to_numpy() for i in range(4))
            for kind in (0, 1):
                k = kinds == kind
                if not k.any():
                    continue
                for name, (rows, seen, expected) in gradient(kind, held.value, ctxs[k], ys[k], ns[k]).items():
                    both = np.concatenate([seen, expected], axis=1).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(rows.astype(np.int32)), pa.array([x.tobytes() for x in both], pa.binary())], ["name", "row", "g"])

        total: dict[str, np.ndarray] = {k: np.zeros((x.shape[0], 2 * x.shape[1])) for k, x in w.items() if x.ndim == 2}
        for r in cells.mapInArrow(run, "name string, row int, g binary").toArrow().to_pylist():
            total[r["name"]][r["row"]] += np.frombuffer(r["g"], np.float32)
        for k, t in total.items():
            seen, expected = np.split(t, 2, axis=1)
            w[k] = w[k] + rate * (seen - expected) / (np.maximum(seen, expected) + prior)
    drop_stash(cells)
    return w


def log_tables(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities: [context, class] and [coarse context, word in its class]."""
    with np.errstate(divide="ignore"):
        return tuple(np.log10(np.maximum(_softmax(k, _logits(k, w, np.arange(len(w[f"j{k}"])))), 1e-30)) for k in (0, 1))


def totals(cells: DataFrame, v: Vocabulary) -> np.ndarray:
    """[last word, word before last][context]: number of words without an output of their own that follow, in training."""
    out = np.zeros((2, v.contexts))
    t = cells.where("kind >= 2").select("kind", "ctx", "n").toArrow()
    kind, ctx, n = (t.column(i).to_numpy() for i in range(3))
    out[kind - 2, ctx] = n
    return out


def tail_scores(w: np.ndarray, c1: np.ndarray, c2: np.ndarray, train: np.ndarray, after: np.ndarray, rare: float) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, count in training) of tokens of class 0, given every token of their words.

    The word's add-one share among all of class 0 is the base of a log-linear model with a feature for each seen (word before last, word), and that is the
    base of one for each seen (last word, word). Features of a context never meet, so the weights that maximise entropy under the seen counts with PULL tokens
    of the base have a closed form: P = (n(context, word) + PULL * base) / (n(context) + PULL). It sums to 1 over the words of class 0 and one unseen.
    """
    each, at = np.unique(w, return_inverse=True)
    count = np.bincount(at, train, len(each))[at]
    p = (count + 1) / max(rare, 1.0)
    for c, total in ((c2, after[1]), (c1, after[0])):
        _, cell_at = np.unique(at * np.int64(after.shape[1]) + c, return_inverse=True)
        p = (np.bincount(cell_at, train)[cell_at] + PULL * p) / (total[c] + PULL)
    return np.log10(p), count.astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(x) for x in arrays], np.int64).tobytes(), *(x.tobytes() for x in arrays)])


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(sizes, types):
        out.append(np.frombuffer(data, t, n, at))
        at += out[-1].nbytes
    return out


_MESSAGE = "chunk long, part int, data binary"


def _table(messages: list[tuple[int, int, bytes]]) -> pa.Table:
    chunk, part, data = zip(*messages) if messages else ((), (), ())
    return pa.table([pa.array(chunk, pa.int64()), pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["chunk", "part", "data"])


def _dealt(held: list[tuple[np.ndarray, ...]], docs: list[pa.RecordBatch], chunk: int, parts: int) -> pa.Table:
    """The messages of a chunk: to each part the tokens of its words, and to the chunk itself its documents. `held` (hash, contexts, document, whether its count isn't known here) is emptied."""
    w, c1, c2, doc, loose = (np.concatenate(x) for x in zip(*held))
    held.clear()
    part = ((w >> _U(8)) % _U(parts)).astype(np.int32)
    order = np.lexsort((w, part)).astype(np.int32)
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    out = []
    for k in np.flatnonzero(np.diff(cut)):
        s = order[cut[k] : cut[k + 1]]
        each, start, n = np.unique(w[s], return_index=True, return_counts=True)
        out.append((chunk, int(k), _pack(each, n.astype(np.int32), loose[s[start]], c1[s], c2[s], doc[s])))
    t = pa.Table.from_batches(docs)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as writer:
        writer.write_table(t)
    out.append((chunk, parts + chunk % parts, sink.getvalue().to_pybytes()))
    return _table(out)


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, steps: int = 8) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    Training documents are those with crc32(doc_id as text) mod folds other than `held` (a null doc_id trains). base_score is the add-one unigram log10
    probability. score is the model's: class from hashed last word, word before it (skip) and their pair; then a frequent word from its class and the
    same kinds of features, or any other word from class 0 by its counts after the last word and the skip word (tail_scores). So P sums to 1 over words and one unseen.

    Words outside the frequent ones are dealt by hash to parts, in proportion to their tokens: a part has every token of its words, counts (context, word) over those
    of training documents, and sends each document's sum back to the chunk it came from. Tokens travel in packed blocks, once there and once back.
    Null or empty text: the end alone. No training documents: every token has probability 1. Repeated rows count each; other columns are ignored.
    """
    spark = docs.sparkSession
    mark = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(mark == held, F.lit(False)).alias("held_out"))
    counts = stash(word_counts(d.where(~F.col("held_out"))), "counts")
    v = vocabulary(counts)
    cells = stash(statistics(d.where(~F.col("held_out")), v), "cells")
    tables = spark.sparkContext.broadcast((v, *log_tables(train(cells, v, steps))))
    after = spark.sparkContext.broadcast(totals(cells, v))
    drop_stash(counts, cells)
    parts = max(128, int(v.total - v.c[v.rank < WORDS].sum()) // _PART)
    rare = v.rare

    def send(batches):
        v, by_class, by_word = tables.value
        logs = np.log10(v.c + 1.0)
        first, number = TaskContext.get().partitionId() << 32, 0
        held, docs, n_docs, n_tail = [], [], 0, 0

        for c, h, starts, n in _blocks(batches, 1):
            rows = v.find(h)
            rank = v.ranks(rows)
            p1, p2 = _contexts(h, starts)
            c1, c2 = v.before(h, rows, starts)
            own, known = rank < WORDS, rows >= 0
            lm = by_class[p2 * NEAR + p1, np.where(own, rank // _PER + 1, 0)]
            lm[own] += by_word[(p2[own] % COARSE) * NEAR + p1[own], rank[own]]
            base = logs[np.maximum(rows, 0)] * known if len(logs) else np.zeros(len(h))
            add = lambda x: np.add.reduceat(x, starts)
            trains = ~c.column(2).to_numpy(zero_copy_only=False)
            doc = np.repeat((np.arange(len(n)) + n_docs) | (trains.astype(np.int64) << 15), n).astype(np.uint16)
            held.append((h[~own], c1[~own].astype(np.int32), c2[~own].astype(np.int32), doc[~own], ~known[~own]))
            arrays = [c.column(0), c.column(2), pa.array(n.astype(np.int64)), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(lm))]
            docs.append(pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "known", "base", "lm"]))
            n_docs, n_tail = n_docs + len(n), n_tail + int((~own).sum())
            if n_tail >= _CHUNK or n_docs > 32_000:
                yield from _dealt(held, docs, first + number, parts).to_batches()
                held, docs, n_docs, n_tail, number = [], [], 0, 0, number + 1
        if docs:
            yield from _dealt(held, docs, first + number, parts).to_batches()

    def score(key, t):
        if key[0].as_py() >= parts:
            return t
        got = [_unpack(x.as_py(), "<u8", "<i4", "?", "<i4", "<i4", "<u2") for x in t.column("data")]
        w = np.concatenate([np.repeat(x[0], x[1]) for x in got])
        c1, c2, doc = (np.concatenate([x[k] for x in got]) for k in (3, 4, 5))
        p, count = tail_scores(w, c1, c2, (doc >> 15).astype(np.float64), after.value, rare)
        out, at = [], 0
        for chunk, x in zip(t.column("chunk").to_pylist(), got):
            s = slice(at, at + len(x[5]))
            at = s.stop
            each, inverse = np.unique(x[5] & 32767, return_inverse=True)
            loose = np.repeat(x[2], x[1])
            out.append((chunk, key[0].as_py(), _pack(each, np.bincount(inverse, p[s]).astype(np.float32), (x[5] & 32767)[loose], count[s][loose])))
        return _table(out)

    def add_up(t):
        t = t.sort_by("part")
        d = pa.ipc.open_stream(t.column("data")[-1].as_py()).read_all()
        lm, base, known = (d.column(k).to_numpy().copy() for k in ("lm", "base", "known"))
        for x in t.column("data")[:-1]:
            each, p, doc, c = _unpack(x.as_py(), "<u2", "<f4", "<u2", "<i8")
            lm[each] += p
            base += np.bincount(doc, np.log10(c + 1.0), len(base))
            known += np.bincount(doc, c > 0, len(base)).astype(np.int64)
        return pa.table([*(d.column(k) for k in ("doc_id", "held_out", "n_tokens")), pa.array(known), pa.array(base), pa.array(lm)], ["doc_id", "held_out", "n_tokens", "n_known", "base", "lm"])

    scored = d.mapInArrow(send, _MESSAGE).groupBy("part").applyInArrow(score, _MESSAGE)
    out = scored.groupBy("chunk").applyInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double")
    unit = float(np.log10(v.total + v.distinct + 1.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * unit).alias("base_score"), F.col("lm").alias("score"),
    )
