"""Packing of token sequences: Martello-Toth dominance reduction, then best fit for what remains."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import plain_pieces, white_words
from .common import Memo, numbered, stash

#: A group of equal sequences: runs (length, how many of it in a sequence) in order, and the number of such sequences.
Group = tuple[tuple[tuple[int, int], ...], int]


@lru_cache(maxsize=4)
def word_ids(path: str) -> Memo:
    """Little-endian 32-bit ids of a word, from those of its pre-tokens; each is encoded by the tokenizers library once in a Python worker (as long as the bounded tables hold it)."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    encode = lambda x: np.array(lib.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    in_bytes = Memo(lambda c: lib.pre_tokenizer.pre_tokenize_str(c)[0][0])  # a letter in the byte alphabet
    merge = lib.model.tokenize
    piece = Memo(lambda p: np.array([t.id for t in merge(p if p.isalnum() and p.isascii() else "".join(map(in_bytes.__getitem__, p)))], "<u4").tobytes(), 400_000)

    def word(w: str) -> bytes:
        p = plain_pieces(w)
        return encode(w) if p is None else piece[p[0]] if len(p) == 1 else b"".join(map(piece.__getitem__, p))

    return Memo(word, 300_000)


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each piece: a document's ids and end_id, cut only where it is longer than capacity.

    Words without white space are encoded by the tokenizers library once and kept as little-endian bytes, so a document's ids are a join of bytes. Null or empty text: end_id alone.
    """

    def run(batches):
        memo = word_ids(path)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for j, t in enumerate(c.column(1)):
                    x = b"".join(map(memo.__getitem__, white_words(t.as_py() or ""))) + end
                    for k in range(0, len(x), step):
                        p = x[k : k + step]
                        at.append(j)
                        piece.append(k // step)
                        start.append(k // 4)
                        length.append(len(p) // 4)
                        crc.append(zlib.crc32(p))
                        ids.append(p)
                cols = [c.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def dominance_reduction(count: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """(fixed groups, lengths that remain) by the reduction of Martello and Toth (1990), on lengths with their numbers.

    For each length, longest first: with k the most other pieces that fit beside it, the piece is fixed alone (k = 0), with the longest that fits (k = 1, or together they
    fill the sequence, or no two others reach as much), or with the best two others where these dominate all other sets. A set is fixed as often as its
    pieces allow, which uses one of its lengths up but for one or two pieces, so work and groups depend on the number of different lengths, not on that of pieces.
    """
    count = {w: n for w, n in count.items() if n}
    lengths = sorted(count)
    fixed: list[Group] = []

    def take(w: int, n: int) -> None:
        count[w] -= n
        if not count[w]:
            del count[w]
            lengths.pop(bisect_left(lengths, w))

    def others(j: int):
        """Number of pieces of a length that are left beside one of length j."""
        return lambda w: count.get(w, 0) - (w == j)

    def smallest(j: int, most: int = 3) -> list[int]:
        out, left = [], others(j)
        for w in lengths:
            out += [w] * min(left(w), most - len(out))
            if len(out) >= most:
                break
        return out

    def longest(j: int, room: int) -> int | None:
        i = bisect_right(lengths, room) - 1
        if i >= 0 and lengths[i] == j and count[j] == 1:
            i -= 1
        return lengths[i] if i >= 0 else None

    def dominating(j: int) -> tuple[int, ...] | None:
        room = capacity - j
        few = smallest(j)
        k = sum(s <= room for s in np.cumsum(few)) if few else 0
        if k == 0:
            return (j,)
        best = longest(j, room)
        if k == 1 or best == room:
            return (j, best)
        if k == 2:
            left, pair = others(j), None
            for i in range(bisect_right(lengths, room) - 1, -1, -1):  # the two others that reach the most
                a = lengths[i]
                if pair and 2 * a <= sum(pair):
                    break
                if left(a) < 1:
                    continue
                h = bisect_right(lengths, min(a, room - a)) - 1
                while h >= 0 and left(lengths[h]) < 1 + (lengths[h] == a):
                    h -= 1
                if h >= 0 and (pair is None or a + lengths[h] > sum(pair)):
                    pair = (a, lengths[h])
            if pair is None or best >= sum(pair):
                return (j, best)
            if best == pair[0]:
                larger = []
                for w in lengths[bisect_right(lengths, pair[1]) :]:
                    larger += [w] * min(left(w), 2 - len(larger))
                    if len(larger) == 2:
                        break
                if len(larger) < 2 or sum(larger) > room:
                    return (j, *pair)
        return None

    again = True
    while again:
        again = False
        for j in reversed(list(lengths)):
            while j in count and (f := dominating(j)):
                need = {w: f.count(w) for w in f}
                # what dominates goes on to do so while its pieces last: with fewer others no more of them fit, none is longer, and the same ones are the best two
                n = min(count[w] // m for w, m in need.items())
                fixed.append((tuple((w, m) for w, m in need.items()), n))
                for w, m in need.items():
                    take(w, n * m)
                again = True
    return fixed, count


def best_fit(count: dict[int, int], capacity: int) -> list[Group]:
    """Best fit, longest first, for lengths with their numbers: each piece goes where the least room is left that holds it. Equal sequences are filled together."""
    at: dict[int, list[Group]] = {}
    rooms: list[int] = []

    def put(room: int, g: Group) -> None:
        if room not in at:
            at[room] = []
            insort(rooms, room)
        at[room].append(g)

    for w in sorted(count, reverse=True):
        n = count[w]
        while n:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                pattern, m = at[room].pop()
                if not at[room]:
                    del at[room]
                    rooms.pop(i)
            else:
                room, pattern, m = capacity, (), n
            k = room // w
            whole = min(m, n // k)
            if whole:
                put(room - k * w, ((*pattern, (w, k)), whole))
                n -= whole * k
                m -= whole
            if m and 0 < n < k:
                put(room - n * w, ((*pattern, (w, n)), 1))
                n, m = 0, m - 1
            if m and pattern:
                put(room, (pattern, m))
    return [g for gs in at.values() for g in gs]


def layout(groups: list[Group]) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, first offset), sorted: where the piece of each rank within its length goes."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for pattern, m in groups:
        off = 0
        for w, k in pattern:
            r = rank.get(w, 0)
            rows.append((w, r, k, base, off))
            rank[w] = r + m * k
            off += w * k
        base += m
    return np.array(sorted(rows), np.int64).reshape(len(rows), 5)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """`pieces` (doc_id, piece, length, ...) with sequence_id and offset (the place of the piece's first token; no gaps from 0).

    Lengths are at most capacity, so the instance is a table of at most `capacity` lengths with their numbers: that is all the driver gets. It solves the
    table (reduction, then best fit) and the layout, whose size depends on the number of different lengths, goes to the tasks; a piece finds its place by its rank
    among those of its length. Ranks are counted in salted buckets, so one length may have any share of the pieces. A length over capacity raises ValueError; 0 or null too.
    """
    pieces = stash(pieces, "pieces")
    count = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(w is None or not 0 < w <= capacity for w in count):
        raise ValueError("lengths must be from 1 to the capacity")
    fixed, left = dominance_reduction(count, capacity)
    table = layout(fixed + best_fit(left, capacity))
    key = table[:, 0] * 2**44 + table[:, 1]

    def run(batches):
        for b in batches:
            w, r = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            t = table[np.searchsorted(key, w * 2**44 + r, "right") - 1]
            d = r - t[:, 1]
            out = b.drop_columns(["_rank"])
            out = out.append_column("sequence_id", pa.array(t[:, 3] + d // t[:, 2]))
            yield out.append_column("offset", pa.array(t[:, 4] + d % t[:, 2] * w))

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*pieces.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    ranked = numbered(pieces, ["length"], [F.col("doc_id"), F.col("piece")], "_rank")
    return ranked.select(*pieces.columns, "_rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    return pack(token_pieces(docs, path, capacity, end_id, with_ids), capacity)
