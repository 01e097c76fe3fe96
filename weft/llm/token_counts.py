"""Token counts from pre-token frequencies: pieces are counted once per distinct pre-token, joined to each document's frequencies and summed."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import repeat
from operator import mul

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cell, stash

_S = "\t-\r \x85\xa0  -     　"
#: A space and the run after it, or white space as the pre-tokenizer cuts it. No pre-token reaches over the end of a run.
_RUNS = re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_RARE = re.compile("[\x85\xa0ɐ-\U0010ffff]").search

#: Most frequent pre-tokens whose piece counts are broadcast, and the bytes of text that these may have together. The others are joined.
HELD, HELD_BYTES = 1 << 17, 1 << 24
#: Distinct pre-tokens that a task holds before it hands their counts on.
_FLUSH = 400_000


@lru_cache(maxsize=4)
def pre_tokenizer(path: str) -> Callable[[str], list[str]]:
    """Pre-tokens of a text, as substrings, the way the vocabulary file cuts it; special strings stand alone. Runs with rare characters are cut by the library."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    special = [t.content for t in lib.get_added_tokens_decoder().values()]
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else lambda t: [t]

    def part(text: str) -> list[str]:
        if not _RARE(text):
            return _PRE_TOKENS(text)
        out: list[str] = []
        for run in _RUNS.findall(text):
            out += [run[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(run)] if _RARE(run) else _PRE_TOKENS(run)
        return out

    def pre_tokens(text: str) -> list[str]:
        parts = cut(text)
        return part(text) if len(parts) == 1 else [p for i, x in enumerate(parts) for p in ([x] if i % 2 else part(x))]

    return pre_tokens


@lru_cache(maxsize=4)
def piece_counter(path: str) -> Callable[[str], int]:
    """Number of vocabulary pieces of a pre-token."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    special = {t.content for t in lib.get_added_tokens_decoder().values()}
    merge = lib.model.tokenize
    in_bytes = Memo(lambda c: lib.pre_tokenizer.pre_tokenize_str(c)[0][0], 20_000)  # a character in the byte alphabet
    return lambda p: 1 if p in special else len(merge("".join(map(in_bytes.__getitem__, p))))


def distinct_pre_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(token, c): distinct pre-tokens of all texts with their occurrences, counted inside the tasks and then added up."""

    def run(batches):
        cut, seen = pre_tokenizer(path), Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "c"])

        for b in batches:
            for t in b.column(0):
                seen.update(cut(t.as_py() or ""))
                if len(seen) >= _FLUSH:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def piece_counts(distinct: DataFrame, path: str) -> DataFrame:
    """(token, c, n): n pieces of each distinct pre-token. This is the only place where pieces are counted, once for each row."""

    def run(batches):
        count = piece_counter(path)
        for b in batches:
            yield b.append_column("n", pa.array(map(count, b.column(0).to_pylist()), pa.int64()))

    return distinct.mapInArrow(run, "token string, c long, n long")


def _least_count(pieces: DataFrame, held: int, held_bytes: int) -> int | None:
    """The least number of occurrences that pre-tokens within both bounds reach, from a histogram; None if not even the most frequent fit."""
    least, n, size = None, 0, 0
    hist = pieces.groupBy(cell(F.col("c")).alias("cell")).agg(F.count("*").alias("k"), F.sum(F.octet_length("token")).alias("b")).collect()
    for r in sorted(hist, reverse=True):
        n, size = n + r["k"], size + r["b"]
        if n > held or size > held_bytes:
            break
        least = r["cell"]
    return least


def token_counts(docs: DataFrame, path: str, limit: int = 512, held: int = HELD, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document for a byte-level vocabulary file (JSON).

    1. Distinct pre-tokens of all texts, from partial counts of the tasks; one exchange of (pre-token, occurrences).
    2. Pieces of each distinct pre-token, counted once.
    3. Each document's pre-token frequencies are joined to these counts and summed; no ids are made. The join is a look-up for the most frequent pre-tokens, whose counts are
       broadcast (at most `held`, of at most `held_bytes` of text), so no key that many documents share is shuffled; the rest is joined by pre-token.

    Special strings inside a text count as the file's special tokens. Null or empty text: 0 bytes, 0 tokens. doc_id may be null or repeated; empty input gives no rows; other columns are ignored.
    """
    pieces = stash(piece_counts(distinct_pre_tokens(docs, path), path), "pieces")
    least = _least_count(pieces, held, held_bytes)
    frequent = F.lit(False) if least is None else F.col("c") >= least
    t = pieces.where(frequent).select("token", "n").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist())))

    def run(batches):
        cut, known_ = pre_tokenizer(path), known.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                size, n, rest = [], [], []
                for t in c.column(1):
                    t = t.as_py() or ""
                    f = Counter(cut(t))
                    got = list(map(known_.get, f, repeat(0)))
                    size.append(len(t.encode("utf-8", "surrogatepass")))
                    n.append(sum(map(mul, got, f.values())))
                    rest.append([{"token": k, "f": f[k]} for k, v in zip(f, got) if not v])
                cols = [pa.array(range(row, row + c.num_rows), pa.int64()), c.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(rest, pa.list_(pa.struct([("token", pa.string()), ("f", pa.int64())])))]
                row += c.num_rows
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_bytes", "n", "rest"])

    schema = "row long, doc_id long, n_bytes long, n long, rest array<struct<token:string,f:long>>"
    freq = stash(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), "frequencies")
    other = freq.select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.f")
    other = other.join(pieces.where(~frequent).select("token", F.col("n").alias("k")), "token").groupBy("row").agg(F.sum(F.col("f") * F.col("k")).alias("more"))
    n = (F.col("n") + F.coalesce("more", F.lit(0))).cast("long")
    return freq.drop("rest").join(other, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
