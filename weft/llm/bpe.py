"""Byte-pair encoding and decoding with forced-boundary splitting."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo

#: Python's str.split also takes these for white space; the tokenizers' \s doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


def white_words(text: str) -> list[str]:
    """Runs without Unicode white space. No piece of a vocabulary whose pre-tokenizer drops white space reaches over it: the first forced boundary."""
    if _SEPARATORS.search(text):
        return [w for w in _WHITE.split(text) if w]
    return text.split()


#: Pre-tokens of a word whose letters all stand before U+0250 (no combining marks there, so normalisation only lowers case).
_L, _N = "a-zªµºß-öø-ÿĀ-ɏ", "0-9²³¹¼½¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}]+").findall


def plain_pieces(word: str) -> list[str] | None:
    """Pre-tokens of a word as the word vocabulary's file cuts them, or None where that is left to the library: rare letters, and what may hold a special token."""
    low = word.lower()
    if "<|" in word or not word.isascii() and (max(word) >= "ɐ" or max(low) >= "ɐ" or "İ" in word):
        return None
    return _PIECES(low)


class ForcedBoundaryBpe:
    """Encoder and decoder of one vocabulary file (JSON; BPE with a word end, white space dropped by the pre-tokenizer).

    A pair of neighbouring bytes that occurs inside no vocabulary token is never merged over, so a pre-token is cut there and each fragment is
    encoded on its own; only the last fragment carries the word end. Normalisation and pre-tokenisation follow the file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        spec = json.loads(open(path, encoding="utf-8").read())
        lib = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = lib.normalizer.normalize_str, lib.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.merge_last = lib.model.tokenize
        self.merge_inner = BPE(vocab=self.vocab, merges=[tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]).tokenize
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        bare = (t.removesuffix(self.end) if self.end else t for t in self.vocab)
        self.inside = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        self.fragment = Memo(self._fragment, 150_000)
        self.in_bytes = Memo(lambda c: lib.pre_tokenizer.pre_tokenize_str(c)[0][0])
        self.piece = Memo(self._plain, 300_000)

    def fragments(self, piece: str) -> list[tuple[str, bool]]:
        """(fragment, is last) of a pre-token in the byte alphabet."""
        out, at = [], 0
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in self.inside:
                out.append((piece[at:i], False))
                at = i
        return [*out, (piece[at:], True)]

    def _fragment(self, key: tuple[str, bool]) -> list[int]:
        """Merge the lowest-ranked neighbouring pair, leftmost first, until none is left: with the word end on the last fragment, without on others."""
        part, last = key
        return [t.id for t in (self.merge_last if last else self.merge_inner)(part)]

    def word(self, word: str) -> list[int]:
        """Ids of a run without white space. Pre-tokens keep their ids, so a word that differs only in case or marks costs a look-up."""
        ids: list[int] = []
        if (plain := plain_pieces(word)) is not None:
            for p in plain:
                ids += self.piece[p]
            return ids
        for part in self.cut_special.split(word) if "<|" in word else (word,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self._piece(part)
        return ids

    def _plain(self, p: str) -> list[int]:
        """Ids of a pre-token of common letters in lower case; in the byte alphabet ASCII letters and digits stand for themselves."""
        alpha = p if p.isascii() and p.isalnum() else "".join(map(self.in_bytes.__getitem__, p))
        return [i for f in self.fragments(alpha) for i in (self.fragment[f] if not f[1] else self._fragment(f))]

    def _piece(self, part: str) -> list[int]:
        return [i for piece, _ in self.pre_tokenize(self.normalize(part)) for f in self.fragments(piece) for i in (self.fragment[f] if not f[1] else self._fragment(f))]

    def encode(self, text: str) -> list[int]:
        return [i for w in white_words(text) for i in self.word(w)]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by one space, special ones included."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryBpe:
    """One encoder for each vocabulary file in a Python worker."""
    return ForcedBoundaryBpe(path)


@lru_cache(maxsize=4)
def _words(path: str) -> Memo:
    e = encoder(path)

    def both(w: str) -> tuple[int, str, str]:
        ids = e.word(w)
        return len(ids), " ".join(map(str, ids)), e.decode(ids)

    return Memo(both, 250_000)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each document: the whole text as a list of ids. Null or empty text: the empty list. Repeated rows are encoded alike."""

    def run(batches):
        e = encoder(path)
        memo = Memo(e.word, 250_000)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                ids = pa.array([[x for w in white_words(t.as_py() or "") for x in memo[w]] for t in c.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([c.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for (doc_id, ids); null ids: the empty text."""

    def run(batches):
        e = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document, encoded and decoded in one pass.

    Ids and decoded tokens are kept per word, so a text's are joins of those of its words: the decoder puts one space between tokens wherever they stand.
    Null or empty text: no tokens, digests of the empty string. doc_id may be null or repeated; other columns are ignored.
    """

    def run(batches):
        memo = _words(path)
        for b in batches:
            n, ids, texts = [], [], []
            for t in b.column(1):
                parts = list(map(memo.__getitem__, white_words(t.as_py() or "")))
                n.append(sum([p[0] for p in parts]))
                ids.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
                texts.append(hashlib.sha256(" ".join([p[2] for p in parts]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
