"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import bpe, common, embedding_dedup, kdshard, language_model, licenses, minhash, packing, quality_classifier, quality_rules, token_counts
from weft.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, fp string, shard int, key string, score double, label int"


def make(spark, texts, start=0):
    rows = [(start + i, t, None if i % 5 == 0 else "en", ["a", "b", None][i % 3], None, 1, "x", 7, "k", 0.5, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(rng, n):
    return [rng.choice("the of and to in mat tion Ress vor unge écol ß".split()) + rng.choice(["", "a", "ing", "s."]) + rng.choice(["", "x", "or"]) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [words(rng, rng.randint(5, 120)) for _ in range(40)]
    out = [" ".join(w) for w in base]
    for w in base[:12]:  # near and exact copies
        for _ in range(3):
            c = list(w)
            c[rng.randrange(len(c))] = "changed"
            out.append(" ".join(c))
        out.append(" ".join(w).upper())
    long_ = " ".join(words(rng, 30_000))
    return out + [None, "", " \n\t", "one", "ONE", "two words", "z" * 5000, "\x1c \x85 \xa0 x", "a\n\na\nb\na", long_, "# # ### <> |" * 30, "it's <|endoftext|> we'LL\n\n  end <|startoftext|>"]


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def linked(items, link):
    up = {i: i for i in items}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if link(a, b):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: top(i) for i in items}


@pytest.mark.parametrize(("size", "small", "shape"), [(2, 32, {}), (5, 0, {"chunk": 2, "bands": 48, "rows": 3})])
def test_minhash(spark, texts, size, small, shape):
    got = {r["doc_id"]: r for r in rows(minhash.minhash_dedup(make(spark, texts), shingle=size, small=small, **shape))}
    s = {i: shingles(t, size) for i, t in enumerate(texts)}
    want = linked(list(s), lambda a, b: s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(x) for i, x in s.items()}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_bayes_bounds():
    steps = minhash.least_matches(160, 32, 0.8, 1e-6)
    assert [n for n, _ in steps] == [32, 64, 96, 128, 160] and all(0 < m < 0.8 * n for n, m in steps)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    want = linked(nodes, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == want


def test_merged_components(spark):
    rng = random.Random(5)
    one, two = ([(rng.randrange(80), rng.randrange(80)) for _ in range(n)] for n in (30, 25))
    d = lambda e: spark.createDataFrame(e, "a long, b long")
    got = {r.node: r.comp for r in common.merged_components(common.components(d(one)), d(two)).collect()}
    nodes = sorted({x for e in one + two for x in e if e[0] != e[1] or e in two})
    every = {(min(e), max(e)) for e in one + two}
    assert got == linked(nodes, lambda a, b: (a, b) in every)
    none = common.merged_components(common.components(d([])), d([]))
    assert none.count() == 0


def test_kd_shards(spark, texts):
    made = texts[:60] * 4
    got = rows(kdshard.kd_shards(make(spark, made), shards=8))
    assert len(got) == 240 and {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    sizes, same, weight = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for r in got:
        t = made[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        sizes[r["shard"]] += r["size"]
        same[t].add(r["shard"])
        weight[t] += r["size"]
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.3 * min(sizes.values())
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    cap = -(-sum(sizes.values()) // 8) // 4
    assert all(len(same[t]) == 1 for t in same if weight[t] <= cap) and any(len(x) == 1 for x in same.values())
    assert kdshard.kd_shards(make(spark, []), shards=8).count() == 0
    hot = rows(kdshard.kd_shards(make(spark, ["one text"] * 400), shards=4))  # one text may hold all rows
    assert {r["shard"] for r in hot} == set(range(4))
    assert {r["shard"] for r in rows(kdshard.kd_shards(make(spark, ["a", "b"]), shards=8))} <= set(range(8))
    by_bytes = collections.Counter()
    for r in rows(kdshard.kd_shards(make(spark, texts[:60]), target_bytes=5000)):
        by_bytes[r["shard"]] += r["size"]
    assert set(by_bytes) == set(range(len(by_bytes))) and len(by_bytes) > 4
    assert all(n <= 5000 for n in by_bytes.values())


@pytest.mark.parametrize(("shards", "target"), [(8, None), (5, None), (None, 4000)])
def test_kd_tree_by_hand(spark, texts, shards, target):
    """Every split is along the widest dimension, at the key where the left bytes come closest to their share; found by sorting the units of each node."""
    base = kdshard._sized(make(spark, texts[:70] * 2))
    lo, hi = base.agg({"doc_id": "min"}).first()[0], base.agg({"doc_id": "max"}).first()[0]
    _, units = kdshard.units_of(base, 10**9, 10, lo, hi)
    u = units.toPandas()
    tree = kdshard.grow(units.repartition(3), shards, target)
    place = u[list(kdshard._DIMS)].to_numpy()
    key, w = (place << 32) + u.tie.to_numpy()[:, None], u.w.to_numpy()
    width = np.maximum(1, place.max(axis=0) - place.min(axis=0))
    leaves, todo = {}, [(1, np.arange(len(u)), shards)]
    while todo:
        n, at, k = todo.pop()
        total = w[at].sum()
        k = k or -(-total // target)
        if n not in tree.dim:
            assert k == 1 or len(at) == 1
            leaves[n] = at
            continue
        assert k > 1
        d, c = tree.dim[n], tree.cut[n]
        assert d == np.argmax((place[at].max(axis=0) - place[at].min(axis=0)) / width)
        order = at[np.argsort(key[at, d])]
        ends, want = np.cumsum(w[order])[:-1], total * (k // 2) / k
        left = at[key[at, d] < c]
        assert abs(w[left].sum() - want) <= abs(ends - want).min() + total / k / 2000
        todo += [(2 * n, left, shards and k // 2), (2 * n + 1, at[key[at, d] >= c], shards and k - k // 2)]
    assert set(tree.shard) == set(leaves)


def test_kd_tree_of_many_leaves(spark):
    units = spark.range(60_000).selectExpr("id AS g", "0 AS salt", "1L AS w", "pmod(xxhash64(id), 2147483648L) AS q_bytes", "pmod(xxhash64(id, 1), 2147483648L) AS q_lang", "0L AS q_source", "id AS q_doc", "pmod(xxhash64(id, 2), 4294967296L) AS tie").cache()
    tree = kdshard.grow(units, None, 4)
    assert 60_000 / 4 <= len(tree.shard) <= 60_000 and sorted(tree.shard.values()) == list(range(len(tree.shard)))
    at = kdshard.descend(kdshard.keys_of(units.toArrow().to_batches()[0]), tree.arrays())
    assert np.unique(at, return_counts=True)[1].max() <= 4


def test_reduction_and_best_fit():
    rng = random.Random(4)

    def least(items, c):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for b in {x: k for k, x in enumerate(bins) if x >= items[i]}.values():
                bins[b] -= items[i]
                go(i + 1, bins)
                bins[b] += items[i]
            bins.append(c - items[i])
            go(i + 1, bins)
            bins.pop()

        go(0, [])
        return best[0]

    for _ in range(400):
        c = rng.choice([10, 20, 50])
        kinds = [rng.randint(1, c) for _ in range(rng.choice([2, 3, 9]))]
        items = sorted((rng.choice(kinds) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, left = packing.dominance_reduction(dict(collections.Counter(items)), c)
        rest = [w for w, n in left.items() for _ in range(n)]
        groups = fixed + packing.best_fit(left, c)
        used = collections.Counter()
        for pattern, m in groups:
            assert sum(w * k for w, k in pattern) <= c and m > 0
            for w, k in pattern:
                used[w] += k * m
        assert used == collections.Counter(items)
        assert sum(m for _, m in fixed) + least(sorted(rest, reverse=True), c) == least(items, c)  # what is fixed loses nothing


@pytest.mark.parametrize("lengths", [(2000,), (1300,), (1366, 1365, 1364), (2048, 2047), (4096,), (1200, 1500, 1700, 2000), (900, 3000), tuple(range(1000, 2100))])
def test_many_equal_lengths(lengths):
    n = 10**9 // len(lengths)
    start = time.perf_counter()
    fixed, left = packing.dominance_reduction(dict.fromkeys(lengths, n), 4096)
    groups = fixed + packing.best_fit(left, 4096)
    table = packing.layout(groups)
    assert time.perf_counter() - start < (1 if len(lengths) < 9 else 20)
    assert len(groups) <= 8 * len(lengths) + 8 and len(table) <= 24 * len(lengths) + 24
    used = collections.Counter()
    for pattern, m in groups:
        assert sum(w * k for w, k in pattern) <= 4096
        for w, k in pattern:
            used[w] += k * m
    assert used == dict.fromkeys(lengths, n)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = rows(packing.pack_documents(make(spark, texts), vocabulary("word_bpe_49k.json")))
    total = 0
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            part = ids[r["start"] : r["start"] + 4096]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        total += len(ids)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in seqs.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= 4096
    assert len(seqs) <= math.ceil(total / 4096) + 1
    assert packing.pack_documents(make(spark, []), vocabulary("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), 8)
    kept = packing.pack_documents(make(spark, ["a b c"]), vocabulary("word_bpe_49k.json"), with_ids=True).first()
    assert list(kept["ids"]) == lib.encode("a b c", add_special_tokens=False).ids + [1]


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = [chr(i) for i in [*range(0x250), *range(0x300, 0x330), 0x3A3, 0x2003, 0x1F600, 0xAC00, 0x1100, 0x1161, 0x11A8, 0xFB01, 0x200D]]
    odd = ["".join(rng.choices(alphabet, k=40)) for _ in range(200)] + ["ΑΣ ΟΔΟΣ", "İstanbul ß ẞ", "аб漢字 12３½²"]
    every = texts + odd
    docs = make(spark, every)
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in every]
    got = {r["doc_id"]: r for r in rows(bpe.bpe_digests(docs, path))}
    for i, ids in enumerate(want):
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.bpe_encode(docs, path)
    assert {r["doc_id"]: list(r["ids"]) for r in rows(encoded)} == dict(enumerate(want))
    assert {r["doc_id"]: r["text"] for r in rows(bpe.bpe_decode(encoded, path))} == {i: lib.decode(x, skip_special_tokens=False) for i, x in enumerate(want)}


def test_forced_boundaries():
    e = bpe.encoder(vocabulary("word_bpe_49k.json"))
    piece = "aqzjxvqthe"
    parts = e.fragments(piece)
    assert "".join(p for p, _ in parts) == piece and len(parts) > 1
    assert all(p[i : i + 2] in e.inside for p, _ in parts for i in range(len(p) - 1))


@pytest.mark.parametrize("bounds", [{}, {"held": 30}, {"held": 0}, {"held_bytes": 40}])
def test_token_counts(spark, texts, bounds):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(6)
    alphabet = [chr(i) for i in [*range(0x80), *range(0x80, 0x250, 7), 0x3A3, 0x2003, 0x2028, 0x1F600, 0xAC00, 0x4E00, 0x301, 0x200D]]
    odd = ["".join(rng.choices(alphabet, k=60)) for _ in range(100)]
    every = [*texts, "a  <|endoftext|>b <|endoftext|>\n c", "x \n<|endoftext|>", "  a  b \t\n d \xa0 e\x85f", "<|endoftext|>" * 3, *odd, *odd[:3]]
    for r in rows(token_counts.token_counts(make(spark, every), path, **bounds)):
        t = every[r["doc_id"]] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)
    assert token_counts.token_counts(make(spark, []), path, **bounds).count() == 0


def test_pieces_are_counted_once(spark, texts):
    path = vocabulary("byte_bpe_50k.json")
    docs = make(spark, texts * 2)
    cut = token_counts.pre_tokenizer(path)
    want = collections.Counter(p for t in texts * 2 for p in cut(t or ""))
    got = token_counts.piece_counts(token_counts.distinct_pre_tokens(docs, path), path).collect()
    assert len(got) == len(want) and {r.token: r.c for r in got} == want
    assert all("".join(cut(t)) == t for t in texts if t)


def rule_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_rules(spark, texts):
    docs = make(spark, texts)
    got = rows(quality_rules.quality_rules(docs))
    assert len(got) == len(texts)
    for r in got:
        want = rule_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["failed"] == "")
    kept = rows(quality_rules.keep_good(docs))
    assert [r["doc_id"] for r in kept] == [r["doc_id"] for r in got if r["kept"]] and set(kept[0]) == set(docs.columns)
    assert quality_rules.quality_rules(make(spark, [])).count() == 0 and quality_rules.keep_good(make(spark, [])).count() == 0
    only = rows(quality_rules.quality_rules(spark.createDataFrame([(1, "x " * 60), (2, None)], "doc_id long, text string")))
    assert [r["kept"] for r in only] == [False, False]  # no document passes the base: no fences


def fences_by_hand(group, wide, prior, seen):
    """(lo, hi) from a group's values: quartiles of sketch cells, blended with the wider group's."""
    v = sorted(x >> max(x.bit_length() - 9, 0) << max(x.bit_length() - 9, 0) for x in group if x or not seen)
    if not v:
        return None
    q1, q3 = (v[math.ceil(len(v) * p / 100) - 1] for p in (25, 75))
    own = q1 - quality_rules.REACH * (q3 - q1), q3 + quality_rules.REACH * (q3 - q1)
    return own if wide is None else tuple((len(v) * x + prior * w) / (len(v) + prior) for x, w in zip(own, wide))


def test_fences_are_the_groups_own(spark):
    rng = random.Random(8)
    made = []
    for i in range(400):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c"])
        size = {"en": 4, "de": 9, None: 6}[lang] + {"a": 0, "b": 3, "c": 6}[source]
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, size))) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(55, 90))]
        w = [x.upper() if rng.random() < size / 100 else x for x in w] + w[:3] * (rng.random() < 0.3)
        made.append((i, " ".join(w) + "\n" + "".join(f"{x}\n" * rng.choice([0, 1, 2, 4]) for x in w[: rng.choice([0, 2, 5])]), lang, source))
    made += [(1000 + i, *made[0][1:]) for i in range(300)]  # copies count once
    m = quality_rules.measured(spark.createDataFrame(made, "doc_id long, text string, lang string, source string"))
    t = {(r.lang, r.source): r for r in quality_rules.thresholds(m).collect()}
    each = {(lang or "", source, *quality_rules.counts(text)) for _, text, lang, source in made}
    names = quality_rules._COUNTS
    each = [(lang, source, dict(zip(names, c))) for lang, source, *c in each]
    each = [x for x in each if x[2]["n_words"] >= 50 and 2 * x[2]["n_repeat_words"] <= x[2]["n_words"]]
    assert len(t) == 9
    for k, (n, d, sides) in quality_rules.MEASURES.items():
        seen, value = sides.endswith("seen"), lambda c: c[n] * 1000 // c[d] if c[d] else 0  # noqa: B023
        every = fences_by_hand([value(c) for *_, c in each], None, 100, seen)
        for (lang, source), r in t.items():
            wide = fences_by_hand([value(c) for x, _, c in each if x == lang], every, 100, seen)
            want = fences_by_hand([value(c) for x, y, c in each if (x, y) == (lang, source)], wide, 100, seen)
            assert (r[f"lo_{k}"], r[f"hi_{k}"]) == pytest.approx(want, rel=1e-12)
        assert len({r[f"hi_{k}"] for r in t.values()}) > 3, k  # the sketches decide, not a constant


def test_sketch_cells(spark):
    v = [0, 1, 63, 64, 65, 66, 127, 128, 131, 132, 1000, 10**6]
    for bits in (6, 9):
        got = [r.c for r in spark.createDataFrame([(x,) for x in v], "v long").select(common.cell(quality_rules.F.col("v"), bits).alias("c")).collect()]
        assert got == [x if x < 1 << bits else x >> (x.bit_length() - bits) << (x.bit_length() - bits) for x in v]


def test_thresholds_follow_the_group(spark):
    rng = random.Random(1)
    good = [" ".join("abcdefghij"[: rng.randint(2, 9)] + str(i) + rng.choice(["", "", "."]) for i in range(60, 150)) for _ in range(40)]
    marked = [" ".join("abcdefghij"[: rng.randint(2, 9)] + str(i) + "#" * rng.randint(1, 4) for i in range(60, 150)) for _ in range(40)]
    a = make(spark, good[:38] + marked[:2]).withColumn("lang", quality_rules.F.lit("en")).withColumn("source", quality_rules.F.lit("prose"))
    b = make(spark, marked, 100).withColumn("lang", quality_rules.F.lit("en")).withColumn("source", quality_rules.F.lit("code"))
    got = {r["doc_id"]: r["kept"] for r in rows(quality_rules.quality_rules(a.unionByName(b), prior=5))}
    assert not got[38] and not got[39] and all(got[i] for i in range(38)) and all(got[100 + i] for i in range(40))


def test_language_model(spark, texts):
    got = {r["doc_id"]: r for r in rows(language_model.lm_scores(make(spark, texts), steps=4))}
    t = {i: (x or "").encode().lower().split() + [b"\n"] for i, x in enumerate(texts)}
    held = {i for i in t if zlib.crc32(str(i).encode()) % 7 == 2}
    c = collections.Counter(w for i in t if i not in held for w in t[i])
    n, v = sum(c.values()), len(c)
    for i, w in t.items():
        r = got[i]
        assert r["held_out"] == (i in held) and r["n_tokens"] == len(w) and r["train_tokens"] == n and r["n_known"] == sum(c[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9, abs=1e-9)
        assert r["score"] < 0
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    assert language_model.lm_scores(make(spark, [])).count() == 0


def test_gradient_by_differences():
    """Observed less expected counts against differences of the log-likelihood, which is summed token by token here."""
    m = language_model
    rng = np.random.default_rng(4)
    for kind, y, other in ((0, m.CLASSES + 1, m.FAR), (1, m.WORDS, m.COARSE)):
        w = {f"b{kind}": rng.normal(size=y), f"n{kind}": rng.normal(size=(m.NEAR, y)), f"s{kind}": rng.normal(size=(other, y)), f"j{kind}": rng.normal(size=(other * m.NEAR, y)) * 0.1}
        ctx, out, n = rng.integers(0, other * m.NEAR, 40), rng.integers(0, y, 40), rng.integers(1, 5, 40)
        ctx[1::3] = ctx[0]

        def likelihood(w):
            total = 0.0
            for c, o, k in zip(ctx, out, n):
                z = [w[f"b{kind}"][v] + w[f"n{kind}"][c % m.NEAR][v] + w[f"s{kind}"][c // m.NEAR][v] + w[f"j{kind}"][c][v] for v in range(y)]  # noqa: B023
                among = range(y) if kind == 0 else range(o // m._PER * m._PER, (o // m._PER + 1) * m._PER)  # noqa: B023
                total += k * (z[o] - math.log(sum(math.exp(z[v]) for v in among)))
            return total

        got = m.gradient(kind, w, ctx, out, n)
        for name, (rows_, seen, expected) in got.items():
            assert sorted(rows_) == sorted(set({"n": ctx % m.NEAR, "s": ctx // m.NEAR, "j": ctx}[name[0]].tolist()))
            assert seen.sum() == pytest.approx(n.sum()) == expected.sum()
            for r, v in [(0, int(out[0])), (len(rows_) - 1, 3)]:
                up, down = ({k: x.copy() for k, x in w.items()} for _ in range(2))
                up[name][rows_[r], v] += 1e-4
                down[name][rows_[r], v] -= 1e-4
                assert (seen - expected)[r, v] == pytest.approx((likelihood(up) - likelihood(down)) / 2e-4, abs=1e-4)


def test_training_raises_the_likelihood(spark, texts):
    d = make(spark, texts)
    v = language_model.vocabulary(language_model.word_counts(d))
    cells = language_model.statistics(d, v)
    own = [(r.kind, r.ctx, r.y, r.n) for r in cells.where("kind < 2").collect()]
    before = None
    for steps in (0, 2, 6):
        a, b = language_model.log_tables(language_model.train(cells, v, steps))
        now = sum(n * (a if kind == 0 else b)[ctx, y] for kind, ctx, y, n in own)
        assert before is None or now > before
        before = now


def test_language_model_holds_little():
    """Memory of a worker that counts words, cuts documents and deals out tokens: bounded, whatever comes in, and small beside the 3 GB of an executor."""
    m = language_model
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 50_000)) for _ in range(40)]
    batch = pa.record_batch([pa.array(texts)], ["text"])

    def peak(f):
        tracemalloc.start()
        out = f()
        top = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return out, top

    list(map(len, map(m.tokens, texts[:10])))  # fills the word cache
    (n, rows_), top = peak(lambda: (lambda x: (sum(b.column(1).to_numpy().sum() for b in x), len(x)))(list(m._counted([batch]))))
    assert n == 40 * 50_001 and rows_ == 2 and top < 30
    sizes, top = peak(lambda: [len(h) for _, h, _, _ in m._blocks([batch], 0)])
    assert sum(sizes) == 40 * 50_001 and max(sizes) < m._BLOCK + 50_001 and top < 15

    k = m._CHUNK
    h = rng.integers(0, 1 << 62, 3000).astype(np.uint64)[rng.integers(0, 3000, k)]
    held = [(x, rng.integers(0, 9, len(x)).astype(np.int32), rng.integers(0, 9, len(x)).astype(np.int32), np.zeros(len(x), np.uint16), np.ones(len(x), bool)) for x in np.array_split(h, 8)]
    docs = [pa.record_batch([pa.array([1])], ["doc_id"])]
    messages, top = peak(lambda: m._dealt(held, docs, 0, 128))
    assert not held and top < 40
    got = [m._unpack(x.as_py(), "<u8", "<i4", "?", "<i4", "<i4", "<u2") for x in messages.column("data")[:-1]]
    assert sum(len(x[5]) for x in got) == k and (np.sort(np.concatenate([np.repeat(x[0], x[1]) for x in got])) == np.sort(h)).all()


def test_language_model_is_a_distribution(spark, texts):
    d = make(spark, texts)
    counts = language_model.word_counts(d)
    v = language_model.vocabulary(counts)
    a, w = language_model.log_tables(language_model.train(language_model.statistics(d, v), v, 2))
    assert np.allclose((10.0**a).sum(axis=1), 1)
    rare = sum(r.c + 1 for r in counts.collect()) + 1 - sum(v.c[v.rank < language_model.WORDS] + 1)
    assert v.rare == rare
    per = (10.0**w).reshape(len(w), language_model.CLASSES, -1).sum(axis=2)
    full = np.bincount(v.rank[v.rank < language_model.WORDS] // (language_model.WORDS // language_model.CLASSES), minlength=language_model.CLASSES) > 0
    assert np.allclose(per[:, full], 1)


def test_tail_counts_are_joined(spark, texts, monkeypatch):
    whole = rows(language_model.lm_scores(make(spark, texts), steps=1))
    monkeypatch.setattr(language_model, "HELD", 20)
    few = rows(language_model.lm_scores(make(spark, texts), steps=1))
    for a, b in zip(whole, few):
        assert a["n_known"] == b["n_known"] and a["base_score"] == pytest.approx(b["base_score"], rel=1e-9, abs=1e-9)


def test_words_without_an_output_follow_their_context(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HELD", 3)
    bucket = lambda w: (int(language_model.tokens(w)[0]) >> 40) % 63
    a = "wa0"
    b = next(w for w in (f"wb{k}" for k in range(9999)) if bucket(w) == bucket(a))
    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2][:60]
    test = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    made = [(i, f"the of and the of and the of and {x} {w}") for k, i in enumerate(train) for x, w in [(("left", a), ("right", b))[k % 2]]]
    made += [(i, f"the of and {x} {w}") for i, (x, w) in zip(test, [("left", a), ("left", b), ("right", a), ("right", b)])]
    made += [(9990, None)]
    got = {r["doc_id"]: r["score"] for r in rows(language_model.lm_scores(spark.createDataFrame(made, "doc_id long, text string"), steps=2))}
    la, lb, ra, rb = (got[i] for i in test)
    assert la > lb + 0.05 and rb > ra + 0.05


def test_tail_scores_sum_to_one():
    rng = np.random.default_rng(5)
    w, c1, c2 = rng.integers(0, 30, 500).astype(np.uint64), rng.integers(0, 6, 500), rng.integers(0, 6, 500)
    train = rng.random(500) < 0.8
    after = np.array([np.bincount(c[train], minlength=6) for c in (c1, c2)])
    rare = float(train.sum() + len(set(w[train])) + 1)
    for x, y in ((0, 3), (5, 5)):
        every = np.arange(30, dtype=np.uint64)
        p, c = language_model.tail_scores(np.r_[w, every], np.r_[c1, np.full(30, x)], np.r_[c2, np.full(30, y)], np.r_[train, np.zeros(30)].astype(float), after, rare)
        unseen = language_model.tail_scores(np.array([99], np.uint64), np.array([x]), np.array([y]), np.zeros(1), after, rare)[0]
        seen = c[500:] > 0
        assert (10.0 ** p[500:][seen]).sum() + 10.0 ** unseen[0] == pytest.approx(1)


#: Notices as people write them, with the labels that a reader would give; no rule of the scanner is used here.
NOTICES = [
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", {"apache-2.0", "apache"}),
    ("See the License for the specific language governing permissions and\n limitations under the License.", {"apache-2.0"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", {"mit"}),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", {"mit"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", {"bsd"}),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", {"bsd-3-clause"}),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement", {"bsd-4-clause"}),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", {"gpl"}),
    ("either version 3 of the License, or (at your option) any later version.", {"gpl-3"}),
    ("under the terms of the GNU Lesser General Public License", {"lgpl"}),
    ("GNU Affero General Public License version 3", {"agpl-3"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("The Software shall be used for Good, not Evil.", {"json"}),
    ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike license", {"cc-by-sa"}),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", {"cc-by-nc-sa"}),
    ("This Font Software is licensed under the SIL Open Font License", {"ofl"}),
    ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", {"zlib"}),
    ("not licensed under the MIT License", {"not-mit", "mit"}),
    ("CC-BY cc by 4.0 cc by", {"cc-by", "cc-by-4.0"}),
    ("Unauthorized copying of this file, via any medium is strictly prohibited.", {"proprietary"}),
    ("The weather was fine and the river ran high.", set()),
    ("a permit, a note, a version", set()),
]


def test_notices(spark):
    docs = make(spark, [t for t, _ in NOTICES])
    for r in rows(licenses.license_scan(docs)):
        text, want = NOTICES[r["doc_id"]]
        got = set(filter(None, r["labels"].split(",")))
        if "not licensed" in text:
            assert got == want and r["base_labels"] == "mit"
        else:
            assert want <= got if want else not got, (text, got)
        assert (r["score"] > 0) == bool(want) and 0 <= r["score"] <= 1


def evaluated(table, words):
    """(labels, score) of rules tried one by one at every place, without a gate; a match inside another of the same or a higher priority is dropped, pair by pair."""
    found = []
    for x in table:
        for m in re.finditer(x["pattern"], words):
            found.append((m.start(), m.end(), x["level"], x["id"], x["label"], x["confidence"]))
    kept = []
    for k, d in enumerate(found):
        for n, e in enumerate(found):
            if n != k and e[0] <= d[0] and e[1] >= d[1]:
                same = e[:2] == d[:2]
                if e[2] > d[2] or e[2] == d[2] and (not same or e[3] < d[3]):
                    break
        else:
            kept.append(d)
    return {d[4] for d in kept}, max([d[5] for d in kept], default=0)


def test_licenses(spark, texts):
    extra = [t for t, _ in NOTICES] + [
        "MIT-License MIT LICENSE mit  license", "mit license " * 120, "gnu general public license" * 3,
        "Licensed under the terms of the Apache License, Version 2.0. Not available under the terms of the GNU GPL v3. SPDX-License-Identifier: Apache-2.0 WITH x", " ".join(t for t, _ in NOTICES),
    ]
    every = texts + extra
    table = licenses.rules()
    assert sum(len(x) for x in licenses.SIGNATURES.values()) > 130 and len(table) > 500
    for r in rows(licenses.license_scan(make(spark, every))):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in every[r["doc_id"]] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = [(i, x) for p, x in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert r["n_words"] == len(w) and r["n_base"] == len(at)
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        base = sorted({x for _, x in at})
        assert r["base_labels"] == ",".join(base)
        if len(w) < 5000:
            labels, score = evaluated(table, " ".join(w))
            assert r["labels"] == ",".join(sorted(labels | set(base)))
            assert r["score"] == pytest.approx(max(score, 0.6 * bool(base)))


def test_many_matches_in_one_text(spark):
    took = []
    for n in (2_000, 20_000):
        d = make(spark, ["mit license " * n])
        start = time.perf_counter()
        r = licenses.license_scan(d).first()
        took.append(time.perf_counter() - start)
        assert r["n_base"] == n and r["labels"] == "mit" and r["last_word"] == 2 * (n - 1)
    assert took[1] < 20


def test_license_plan_is_native(spark):
    plan = licenses.license_scan(make(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def links_by_hand(v, least=0.98):
    """{id: (links, component)} of (id, vector, label) rows: every pair is compared; each id has one vector."""
    ok = {i: np.array(e) for i, e, x in v if e and i is not None and x is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    label, links, up = {i: x for i, _, x in v}, collections.Counter(), {}
    for d in {len(e) for e in ok.values()}:
        ids = np.array(sorted(i for i in ok if len(ok[i]) == d))
        x = np.array([ok[i] / np.abs(ok[i]).max() for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= least
        near &= np.array([[label[i] == label[j] for j in ids] for i in ids])
        np.fill_diagonal(near, False)
        links.update(dict(zip(ids.tolist(), near.sum(axis=1).tolist())))
        for k in range(len(ids)):
            if int(ids[k]) not in up:
                front = np.array([k])
                while len(front):
                    up.update({int(ids[f]): int(ids[k]) for f in front})
                    front = np.array([f for f in np.flatnonzero(near[front].any(axis=0)) if int(ids[f]) not in up])
    return {i: (links[i], up.get(i, i)) for i, _, _ in v}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    v = [(i, (base[i % 30] + rng.normal(size=16) * rng.choice([0.01, 0.1])).tolist(), int(i % 30) % 3) for i in range(240)]
    v += [(300 + i, (base[0] + rng.normal(size=16) * 0.02).tolist(), 0) for i in range(150)]
    v += [(500 + i, (base[2]).tolist(), 2) for i in range(60)]  # exact copies
    v += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] * 8, 0), (904, [1.0] * 16, None), (905, [], 0), (906, [1.0, 0.0], 0), (907, [2.0, -0.0], 0), (908, base[1].tolist(), 2)]
    v += [(910 + i, (base[3] * s).tolist(), 0) for i, s in enumerate([1e200, 1e-200, 3.0])]  # squares overflow and vanish
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df, chunk=40).collect()}
    want = links_by_hand(v)
    assert len(got) == len(v) and want[910][0] >= 2
    assert all(got[i]["n_links"] <= want[i][0] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(n for n, _ in want.values())  # recall against brute force
    assert np.mean([got[i]["component_id"] == want[i][1] for i in got]) > 0.97
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, 905)) and got[906]["n_links"] == 1
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embeddings_repeated_rows_and_columns(spark):
    a, b, c = [1.0, 0.0, 0.2], [1.0, 0.01, 0.2], [0.0, 1.0, 0.0]
    v = [(1, a, "x"), (1, a, "x"), (2, b, "x"), (2, b, "x"), (3, c, "x"), (None, a, "x"), (4, a, "y"), (5, c, "x"), (5, a, "x")]
    df = spark.createDataFrame([(*r, 9, 8, 7, "n") for r in v], "vec_id long, embedding array<double>, label string, id long, g long, n long, near string")
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(df).collect())
    # 5 has two vectors: one equal to 3's, one to 1's, so all are one component
    assert got == {(1, 2, 1, True): 2, (2, 2, 1, False): 2, (3, 1, 1, False): 1, (None, 0, None, True): 1, (4, 0, 4, True): 1, (5, 1, 1, False): 1, (5, 2, 1, False): 1}


@pytest.mark.parametrize("common", [0.0, 1.0, 2.5])
def test_recall_of_the_index(spark, common):
    """Vectors with and without a direction that all share: pairs at the threshold are found, and the reference points don't fall together."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 64)) + common
    near = base + rng.normal(size=base.shape) * np.linalg.norm(base, axis=1, keepdims=True) * 0.19 / 8
    v = [(i, x.tolist(), int(i % 600) % 2) for i, x in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")
    want = links_by_hand(v)
    assert sum(n for n, _ in want.values()) > 800
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(df).collect()}
    assert all(got[i] <= want[i][0] for i in got)
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_classifier(spark, texts):
    rng = random.Random(9)
    good = [" ".join(words(rng, 80)) for _ in range(90)]
    bad = [" ".join(f"{w.upper()}!!" for w in words(rng, 80)) for _ in range(90)]
    docs = make(spark, [x for p in zip(good, bad) for x in p] + [None, "", "x"])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(180)] + [(5000, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows(quality_classifier.quality_scores(docs, labels))
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 180]
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.95
    none = rows(quality_classifier.quality_scores(docs, labels.limit(0)))
    assert {r["score"] for r in none} == {0.5}
    assert quality_classifier.quality_scores(make(spark, []), labels).count() == 0


def test_votes_by_hand(spark, texts):
    """Scores against every labelled row as a point of its own: cosines one by one, the nearest rows, weights by similarity."""
    rng = random.Random(2)
    made = [" ".join(words(rng, rng.randint(3, 40))) for _ in range(60)]
    docs = make(spark, made + texts[:8] + [None, "", "a" * 3000 + " word"])
    labels = spark.createDataFrame([(i, int(rng.random() < 0.5)) for i in range(60)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, neighbours=7)
    y = {r.doc_id: r.quality for r in labels.collect()}
    latent = lambda t: model.latent(quality_classifier.term_weights(t).astype(np.float32)[None])[0].astype(np.float64)
    points = [(latent(made[i]), y[i]) for i in range(60)]
    got = {r["doc_id"]: r for r in rows(quality_classifier.score(docs, model))}
    assert len(got) == 71
    for i, t in enumerate(made + texts[:8] + [None, "", "a" * 3000 + " word"]):
        near = sorted(((float(latent(t) @ p), v) for p, v in points), reverse=True)
        weight = lambda s: max(s, 0.0) ** 8 + 1e-9
        if near[6][0] - near[7][0] > 1e-5:  # no tie at the edge
            want = sum(weight(s) * v for s, v in near[:7]) / sum(weight(s) for s, _ in near[:7])
            assert got[i]["score"] == pytest.approx(want, abs=1e-3)


def test_terms_cover_the_whole_word():
    t = quality_classifier.term_weights
    long_ = "Ab1." * 6
    assert quality_classifier.shape(long_ + "!") != quality_classifier.shape(long_)
    assert (t("x" * 40) != t("x" * 80)).any() and (t(long_ + "!") != t(long_)).any() and (t("stone") != t("stony")).any()
    assert t(None).sum() == t("").sum() > 0 and np.isfinite(t("z" * 10**6)).all()


def test_classifier_reads_words(spark):
    rng = random.Random(4)
    letters = lambda a: ["".join(rng.choice(a) for _ in range(5)) for _ in range(60)]
    lists = letters("abcdefgh"), letters("mnopqrst")
    docs = spark.createDataFrame([(i, " ".join(rng.sample(lists[i % 2], 50))) for i in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, quality int")
    held = [r for r in rows(quality_classifier.quality_scores(docs, labels)) if r["held_out"]]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95


def test_classifier_keeps_every_repeated_row(spark):
    docs = spark.createDataFrame([(0, "good words in a line")] * 30 + [(1, "BAD!! MARKS## ALL$$ OVER")] * 9, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    m = quality_classifier.fit(docs, labels, sample=2)
    assert len(m.labels) == 2 and sorted(zip(m.labels, m.counts)) == [(0.0, 9), (1.0, 30)]
    s = quality_classifier.Model(m.idf, m.axes, m.points, m.labels, 15, m.counts).score(np.array([quality_classifier.term_weights("good words in a line"), quality_classifier.term_weights("BAD!! MARKS## ALL$$ OVER")]))
    assert s[0] > 0.9 > 0.5 > s[1]


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "some text here"), (1, "some text here"), (1, "some text here"), (2, None)], "doc_id long, text string")
    path = vocabulary("word_bpe_49k.json")
    for df in (bpe.bpe_digests(docs, path), packing.pack_documents(docs, path), quality_rules.quality_rules(docs), language_model.lm_scores(docs, steps=1), licenses.license_scan(docs), minhash.minhash_dedup(docs), kdshard.kd_shards(docs, shards=2)):
        assert df.count() == 4
    assert token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json")).count() == 4


def test_a_worker_holds_the_caches_of_one_operator():
    """The stages of a pipeline run in the same Python workers; what one has cached is given up when the next one fills its own."""
    text = " ".join(f"word{i}" for i in range(500))
    pack = packing.word_ids(vocabulary("word_bpe_49k.json"))
    sizes = lambda: (len(minhash._hash), len(quality_classifier._terms), len(pack))  # noqa: E731, SLF001
    first = quality_rules.counts(text)
    assert sizes()[0] >= 500 and sizes()[1:] == (0, 0)
    terms = quality_classifier.term_weights(text)
    assert sizes()[0] == 0 and sizes()[1] >= 500
    ids = [pack[w] for w in text.split()]
    assert sizes()[:2] == (0, 0) and sizes()[2] >= 500
    assert (quality_classifier.term_weights(text) == terms).all() and quality_rules.counts(text) == first and [pack[w] for w in text.split()] == ids
    assert len(minhash.shingle_set(text, 5)) == 496 and sizes()[0] >= 500 and sizes()[2] == 0
