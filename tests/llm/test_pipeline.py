"""The stages against brute-force versions of what they keep."""

import os
import random

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages(spark):
    import corpus_pipeline as p
    from weft.llm import minhash, quality_classifier, quality_rules

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    one = p.rules(spark, docs, DATA).cache()
    assert one.columns == docs.columns and ids(one) == {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    two = p.classifier(spark, one, DATA).cache()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = quality_classifier.quality_scores(docs, labels)
    assert two.columns == docs.columns and ids(two) == ids(one) & {r.doc_id for r in scores.where("predicted = 1").collect()}
    three = p.near_duplicates(spark, two, DATA).cache()
    text = {r.doc_id: r.text for r in two.collect()}
    s = {i: set(minhash.shingle_set(t, 5).tolist()) for i, t in text.items()}
    near = lambda a, b: 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])
    left = ids(three)
    assert three.columns == docs.columns and left <= set(s)
    for x in set(s) - left:
        assert any(near(x, y) for y in s if y != x and s[y])
    assert not any(near(a, b) for a in left for b in left if a < b and s[a] and s[b])
    four = p.packed(spark, three, DATA)
    assert ids(four) == left
    assert [n for n, _ in p.STAGES] == ["quality_rules", "quality_classifier", "minhash_dedup", "best_fit_packing"]
    assert p.run(spark, DATA).count() == four.count()


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, no rows, and columns with names that the operators use themselves."""
    import corpus_pipeline as p

    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice("the of and to in mat tion vor unge place water stone".split()) + rng.choice(["", "a", "ing"]) for _ in range(n))
    one = prose(120)
    texts = [one, one, one + " more", None, "", " \n", prose(80), prose(40_000), "# $ % " * 60, prose(90), "x"]
    rows = [(i if i != 9 else None, t, None if i == 6 else "en", None if i == 7 else "s", None, 1, "f", b"s", True, 0.5, 2, "k") for i, t in enumerate(texts)]
    rows += [rows[0], rows[6]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, fp string, sig binary, kept boolean, score double, id int, _row string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name, f in p.STAGES:
        got = f(spark, docs, DATA)
        assert f(spark, docs.limit(0), DATA).count() == 0
        if name == "best_fit_packing":
            assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            continue
        assert got.columns == docs.columns
        left = got.collect()
        assert all(r in docs.collect() for r in left)
        if name == "quality_rules":
            assert not any((r.text or "").split() in ([], ["x"]) for r in left)
        if name == "minhash_dedup":
            # rows of one doc_id stay or go together; texts without words and rows without an id stay
            assert sorted((r.doc_id for r in left if r.doc_id is not None)) == [0, 0, 3, 4, 5, 6, 6, 7, 8, 10]
            assert sum(r.doc_id is None for r in left) == 1
