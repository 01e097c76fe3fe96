"""The thin registered queries opN_<name>, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, kdshard, language_model, licenses, minhash, packing, quality_classifier, quality_rules, token_counts


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark, sf_dir):
    return minhash.minhash_dedup(_docs(spark, sf_dir), shingle=2)


def op2_kdtree(spark, sf_dir):
    return kdshard.kd_shards(_docs(spark, sf_dir), shards=8)


def op3_best_fit(spark, sf_dir):
    return packing.pack_documents(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op4_bpe(spark, sf_dir):
    return bpe.bpe_digests(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_docs(spark, sf_dir))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(_docs(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=512)


def op6_maxent(spark, sf_dir):
    return language_model.lm_scores(_docs(spark, sf_dir))


def op7_licenses(spark, sf_dir):
    return licenses.license_scan(_docs(spark, sf_dir))


def op8_pivots(spark, sf_dir):
    return embedding_dedup.embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op10_knn_quality(spark, sf_dir):
    return quality_classifier.quality_scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


_REACH = """
, e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)
, reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
, comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
"""

#: All pairs that share a shingle; DuckDB's arrays stand for the words.
_OP1 = (
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
, s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM w))
, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
, p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)
, l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c))
"""
    + _REACH
    + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id, coalesce(c, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.a = d.doc_id
"""
)

_OP8 = (
    """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
, l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98)
"""
    + _REACH
    + """
, k AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT d.vec_id, coalesce(k, 0) AS n_links, least(d.vec_id, coalesce(c, d.vec_id)) AS component_id, coalesce(c, d.vec_id) >= d.vec_id AS kept
FROM embeddings d LEFT JOIN k ON k.a = d.vec_id LEFT JOIN comp ON comp.a = d.vec_id
"""
)


def _op5_sql() -> str:
    m, prior, reach = quality_rules.MEASURES, quality_rules.PRIOR, quality_rules.REACH
    value = lambda k: f"CASE WHEN {m[k][1]} > 0 THEN {m[k][0]} * 1000 // {m[k][1]} ELSE 0 END"
    cells = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS m, {value(k)} AS v FROM once" + f" WHERE {value(k)} > 0" * m[k][2].endswith("seen") for k in m)
    base = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"

    def fences(level: str, name: str) -> str:
        by = f"{level}, m" if level else "m"
        q = lambda p: f"min(cell) FILTER (upto * 100 >= n * {p})"
        return (
            f"{name} AS (SELECT {by}, n, q1 - {reach} * (q3 - q1) AS lo, q3 + {reach} * (q3 - q1) AS hi FROM (SELECT {by}, max(n) AS n, {q(25)} AS q1, {q(75)} AS q3 "
            f"FROM (SELECT *, sum(c) OVER (PARTITION BY {by} ORDER BY cell) AS upto, sum(c) OVER (PARTITION BY {by}) AS n FROM (SELECT {by}, cell, count(*) AS c FROM cells GROUP BY {by}, cell)) GROUP BY {by}))"
        )

    blend = lambda own, wide: f"CAST({own[0]}.n * {own} + {prior} * {wide} AS DOUBLE) / CAST({own[0]}.n + {prior} AS DOUBLE)"
    outside = lambda k: f"{value(k)} > t.hi" + f" OR {value(k)} < t.lo" * (m[k][2] == "both")
    over = ", ".join(f"(SELECT '{k}' FROM t WHERE t.lang = q.lang AND t.source = q.source AND t.m = '{k}' AND ({outside(k)}))" for k in m)
    return (
        r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
, g3 AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, greatest(len(w) - 1, 1))) t(i) WHERE i <= len(w) - 2)
, twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g3) WHERE c > 1)
, rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id)
, lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id)
, q AS (SELECT w.doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n - lines.u, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS n_marks FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id)
"""
        + f", once AS (SELECT DISTINCT * EXCLUDE doc_id FROM q WHERE NOT {base})\n"
        + f", cells AS (SELECT lang, source, m, (v >> s) << s AS cell FROM (SELECT *, greatest(length(bin(v)) - {quality_rules.BITS}, 0) AS s FROM ({cells})))\n"
        + f", {fences('lang, source', 'g')}\n, {fences('lang', 'l')}\n, {fences('', 'a')}\n"
        + f", w1 AS (SELECT l.lang, m, {blend('l.lo', 'a.lo')} AS lo, {blend('l.hi', 'a.hi')} AS hi FROM l JOIN a USING (m))\n"
        + f", t AS (SELECT g.lang, g.source, m, {blend('g.lo', 'w1.lo')} AS lo, {blend('g.hi', 'w1.hi')} AS hi FROM g JOIN w1 USING (lang, m))\n"
        + f", f AS (SELECT *, {base} AS base_failed, array_to_string(list_filter([{over}], lambda x: x IS NOT NULL), ',') AS failed FROM q)\n"
        + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM f"
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": _OP1, "op5_quality_rules": _op5_sql(), "op8_pivots": _OP8}
