"""Registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chains, fim, jaccard, lzprint, mixing, packing, pages, repeats, secrets, topk, toxicity
from .common import table


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~_held_out())
    return (
        toxicity.score(docs, toxicity.train(docs, labels))
        .select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even token totals of the languages; the labelled table gives the language of
    the documents that are in ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = labelled_languages(docs, table(spark, sf_dir, "labels"))
    docs = docs.select("doc_id", "text")
    m = mixing.fit(docs, labelled)
    best = F.array_max("_posterior")
    return mixing.rated(docs, m).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.get(F.array(*[F.lit(d) for d in m.domains]), F.array_position("_posterior", best).cast("int") - 1).alias("domain"),
        best.alias("posterior"),
        F.col("_rate").alias("rate"),
        F.col("_copies").alias("copies"),
    )


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the documents in ``labels``."""
    return labels.select("doc_id").distinct().join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")


def op5_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.shared_words(table(spark, sf_dir, "documents"))


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.edited_prints(table(spark, sf_dir, "documents"))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.failing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


_OP9_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
  FROM documents
), g AS (
  SELECT *, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(t[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(t[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(t[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM g
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""

_OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), fl AS (
  SELECT w.doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS e,
         coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), n AS (
  SELECT part, a::INTEGER + 2 * b::INTEGER + 4 * c::INTEGER + 8 * d::INTEGER + 16 * e::INTEGER AS fails,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fl GROUP BY ALL
), f AS (SELECT unnest([1, 2, 4, 8, 16]) AS bit, unnest(['A', 'B', 'C', 'D', 'E']) AS name
), o AS (
  SELECT f1.name || f2.name || f3.name || f4.name || f5.name AS filter_order,
         [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31
    AND len(list_distinct([f1.bit, f2.bit, f3.bit, f4.bit, f5.bit])) = 5
), s AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[:i - 1]), 0) AS INTEGER) AS before
  FROM o, generate_series(1, 5) g(i)
), r AS (
  SELECT n.part, s.filter_order, s.step, s.bit,
         sum(CASE WHEN n.fails & (s.before | s.bit) = 0 THEN n.n ELSE 0 END) AS kept,
         sum(CASE WHEN n.fails & s.bit <> 0 AND n.fails & s.before = 0 THEN n.n ELSE 0 END) AS removed,
         sum(CASE WHEN n.fails & s.bit <> 0 AND n.fails & s.before <> 0 THEN n.n ELSE 0 END) AS redundant,
         sum(CASE WHEN n.fails = s.bit THEN n.n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN n.fails & s.bit <> 0 AND n.fails & s.before = 0 THEN n.good ELSE 0 END) AS good_lost,
         sum(CASE WHEN n.fails & s.bit <> 0 AND n.fails & s.before = 0 THEN n.toxic ELSE 0 END) AS toxic_lost
  FROM n, s GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (
        op1_toxicity, op2_secrets, op3_ngram_jaccard, op4_mixing, op5_chained_passages,
        op6_suffix_repeats, op7_template_text, op8_lz_fingerprint, op9_maxscore, op10_hilbert_packing,
        op11_fill_in_middle, op12_filter_audit, op13_chunked_bpe,
    )
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {"op9_maxscore": _OP9_SQL, "op11_fill_in_middle": _OP11_SQL, "op12_filter_audit": _OP12_SQL}
