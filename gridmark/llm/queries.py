"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridmark.llm.bpe_automaton import bpe_round_trip
from gridmark.llm.common import table
from gridmark.llm.exact_dedup import exact_dedup
from gridmark.llm.html_text import extract_text
from gridmark.llm.line_dedup import line_dedup
from gridmark.llm.lm_score import lm_scores
from gridmark.llm.near_dedup import near_duplicates
from gridmark.llm.rule_ensemble import quality
from gridmark.llm.source_mix import mix_sources
from gridmark.llm.token_counts import token_counts
from gridmark.llm.topk_search import top_k


def vocabulary(name: str) -> str:
    """Where the installed public vocabularies are, on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its places in the mix of all sources."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what its lines lost, and a digest of the text that is left."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with three levels. Sums are rounded, as SQL adds up in another order."""
    scores = lm_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_html_text, op3_token_counts, op4_rule_quality, op5_source_mix, op6_bpe_automaton, op7_topk_search, op8_line_dedup, op9_lm_score, op10_exact_dedup)}

ORACLE_SQL = {
    "op9_lm_score": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT r, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM t),
        y AS (SELECT r, i, c, lag(c) OVER (PARTITION BY r ORDER BY i) AS b, lag(c, 2) OVER (PARTITION BY r ORDER BY i) AS a FROM x),
        one AS (SELECT c, count(*) AS k FROM x GROUP BY c),
        two AS (SELECT b, c, count(*) AS k FROM y WHERE b IS NOT NULL GROUP BY b, c),
        three AS (SELECT a, b, c, count(*) AS k FROM y WHERE a IS NOT NULL GROUP BY a, b, c HAVING count(*) >= 2),
        n AS (SELECT count(*) AS n FROM x),
        s AS (SELECT y.r, log10(CASE WHEN three.k IS NOT NULL THEN three.k / before.k ELSE CASE WHEN y.a IS NULL THEN 1 ELSE 0.4::DOUBLE END
                    * CASE WHEN two.k >= 2 THEN two.k / ctx.k WHEN y.b IS NULL THEN one.k / n.n ELSE 0.4::DOUBLE * (one.k / n.n) END END) AS s
              FROM y JOIN one ON one.c = y.c CROSS JOIN n LEFT JOIN two ON two.b = y.b AND two.c = y.c LEFT JOIN one ctx ON ctx.c = y.b
              LEFT JOIN three ON three.a = y.a AND three.b = y.b AND three.c = y.c LEFT JOIN two before ON before.b = y.a AND before.c = y.b),
        d AS (SELECT r, sum(s) AS s FROM s GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0), 4) AS log10_score, round(s / len(w), 6) AS mean_log10
        FROM t LEFT JOIN d USING (r)
    """,
    "op7_topk_search": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm
    """,
}
