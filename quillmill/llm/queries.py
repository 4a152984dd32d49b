"""The thin opN_<name> queries over the shared tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import clustering, conversations, decontaminate, exact_dedup, html_extract, line_dedup, mixing, pii, quality, secrets, simhash, suffix_dedup, toxicity
from .common import table
from .oracles import clustering_sql, conversations_sql


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a fixed key, for repeatable results; a real run takes its key from a secret store."""
    return pii.replace(table(spark, sf_dir, "documents"), key="demonstration key")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents"), passage_words=50)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources at equal shares of the characters, the mix as large as the corpus."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summaries(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.described(*clustering.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_html_extraction": op2_html_extraction,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_clustering": op12_clustering,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES = {
    # The shared pages all hold one <article>; the SQL reads that tag, which the labeller is not told to do.
    "op2_html_extraction": r"""
        WITH a AS (
            SELECT page_id, url,
                   regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body
            FROM pages
        ), b AS (
            SELECT page_id, url, string_split(
                regexp_replace(regexp_replace(regexp_replace(body,
                    '</?(p|h1)[^>]*>', chr(1), 'g'), '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(1)) AS parts
            FROM a
        ), c AS (
            SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
                replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
                    '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts
            FROM b
        )
        SELECT page_id, url, array_to_string(parts, chr(10)) AS text,
               length(array_to_string(parts, chr(10))) AS n_chars
        FROM c
    """,
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY sha) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha AS text_sha256
        FROM d WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)
    """,
    "op6_mixing": r"""
        WITH mass AS (
            SELECT source, sum(length(text)) AS m FROM documents GROUP BY source
        ), rates AS (
            SELECT source, CASE WHEN m > 0 THEN
                       (SELECT sum(m) FROM mass)::DOUBLE * 1.0
                       / (SELECT count(*) FROM mass WHERE m > 0)::DOUBLE / m ELSE 1.0 END AS rate
            FROM mass
        ), terms AS (
            SELECT source, j, CASE WHEN j = 0 THEN exp(-rate)
                       ELSE exp(-rate) * exp(sum(CASE WHEN j = 0 THEN 0 ELSE ln(rate / j) END)
                            OVER (PARTITION BY source ORDER BY j)) END AS p
            FROM rates, range(0, 100) t(j)
        ), cdf AS (
            SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM terms
        ), drawn AS (
            SELECT *, ('0x' || substr(sha256('1:' || doc_id || ':0'), 1, 12))::BIGINT / 281474976710656.0 AS u
            FROM documents
        ), times AS (
            SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, d.source,
                   any_value(d.n_chars) AS n_chars, count(*) AS k
            FROM drawn d JOIN cdf c ON d.source = c.source AND c.c <= d.u
            GROUP BY d.doc_id, d.source
        )
        SELECT doc_id, text, lang, source, n_chars, r::INTEGER AS replica,
               ('0x' || substr(sha256('1-order:' || doc_id || ':' || r), 1, 12))::BIGINT / 281474976710656.0 AS mix_key
        FROM times, unnest(range(1, k + 1)) t(r)
    """,
    # Not by masks: every alignment with five equal tokens in a row is scored, which all leaks have.
    "op10_decontamination": r"""
        WITH items AS (
            SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),
                                        lambda x: x <> '') AS w
            FROM benchmark
        ), docs AS (
            SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS w FROM documents
        ), ig AS (
            SELECT item_id, p, w[p + 1 : p + 5] AS g
            FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS p FROM items WHERE len(w) >= 5)
        ), dg AS (
            SELECT doc_id, p, w[p + 1 : p + 5] AS g
            FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM docs WHERE len(w) >= 5)
        ), hits AS (
            SELECT DISTINCT d.doc_id, i.item_id, d.p - i.p AS shift FROM dg d JOIN ig i ON d.g = i.g
        ), aligned AS (
            SELECT h.doc_id, h.item_id, h.shift, len(i.w) AS n, k, i.w[k + 1] = d.w[k + shift + 1] AS same
            FROM hits h JOIN items i USING (item_id) JOIN docs d USING (doc_id), unnest(range(0, len(i.w))) t(k)
            WHERE k + shift >= 0 AND k + shift < len(d.w)
        ), sums AS (
            SELECT *, sum(CASE WHEN same THEN 1 ELSE -4 END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS s FROM aligned
        ), runs AS (
            SELECT *, s - least(0, coalesce(min(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run FROM sums
        ), scored AS (
            SELECT doc_id, item_id, n, greatest(0, max(run)) AS best, count(*) FILTER (same) AS equal
            FROM runs GROUP BY doc_id, item_id, shift, n
        )
        SELECT doc_id, item_id, n::INTEGER AS item_tokens, max(best)::INTEGER AS overlap
        FROM scored WHERE CASE WHEN n < 10 THEN equal = n ELSE best >= 12 OR equal * 10 >= n * 9 END
        GROUP BY doc_id, item_id, n
    """,
    "op11_conversation_repair": conversations_sql(),
    "op12_clustering": clustering_sql(),
}
