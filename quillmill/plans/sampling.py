"""Queries on sampling, numbering and batches. Samples are ordered by SHA-256, which SQL knows too."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quality import size_bucket
from ..operators import numbering, sampling
from ..sources import files
from .registry import literal, query, table

CHUNKS_SQL = """c AS (SELECT doc_id AS id, text, source AS course, lang || '/' || (doc_id % 37) AS file,
    CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'degraded' END AS quality,
    CASE WHEN doc_id % 4 = 0 THEN ['fragmented'] END AS flags,
    CASE WHEN n_chars * 400 < 300000 THEN 'small' WHEN n_chars * 400 < 3000000 THEN 'medium' ELSE 'large' END AS bucket
    FROM documents LEFT JOIN labels l USING (doc_id))"""


def _chunks(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("course"), F.concat_ws("/", "lang", (F.col("doc_id") % 37).cast("string")).alias("file"),
        F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "degraded").alias("quality"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("fragmented"))).alias("chunk_quality_flag"), size_bucket(F.col("n_chars") * 400).alias("bucket"),
    )


@query(
    f"""WITH {CHUNKS_SQL}, h AS (SELECT *, sha256('42:' || id) AS h FROM c),
    z AS (SELECT course, count(*) AS n, count(DISTINCT bucket) AS b FROM c GROUP BY 1),
    q AS (SELECT course, b, least(greatest(3, 40 // (SELECT count(*) FROM z)), n) AS quota FROM z),
    i AS (SELECT h.*, quota, greatest(1, quota // b) AS per, row_number() OVER (PARTITION BY course, bucket ORDER BY h, id) AS nb FROM h JOIN q USING (course)),
    o AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY CASE WHEN nb <= per THEN 0 ELSE 1 END, h, id) AS nth FROM i)
    SELECT id, course, bucket FROM o WHERE nth <= quota ORDER BY h, id LIMIT 40"""
)
def sample_strata(spark, sf):
    return sampling.stratified(_chunks(spark, sf), 40, "course", "bucket", "id", 42).select("id", "course", "bucket")


@query(
    f"""WITH {CHUNKS_SQL}, m AS (SELECT *, CASE WHEN quality <> 'degraded' THEN quality WHEN flags IS NOT NULL THEN 'degraded+' ELSE 'degraded-' END AS st
        FROM c WHERE quality IS NOT NULL AND length(text) >= 150),
    f AS (SELECT least(count(*) FILTER (st = 'degraded+'), 3) AS f FROM m),
    q AS (SELECT DISTINCT st, CASE st WHEN 'degraded+' THEN f WHEN 'degraded-' THEN 5 - f ELSE 5 END AS quota FROM m, f),
    a AS (SELECT *, row_number() OVER (PARTITION BY st, file ORDER BY sha256('2024:' || id), id) AS of FROM m),
    o AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY CASE WHEN of = 1 THEN 0 ELSE 1 END, sha256('2024:' || id), id) AS nth FROM a)
    SELECT id, quality, file FROM o JOIN q USING (st) WHERE nth <= quota"""
)
def sample_diverse(spark, sf):
    return sampling.text_strata(_chunks(spark, sf), "id", 2024).select("id", "quality", "file")


@query(
    f"""WITH {CHUNKS_SQL}, a AS (SELECT *, sha256('123:' || id) AS h FROM c WHERE length(text) >= 60 AND course IN ('src1', 'src2', 'src3', 'src4')),
    b AS (SELECT *, row_number() OVER (PARTITION BY course, file ORDER BY h, id) AS of FROM a),
    o AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY CASE WHEN of = 1 THEN 0 ELSE 1 END, h, id) AS nth FROM b)
    SELECT id, course FROM o WHERE nth <= 4"""
)
def sample_formats(spark, sf):
    rows = _chunks(spark, sf).filter("length(text) >= 60")
    quotas = literal(spark, [(f"src{i}", 4) for i in range(1, 5)], "course string, quota int")
    return sampling.diverse(rows, quotas, "course", "file", "id", 123).select("id", "course")


@query(
    f"""WITH {CHUNKS_SQL}, a AS (SELECT *, sha256('7:' || id) AS h, row_number() OVER (PARTITION BY course, file ORDER BY sha256('7:' || id), id) AS of FROM c WHERE length(text) >= 100),
    t AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY h, id) AS turn FROM a WHERE of = 1)
    SELECT id, course FROM t ORDER BY turn, sha256('7:' || course), id LIMIT 18"""
)
def sample_round_robin(spark, sf):
    rows = _chunks(spark, sf).filter("length(text) >= 100")
    return sampling.round_robin(rows, 18, "course", "file", "id", 7).select("id", "course")


@query(
    f"""WITH {CHUNKS_SQL}, a AS (SELECT id, course, f, sha256('2024:' || id) AS h, row_number() OVER (PARTITION BY course, f ORDER BY sha256('2024:' || id), id) AS of
        FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 'Final Project/' WHEN id % 5 = 0 THEN '期末/' ELSE 'hw/' END || file AS f FROM c)
        WHERE length(text) >= 100 AND (contains(lower(f), 'final') OR contains(f, '期末'))),
    t AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY h, id) AS turn FROM a WHERE of = 1)
    SELECT id, course FROM t ORDER BY turn, sha256('2024:' || course), id LIMIT 18"""
)
def final_exam_set(spark, sf):
    folder = F.when(F.col("id") % 3 == 0, "Final Project/").when(F.col("id") % 5 == 0, "期末/").otherwise("hw/")
    return sampling.final_exam(_chunks(spark, sf).withColumn("file", F.concat(folder, "file")), 18, 2024).select("id", "course")


@query(
    """SELECT doc_id AS id, (row_number() OVER (ORDER BY source, doc_id) - 1) // 64 AS batch_no, 'txtm_' || lpad((row_number() OVER (ORDER BY source, doc_id) - 1)::VARCHAR, 5, '0') AS chunk_id FROM documents"""
)
def batch_numbers(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id")
    rows = numbering.chunk_ids(sampling.batches(docs, ["source", "doc_id"], 64), ["source", "doc_id"], "txtm")
    return rows.select(F.col("doc_id").alias("id"), "batch_no", "chunk_id")


@query(
    """WITH done AS (SELECT doc_id FROM labels WHERE quality = 1)
    SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM done)"""
)
def resume_anti_join(spark, sf):
    done = table(spark, sf, "labels").withColumn("error", F.when(F.col("quality") == 0, "failed"))
    return files.not_done(table(spark, sf, "documents"), done, "doc_id").select(F.col("doc_id").alias("id"))


@query(
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events)
    SELECT event_id, user_id, event_type FROM a WHERE n = 1"""
)
def latest_attempts(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type").withColumn("k", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return files.latest_attempt(rows, "k", "event_id").select("event_id", "user_id", "event_type")


@query(
    """SELECT doc_id AS id, source, nth FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY l.quality ORDER BY doc_id, source) AS nth
    FROM documents LEFT JOIN labels l USING (doc_id)) WHERE nth <= 5"""
)
def parse_targets(spark, sf):
    report = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("file"), "source")
    manifest = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("file"), F.col("quality").cast("string").alias("quality"))
    from pyspark.sql import Window

    got = files.parse_targets(report, manifest, 5)
    return got.select(F.col("idx").alias("id"), "source", F.row_number().over(Window.partitionBy("quality").orderBy("idx")).cast("long").alias("nth"))
