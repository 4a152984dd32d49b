"""Queries on grouped evaluation, reports, costs and running totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bm25, evaluate, fusion, producers
from ..sources import stores
from . import retrieval
from .registry import literal, query, table

RESULTS_SQL = """r AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'abstention' ELSE 'standard' END AS test_category,
    CASE WHEN event_id % 6 = 0 THEN 'no_content' WHEN event_id % 6 = 3 THEN 'partial' END AS abstention_type,
    CASE WHEN event_id % 2 = 0 THEN 'text' ELSE 'code' END AS source_type, CASE event_id % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'degraded' END AS quality,
    value / 7e0 AS faithfulness, CASE WHEN event_id % 6 > 0 THEN value / 3e0 END AS answer_relevancy, value / 11e0 AS context_precision, value AS context_recall,
    event_id % 4 = 1 AS target_retrieved, CASE WHEN event_id % 6 = 0 THEN event_id % 12 = 0 END AS abstention_honesty FROM events)"""
MEANS = ", ".join(f"round(avg({m}), 4) AS {m}, count({m}) AS {m}_n" for m in evaluate.METRICS)
TAIL = "count(*) AS n, round(avg(target_retrieved::INTEGER), 4) AS hit_rate, round(avg(CASE WHEN abstention_honesty THEN 1e0 ELSE 0e0 END), 4) AS honesty"


def _results(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        F.when(i % 3 == 0, "abstention").otherwise("standard").alias("test_category"),
        F.when(i % 6 == 0, "no_content").when(i % 6 == 3, "partial").alias("abstention_type"),
        F.when(i % 2 == 0, "text").otherwise("code").alias("source_type"),
        F.when(i % 5 == 0, "good").when(i % 5 == 1, "degraded").alias("quality"),
        (F.col("value") / 7).alias("faithfulness"), F.when(i % 6 > 0, F.col("value") / 3).alias("answer_relevancy"),
        (F.col("value") / 11).alias("context_precision"), F.col("value").alias("context_recall"),
        (i % 4 == 1).alias("target_retrieved"), F.when(i % 6 == 0, i % 12 == 0).alias("abstention_honesty"),
    )


@query(
    f"""WITH {RESULTS_SQL} SELECT 'all' AS dimension, NULL::VARCHAR AS value, {MEANS}, {TAIL} FROM r
    UNION ALL SELECT 'test_category', test_category, {MEANS}, {TAIL} FROM r GROUP BY test_category
    UNION ALL SELECT 'abstention_type', abstention_type, {MEANS}, {TAIL} FROM r WHERE abstention_type IS NOT NULL GROUP BY abstention_type
    UNION ALL SELECT 'source_type', source_type, {MEANS}, {TAIL} FROM r GROUP BY source_type
    UNION ALL SELECT 'text_quality', quality, {MEANS}, {TAIL} FROM r WHERE source_type = 'text' AND quality IS NOT NULL GROUP BY quality"""
)
def eval_grouping_sets(spark, sf):
    out = evaluate.summary(_results(spark, sf))
    rounded = {c: F.round(c, 4) for c in (*evaluate.METRICS, "hit_rate", "honesty")}
    return out.withColumns(rounded)


#: Three runs of each question with a target: its words, with the entity arm fused in, and rewritten by feedback.
HITS_SQL = f"""WITH {retrieval.INDEX_SQL}, {retrieval.SCORE_SQL}, {retrieval.TARGET_SQL}, {retrieval.ENTITY_SQL}, {retrieval.FEEDBACK_SQL},
    both_arms AS (SELECT qid, id, 1e0 / (60 + rank) AS part, rank AS place FROM ranked WHERE rank <= 10
                  UNION ALL SELECT qid, id, 15e-1 / (60 + rank), 1000000 + rank FROM er WHERE rank <= 10 AND score > 0),
    armed AS (SELECT qid, id, sum(part) AS score, min(place) AS place FROM both_arms GROUP BY ALL),
    mixed AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, place) AS rank FROM armed),
    h AS (SELECT t.qid, coalesce(r.rank <= 5, false) AS b, coalesce(m.rank <= 5, false) AS x, coalesce(a.rank <= 5, false) AS y
          FROM targets t LEFT JOIN ranked r ON r.qid = t.qid AND r.id = t.target LEFT JOIN mixed m ON m.qid = t.qid AND m.id = t.target
          LEFT JOIN again a ON a.qid = t.qid AND a.id = t.target)"""


def _hits(spark, sf):
    sparse, targets = stores.settled(retrieval._sparse(spark, sf), "sparse"), stores.settled(retrieval._targets(spark, sf), "targets")
    arm = bm25.retrieve_entities(retrieval._index(spark, sf), retrieval._entities(spark, sf), retrieval.K)
    mixed = fusion.fuse([(sparse, 1.0), (arm, fusion.ENTITY_WEIGHT)])
    return tuple(fusion.target_hits(run, targets).select("qid", "hit") for run in (sparse, mixed, retrieval._feedback(spark, sf, sparse)))


@query(f"{HITS_SQL} SELECT b AS hit_before, y AS hit_after, count(*) AS n FROM h GROUP BY ALL")
def eval_transition(spark, sf):
    before, _, after = _hits(spark, sf)
    return evaluate.transitions(before, after)


@query(f"{HITS_SQL} SELECT count(*) FILTER (b) AS baseline_hits, count(*) FILTER (x) AS first_hits, count(*) FILTER (y) AS second_hits, count(*) FILTER (y AND NOT b) AS gained, count(*) FILTER (b AND NOT y) AS lost, count(*) AS n FROM h")
def eval_three_way(spark, sf):
    return evaluate.compare(*_hits(spark, sf))


CALLS_SQL = "c AS (SELECT event_id, event_type, value AS latency, event_id % 700 AS tokens_in, event_id % 90 AS tokens_out FROM events)"


def _calls(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", "event_type", F.col("value").alias("latency"), (i % 700).alias("tokens_in"), (i % 90).alias("tokens_out"))


@query(
    f"""WITH {CALLS_SQL} SELECT count(*) AS n, round(avg(latency), 4) AS mean_latency, round(median(latency), 4) AS median_latency, max(latency) AS max_latency, min(latency) AS min_latency,
    sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round((sum(tokens_in) * 15e-2 + sum(tokens_out) * 60e-2) / 1e6, 6) AS cost FROM c"""
)
def cost_latency_stats(spark, sf):
    out = evaluate.latency_report(_calls(spark, sf))
    return out.withColumns({"mean_latency": F.round("mean_latency", 4), "median_latency": F.round("median_latency", 4), "cost": F.round("cost", 6)})


@query(f"WITH {CALLS_SQL} SELECT event_id, event_type, round(sum(tokens_in * 20e-2 + tokens_out * 12e-1) OVER (PARTITION BY event_type ORDER BY event_id) / 1e6, 6) AS total FROM c")
def running_cost(spark, sf):
    spent = evaluate.cost(F.col("tokens_in"), F.col("tokens_out"), 0.20, 1.20)
    out = evaluate.running(_calls(spark, sf), spent, ["event_id"], ["event_type"], "total")
    return out.select("event_id", "event_type", F.round("total", 6).alias("total"))


FILES_SQL = """f AS (SELECT event_id::VARCHAR AS file, CASE event_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.sql' ELSE '.r' END AS ext, event_id % 500 AS size, (event_id * 7) % 29 * (CASE WHEN event_id % 50 = 0 THEN 9 ELSE 1 END) AS n_chunks,
    event_id % 11 AS n_structured, CASE WHEN event_id % 13 = 0 THEN 'x' END AS error FROM events)"""


def _files(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        i.cast("string").alias("file"), F.when(i % 3 == 0, ".py").when(i % 3 == 1, ".sql").otherwise(".r").alias("ext"), (i % 500).alias("size"),
        ((i * 7) % 29 * F.when(i % 50 == 0, 9).otherwise(1)).alias("n_chunks"), (i % 11).alias("n_structured"), F.when(i % 13 == 0, "x").alias("error"),
    )


@query(
    f"""WITH {FILES_SQL}, m AS (SELECT ext, list_sort(list(n_chunks))[count(*) // 2 + 1] AS median FROM f GROUP BY 1)
    SELECT file, ext, n_chunks, median, n_chunks = 0 AS zero_chunks, ext IN ('.py', '.r', '.java') AND size > 200 AND n_structured = 0 AS nothing_structured, n_chunks > greatest(10, 5 * median) AS many_chunks FROM f JOIN m USING (ext)"""
)
def report_anomalies(spark, sf):
    return evaluate.anomalies(_files(spark, sf))


@query(
    f"""WITH {FILES_SQL} SELECT ext, count(*) AS files, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed, coalesce(sum(n_chunks) FILTER (error IS NULL), 0)::BIGINT AS chunks,
    round(avg(n_chunks) FILTER (error IS NULL), 4) AS avg_chunks FROM f GROUP BY 1"""
)
def format_report(spark, sf):
    return evaluate.format_report(_files(spark, sf)).withColumn("avg_chunks", F.round("avg_chunks", 4))


@query(
    "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, string_agg(lang || ':' || n, ';' ORDER BY lang) AS chunk_types FROM c GROUP BY 1"
)
def type_histogram(spark, sf):
    return evaluate.histogram_text(table(spark, sf, "documents"), "source", "lang")


_SHARE = "len(list_intersect({a}, {b})) / nullif(len({a}), 0)::DOUBLE AS {name}"


@query(
    f"""WITH {retrieval.INDEX_SQL}, {retrieval.SCORE_SQL}, t AS (SELECT doc_id AS id, {retrieval.tok("text")} AS w FROM documents),
    c AS (SELECT qid, list_distinct(flatten(list(w))) AS ctx, list_distinct(arg_min(w, rank)) AS resp FROM ranked JOIN t USING (id) WHERE rank <= 5 GROUP BY qid),
    j AS (SELECT c.*, list_distinct({retrieval.tok("b.text")}) AS ask FROM c JOIN benchmark b ON b.item_id = c.qid)
    SELECT qid, {_SHARE.format(a="resp", b="ctx", name="faithfulness")}, {_SHARE.format(a="ask", b="resp", name="answer_relevancy")},
    {_SHARE.format(a="ctx", b="ask", name="context_precision")}, {_SHARE.format(a="ask", b="ctx", name="context_recall")} FROM j"""
)
def judged_answers(spark, sf):
    """Answers (the best source, in place of a model's) under the offline judge, with the grouped report's columns."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    best = stores.settled(retrieval._sparse(spark, sf, 5), "best")
    found = fusion.few(best).join(docs, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("found"))
    ranked = found.select("qid", F.transform("found", lambda x: x["text"]).alias("contexts"))
    rows = retrieval._questions(spark, sf).join(ranked, "qid").withColumns({"reference": F.col("question"), "response": F.get("contexts", F.lit(0)), "abstention_type": F.lit(None).cast("string")})
    return producers.overlap_judge(rows).select("qid", *evaluate.METRICS)


@query(
    f"""WITH {retrieval.INDEX_SQL}, {retrieval.SCORE_SQL} SELECT qid, count(*) FILTER (d.lang = 'en') AS of_kind, bool_or(d.source = 'src1') AS from_file
    FROM ranked JOIN documents d ON d.doc_id = ranked.id WHERE rank <= 5 GROUP BY qid"""
)
def top_proxies(spark, sf):
    """Of the first five results how many are of a kind, and whether one comes from a given file."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("chunk_type"), F.concat(F.lit("a/"), "source").alias("file"))
    return evaluate.proxies(retrieval._sparse(spark, sf, 5), chunks, "src1", "en")


@query(
    """SELECT event_id // 20 AS batch_no, count(*) AS files, count(*) FILTER (event_id % 7 > 0) AS ok, round(sum(value), 4) AS elapsed_s,
    round(count(*) FILTER (event_id % 7 > 0) / count(*)::DOUBLE, 6) AS success FROM events GROUP BY 1"""
)
def batch_report(spark, sf):
    rows = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 20).cast("long").alias("batch_no"), F.when(F.col("event_id") % 7 > 0, "ok").otherwise("failed").alias("status"), F.col("value").alias("elapsed_s")
    )
    return evaluate.batch_report(rows).withColumns({"elapsed_s": F.round("elapsed_s", 4), "success": F.round("success", 6)})


@query(
    """SELECT event_id, (CASE WHEN event_id % 7 > 0 THEN event_id % 40 * 3 ELSE 0 END)::BIGINT AS credits,
    sum(CASE WHEN event_id % 7 > 0 THEN event_id % 40 * 3 ELSE 0 END) OVER (ORDER BY event_id)::BIGINT AS total_credits FROM events"""
)
def cumulative_credits(spark, sf):
    report = table(spark, sf, "events").select("event_id", (F.col("event_id") % 40).alias("pages"), F.when(F.col("event_id") % 7 == 0, "failed").alias("error"))
    return evaluate.cumulative_credits(report, ["event_id"]).select("event_id", "credits", "total_credits")
