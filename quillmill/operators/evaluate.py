"""Grouped evaluation, report statistics and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import running_sum
from .quantiles import median

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def summary(results: DataFrame) -> DataFrame:
    """Means that leave out nulls, counts of what they rest on, hit rate and honesty: overall, and by test
    category, abstention type, source type and, for text, quality, in one pass of grouping sets."""
    quality = F.when(F.col("source_type") == "text", F.col("quality"))
    dims = ["test_category", "abstention_type", "source_type", "text_quality"]
    rows = results.withColumn("text_quality", quality)
    aggs = [F.avg(m).alias(m) for m in METRICS] + [F.count(m).alias(f"{m}_n") for m in METRICS]
    aggs += [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("target_retrieved").cast("double")).alias("hit_rate"),
        F.avg(F.when(F.col("abstention_honesty"), 1.0).otherwise(0.0)).alias("honesty"),
    ]
    sets = [[d] for d in dims]
    grouped = rows.groupingSets([[], *sets], *dims).agg(F.grouping_id().alias("gid"), *aggs)
    label = F.when(F.col("gid") == 7, "test_category").when(F.col("gid") == 11, "abstention_type").when(F.col("gid") == 13, "source_type").when(F.col("gid") == 14, "text_quality").otherwise("all")
    out = grouped.withColumn("dimension", label).withColumn("value", F.coalesce(*dims))
    return out.filter("dimension = 'all' or value is not null").drop("gid", *dims)


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(hit_before, hit_after, n) of two sets of hits (qid, hit)."""
    both = before.select("qid", F.col("hit").alias("hit_before")).join(after.select("qid", F.col("hit").alias("hit_after")), "qid")
    return both.groupBy("hit_before", "hit_after").agg(F.count(F.lit(1)).alias("n"))


def compare(baseline: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: hits of three runs, and what the second gains and loses against the baseline."""
    b, x, y = (df.select("qid", F.col("hit").alias(n)) for df, n in ((baseline, "b"), (first, "x"), (second, "y")))
    return b.join(x, "qid").join(y, "qid").agg(
        F.count_if("b").alias("baseline_hits"), F.count_if("x").alias("first_hits"), F.count_if("y").alias("second_hits"),
        F.count_if(F.expr("y and not b")).alias("gained"), F.count_if(F.expr("b and not y")).alias("lost"), F.count(F.lit(1)).alias("n"),
    )


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Dollars at prices per million tokens."""
    return (tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) / F.lit(1e6)


def latency_report(calls: DataFrame, price_in: float = 0.15, price_out: float = 0.60) -> DataFrame:
    """Latency and token statistics of calls (latency, tokens_in, tokens_out). The median is found by narrowing, so no
    task holds all distinct latencies."""
    return calls.agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency").alias("mean_latency"), F.lit(median(calls, "latency")).cast("double").alias("median_latency"),
        F.max("latency").alias("max_latency"), F.min("latency").alias("min_latency"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        cost(F.sum("tokens_in"), F.sum("tokens_out"), price_in, price_out).alias("cost"),
    )


def running(df: DataFrame, value: Column, order: list[str], by: list[str], name: str) -> DataFrame:
    """df with the running total of value within ``by`` (see numbering.running_sum)."""
    return running_sum(df, value, order, by, name)


def proxies(top: DataFrame, chunks: DataFrame, file: str, kind: str = "sql_statement", k: int = 5) -> DataFrame:
    """(qid, of_kind, from_file) of ranked results (qid, id, rank) and chunks (id, chunk_type, file): how many of
    the first k are of the kind, and whether any comes from the file."""
    found = top.filter(F.col("rank") <= k).join(chunks.select("id", "chunk_type", "file"), "id")
    named = F.element_at(F.split(F.regexp_replace("file", r"\\\\", "/"), "/"), -1) == file
    return found.groupBy("qid").agg(
        F.count_if(F.col("chunk_type") == kind).alias("of_kind"), F.coalesce(F.bool_or(named), F.lit(False)).alias("from_file")
    )


def batch_report(rows: DataFrame) -> DataFrame:
    """(batch_no, files, ok, elapsed_s, success) of parsed files (batch_no, status, elapsed_s)."""
    ok = F.count_if(F.col("status") == "ok")
    return rows.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("files"), ok.alias("ok"), F.sum("elapsed_s").alias("elapsed_s"), (ok / F.count(F.lit(1))).alias("success")
    )


def cumulative_credits(report: DataFrame, order: list[str], per_page: int = 3) -> DataFrame:
    """The report's rows (pages, error) with credits, which only parsed files cost, and their running total."""
    spent = report.withColumn("credits", F.when(F.coalesce(F.col("error"), F.lit("")) == "", F.coalesce("pages", F.lit(0)) * per_page).otherwise(0).cast("long"))
    return running_sum(spent, F.col("credits"), order, [], "total_credits")


def format_report(files: DataFrame) -> DataFrame:
    """Per format (ext, n_chunks, error): files, ok, failed, chunks and chunks per parsed file."""
    ok = F.col("error").isNull()
    return files.groupBy("ext").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("n_chunks"))), F.lit(0)).alias("chunks"), F.avg(F.when(ok, F.col("n_chunks"))).alias("avg_chunks"),
    )


def anomalies(files: DataFrame) -> DataFrame:
    """(file, ext, n_chunks, median, zero_chunks, nothing_structured, many_chunks) of files (file, ext, size,
    n_chunks, n_structured): parsed to nothing; over 200 bytes without a structured chunk; over five times
    the upper median of the format and over ten. The median (the element at n div 2) is found on the counts of
    each format's distinct values, so no format's rows are gathered."""
    values = files.groupBy("ext", "n_chunks").agg(F.count(F.lit(1)).alias("files_"))
    upto = Window.partitionBy("ext").orderBy("n_chunks").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("ext")
    counted = values.withColumn("upto_", F.sum("files_").over(upto)).withColumn("all_", F.sum("files_").over(whole))
    middle = counted.filter("upto_ > all_ div 2").groupBy("ext").agg(F.min("n_chunks").alias("median"))
    structured = F.col("ext").isin(".py", ".r", ".java")
    return files.join(F.broadcast(middle), "ext").select(
        "file", "ext", "n_chunks", "median", (F.col("n_chunks") == 0).alias("zero_chunks"),
        (structured & (F.col("size") > 200) & (F.col("n_structured") == 0)).alias("nothing_structured"),
        (F.col("n_chunks") > F.greatest(F.lit(10), 5 * F.col("median"))).alias("many_chunks"),
    )


def histogram_text(df: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, chunk_types): 'kind:count;...' in order of kind."""
    counts = df.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"))
    pair = F.struct(F.col(kind).alias("k"), F.concat_ws(":", F.col(kind), F.col("n").cast("string")).alias("s"))
    listed = counts.groupBy(group).agg(F.array_sort(F.collect_list(pair)).alias("all"))
    return listed.select(group, F.array_join(F.transform("all", lambda x: x["s"]), ";").alias("chunk_types"))


def keep_first(df: DataFrame, content: str, by: list[str], order: str) -> DataFrame:
    """Of rows with equal content (by SHA-256) within ``by`` the first in order, which has to tell rows of one digest
    apart. Only the order's values are aggregated; whole rows are joined back by digest and value."""
    rows = df.withColumn("sha_", F.sha2(F.col(content), 256))
    first = rows.groupBy(*by, "sha_").agg(F.min(order).alias("first_"))
    same = rows[order].eqNullSafe(first["first_"])
    for c in (*by, "sha_"):
        same = same & rows[c].eqNullSafe(first[c])
    return rows.join(first, same, "left_semi").withColumnRenamed("sha_", "sha256")
