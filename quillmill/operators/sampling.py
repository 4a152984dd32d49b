"""Seeded stratified, diverse and round-robin sampling without a driver-side loop.

A row's place in a shuffle is the SHA-256 of seed and key, so samples are the same in every engine and for
every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.routing import final_related


def shuffled(seed: int, *keys: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)), 256)


def _keys(df: DataFrame, key: str, seed: int, *columns: str) -> DataFrame:
    """The columns that decide, and the place in the shuffle: texts stay where they are until rows are picked."""
    return df.select(*dict.fromkeys([key, *columns]), shuffled(seed, key).alias("h_"))


def stratified(df: DataFrame, target: int, stratum: str, bucket: str, key: str, seed: int, minimum: int = 3) -> DataFrame:
    """About ``target`` rows: every stratum gets max(minimum, target div strata), spread over its buckets and
    filled up from the rest; a shuffle then cuts to the target. ``key`` has to be unique.

    No stratum gets more than ``most`` rows, so each task sends that many of a bucket at most."""
    most = max(minimum, target)
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_"), F.countDistinct(bucket).alias("b_"))
    strata = sizes.agg(F.count(F.lit(1)).alias("s_"))
    share = F.greatest(F.lit(minimum), F.floor(F.lit(target) / F.col("s_")))
    quotas = sizes.join(F.broadcast(strata)).select(stratum, F.least(share, F.col("n_")).cast("long").alias("quota_"), "b_")
    quotas = quotas.withColumn("per_", F.greatest(F.lit(1), F.floor(F.col("quota_") / F.col("b_"))).cast("long"))
    inside = Window.partitionBy(stratum, bucket).orderBy("h_", key)
    rows = _keys(df, key, seed, stratum, bucket).withColumn("in_bucket_", F.row_number().over(inside)).filter(F.col("in_bucket_") <= most)
    first = F.when(F.col("in_bucket_") <= F.col("per_"), 0).otherwise(1)
    order = Window.partitionBy(stratum).orderBy(first, "h_", key)
    picked = rows.join(quotas, stratum).withColumn("nth_", F.row_number().over(order)).filter("nth_ <= quota_")
    return df.join(picked.orderBy("h_", key).limit(target).select(key), key, "left_semi")


def diverse(df: DataFrame, quotas: DataFrame, stratum: str, file: str, key: str, seed: int) -> DataFrame:
    """Per stratum its quota (stratum, quota): at most one row of a file first, then the rest. ``key`` has to
    be unique. Each task sends as many rows of a file, and of a stratum, as the largest quota at most."""
    most = quotas.agg(F.max("quota").alias("q")).first().q or 0
    in_file = Window.partitionBy(stratum, file).orderBy("h_", key)
    rows = _keys(df, key, seed, stratum, file).withColumn("of_file_", F.row_number().over(in_file)).filter(F.col("of_file_") <= int(most))
    order = Window.partitionBy(stratum).orderBy(F.when(F.col("of_file_") == 1, 0).otherwise(1), "h_", key)
    ranked = rows.withColumn("nth_", F.row_number().over(order)).filter(F.col("nth_") <= int(most))
    picked = ranked.join(quotas, stratum).filter("nth_ <= quota")
    return df.join(picked.select(key), key, "left_semi")


def text_strata(df: DataFrame, key: str, seed: int, quota: int = 5, flagged: int = 3) -> DataFrame:
    """Text chunks by quality: a quota each; of the degraded ones up to ``flagged`` with a flag."""
    has = F.coalesce(F.size("chunk_quality_flag"), F.lit(0)) > 0
    rows = df.filter("quality is not null and length(text) >= 150").withColumn("has_", has)
    worse = rows.filter("quality = 'degraded'")
    stratum = F.when(F.col("quality") != "degraded", F.col("quality")).when(F.col("has_"), "degraded+").otherwise("degraded-")
    marked = rows.withColumn("stratum_", stratum)
    n = worse.agg(F.least(F.count(F.when(F.col("has_"), 1)), F.lit(flagged)).alias("f"))
    quotas = marked.select("stratum_").distinct().join(F.broadcast(n)).select(
        "stratum_",
        F.when(F.col("stratum_") == "degraded+", F.col("f")).when(F.col("stratum_") == "degraded-", quota - F.col("f")).otherwise(quota).alias("quota"),
    )
    return diverse(marked, quotas, "stratum_", "file", key, seed).select(df.columns)


def round_robin(df: DataFrame, n: int, stratum: str, file: str, key: str, seed: int) -> DataFrame:
    """n rows, one stratum after the other, in each stratum one row a file. ``key`` has to be unique."""
    in_file = Window.partitionBy(stratum, file).orderBy("h_", key)
    one = _keys(df, key, seed, stratum, file).withColumn("of_file_", F.row_number().over(in_file)).filter("of_file_ = 1")
    turn = Window.partitionBy(stratum).orderBy("h_", key)
    rows = one.withColumn("turn_", F.row_number().over(turn)).filter(F.col("turn_") <= n).withColumn("place_", shuffled(seed, stratum))
    return df.join(rows.orderBy("turn_", "place_", key).limit(n).select(key), key, "left_semi")


def final_exam(chunks: DataFrame, n: int, seed: int) -> DataFrame:
    """n chunks (id, text, course, file) of at least 100 characters from files on finals, course by course."""
    return round_robin(chunks.filter(final_related(F.col("file")) & (F.length("text") >= 100)), n, "course", "file", "id", seed)


def batches(df: DataFrame, order: list[str], size: int, name: str = "batch_no") -> DataFrame:
    """df with the number of its batch of ``size`` rows in the given order (see numbering.dense)."""
    from .numbering import dense

    return dense(df, order, "pos_").withColumn(name, F.floor(F.col("pos_") / size).cast("long")).drop("pos_")
