"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three stages, each of which groups by the whole normalised text next to its digest, so two texts that
share a digest are never taken for one another:

1. *local*: Spark's partial aggregate merges the equal texts of one task before anything is sent;
2. *salted*: what is left meets by (digest, salt), where the salt comes from the row's id (without one from
   the task that reads it), so the tasks' winners of a text with very many copies spread over ``salts`` tasks;
3. *global*: at most ``salts`` winners of each text meet by digest.

The decisions are joined back to the rows by digest, which carries no text. Only digests that turn out to
hold several texts take a second way, which compares the text once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def sha256_hex(normalised: Column) -> Column:
    return F.sha2(normalised, 256)


def assign(
    df: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    normalise=common.strip_ascii_space,
    digest=sha256_hex,
    salts: int = 8,
) -> DataFrame:
    """One row per row of df: the id, keep_id, group_size, kept and digest (named text_sha256).

    Of rows whose normalised texts are equal, that with the longest original text (in code points) stays,
    then that with the smallest id. A null text counts as empty, so null and blank texts form one group.
    Rows with a null id count in their group but stay only where no row with an id is as long. Of rows that
    repeat the id of the one that stays, exactly one is kept. An empty table gives an empty result. Other
    columns of df are not looked at, whatever their names.
    """
    src = df.select(F.col(row_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    src = src.select("id", F.length("raw").alias("n"), normalise(F.col("raw")).alias("body"))
    src = src.withColumn("digest", digest(F.col("body")))

    # 1 and 2: min and count have fixed-width buffers, so both sides of the exchange are hash aggregates.
    salted = (
        src.withColumn("salt", F.pmod(F.when(F.col("id").isNull(), F.spark_partition_id()).otherwise(F.xxhash64("id")), F.lit(salts)).cast("int"))
        .groupBy("digest", "salt", "body", "n")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    )
    # 3: all aggregates below are satisfied by one exchange on the digest.
    merged = (
        salted.repartition("digest")
        .groupBy("digest", "body", "n")
        .agg(F.min("id").alias("id"), F.sum("size").alias("size"))
    )
    texts = merged.groupBy("digest", "body").agg(
        F.max_by("id", "n").alias("keep_id"), F.sum("size").alias("group_size")
    )
    groups = texts.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"),
        F.min("keep_id").alias("keep_id"),
        F.min("group_size").alias("group_size"),
    )
    # The decisions are a small part of the texts that they come from: without this, each task of the merge would
    # write a tiny file of its own, and every file costs its executor a few processes.
    groups = common.materialise(groups.hint("rebalance", "digest"), "exact-groups")

    rows = src.select("id", "n", "digest")
    single = groups.filter("texts = 1").drop("texts")
    found = rows.join(single, "digest")
    clashing = groups.filter("texts > 1").select("digest")
    if clashing.limit(1).count():
        theirs = src.join(clashing, "digest", "left_semi")
        found = found.unionByName(
            theirs.join(texts.join(clashing, "digest", "left_semi"), ["digest", "body"]).drop("body")
        )
    # An exchange of ids and digests keeps the join above free to split a hot digest; rows without an id spread.
    # Without a fixed number of partitions, adaptive execution joins small ones.
    first = Window.partitionBy("id", "digest", "keep_id").orderBy(F.desc("n"))
    ranked = found.repartition("id", "digest").withColumn("nth", F.row_number().over(first))
    return ranked.select(
        F.col("id").alias(row_id),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(df: DataFrame, text: str = "text", row_id: str = "doc_id", **options) -> DataFrame:
    """The rows of df that stay, with all their columns. Cases are those of :func:`assign`; of rows that
    repeat both id and text one stays, and rows with a null id stay if their text has no other row."""
    key, same, nth, kept, left = common.fresh(df, "key_", "same_", "nth_", "kept_id_", "kept_digest_")
    normalise, digest = options.get("normalise", common.strip_ascii_space), options.get("digest", sha256_hex)
    null_id = F.lit(common.LONG_MIN)
    stay = assign(df, text, row_id, **options).filter("kept")
    stay = stay.select(F.coalesce(row_id, null_id).alias(kept), F.col("text_sha256").alias(left))
    keyed = df.withColumn(key, F.coalesce(F.col(row_id).cast("long"), null_id))
    keyed = keyed.withColumn(same, digest(normalise(F.coalesce(F.col(text), F.lit("")))))
    # One exchange of the rows, by id and digest, serves the window and the join: rows without an id spread.
    window = Window.partitionBy(key, same).orderBy(F.desc(F.length(F.col(text))))
    ranked = keyed.repartition(common.partitions(df), key, same).withColumn(nth, F.row_number().over(window))
    hit = ranked.filter(F.col(nth) == 1).join(stay, (F.col(key) == F.col(kept)) & (F.col(same) == F.col(left)))
    return hit.select(df.columns)
