"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's rate is the mass it should have in the mix over the mass it has. Each document is repeated k
times, where k is the inverse of the Poisson distribution with that mean at a uniform number taken from a
hash of the document's id: on average the rate, the same in every run, and independent of how the table is
partitioned. The copies are then shuffled globally by a hash of (id, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A rate is split into parts of this size at most; the sum of independent Poisson numbers is Poisson.
PART = 64.0
#: Terms of a part's distribution: what lies beyond has a probability under 2^-53.
TERMS = 200
#: Sources up to this number have their rates broadcast (1.6 kB each).
BROADCAST_SOURCES = 5_000
#: Beyond it a source's rows are dealt to so many parts.
SALTS = 16


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the parts' SHA-256."""
    digest = F.sha2(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def drawn_by(row_id: str, text: str) -> Column:
    """What a row's numbers are drawn by: its id, or without one a digest of its text."""
    return F.coalesce(F.col(row_id).cast("string"), F.concat(F.lit("null-"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def distribution(rate: Column) -> Column:
    """P(k <= j) for j = 0, 1, ... up to TERMS, by the recurrence p(j) = p(j - 1) rate / j."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))

    def step(acc: Column, j: Column) -> Column:
        p = acc["p"] * rate / j
        total = acc["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["all"])


def rates(df: DataFrame, source: str, text: str, weights: dict[str, float] | DataFrame | None, total: float | None) -> DataFrame:
    """(source, rate, parts, cdf). Mass is characters. A source without any keeps its rows once each (rate
    1) and takes no part in the weights; a source that ``weights`` does not name has weight 1."""
    mass = df.groupBy(F.col(source).alias("src")).agg(F.sum(F.length(text)).alias("mass"))
    mass = mass.withColumn("mass", F.coalesce("mass", F.lit(0)))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col(weights.columns[0]).alias("w_src"), F.col(weights.columns[1]).cast("double").alias("w"))
        mass = mass.join(given, F.col("src").eqNullSafe(F.col("w_src")), "left").drop("w_src")
    else:
        pairs = [F.lit(x) for kv in (weights or {}).items() for x in (kv[0], float(kv[1]))]
        mass = mass.withColumn("w", F.element_at(F.create_map(*pairs), F.coalesce("src", F.lit(""))) if pairs else F.lit(None).cast("double"))
    mass = mass.withColumn("w", F.when(F.col("mass") > 0, F.coalesce("w", F.lit(1.0))))
    mass = common.materialise(mass, "mix-mass")
    sums = mass.agg(F.sum("mass").alias("mass"), F.sum("w").alias("w")).first()
    target = float(total if total is not None else sums.mass or 0)
    rate = F.when(F.col("mass") > 0, F.lit(target) * F.col("w") / F.lit(sums.w or 1.0) / F.col("mass")).otherwise(1.0)
    found = mass.withColumn("rate", rate)
    found = found.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    return found.select("src", "rate", "parts", distribution(F.col("rate") / F.col("parts")).alias("cdf"))


def mix(
    df: DataFrame,
    weights: dict[str, float] | DataFrame | None = None,
    total: float | None = None,
    source: str = "source",
    text: str = "text",
    row_id: str = "doc_id",
    seed: int = 1,
) -> DataFrame:
    """The rows of df, each as often as its number says, in random order, with replica (1, 2, ...) and
    mix_key, the number by which they are ordered inside a partition.

    ``weights``: the sources' shares of the mix, by name (equal by default); ``total``: the characters that
    the mix should have (by default those of df). Rows with a null source form a source of their own, with
    weight 1 unless a weights table names null. Rows with equal ids are repeated equally often; rows without an id
    draw by their text, so equal texts are repeated equally often and different ones independently. Texts that
    are null or empty weigh nothing and follow their source's rate. An empty table gives an empty result. If
    df has columns named like the two new ones, those get a leading underscore."""
    src, parts, cdf, rate, times = common.fresh(df, "mix_src_", "mix_parts_", "mix_cdf_", "mix_rate_", "mix_times_")
    salt, salt_of_rate = common.fresh(df, "mix_salt_", "salt_of_rate_")
    replica, key = common.fresh(df, "replica", "mix_key")
    found = common.materialise(rates(df, source, text, weights, total), "mix-rates").toDF(src, rate, parts, cdf)
    same = df[source].eqNullSafe(F.col(src))
    if common.rows_at_most(found, BROADCAST_SOURCES):
        rows = df.join(F.broadcast(found), same)
    else:  # a source may hold a third of all rows: its rows meet its rate in so many parts
        salted = df.withColumn(salt, F.pmod(F.xxhash64(row_id, text), F.lit(SALTS)).cast("int"))
        copies = found.withColumn(salt_of_rate, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = salted.join(copies, same & (F.col(salt) == F.col(salt_of_rate))).drop(salt, salt_of_rate)
    # One digest for each part: drawn outside the scan of the distribution, which would repeat it for each term.
    draws = F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda i: uniform(F.lit(seed), drawn_by(row_id, text), i))
    draw = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    # Not filtered by the number of times, which the optimiser would work out again in the join; null explodes to nothing.
    rows = rows.withColumn(times, draw)
    several = F.when(F.col(times) > 0, F.sequence(F.lit(1), F.col(times)))
    rows = rows.withColumn(replica, F.explode(several)).select(*df.columns, replica)
    rows = rows.withColumn(key, uniform(F.lit(f"{seed}-order"), drawn_by(row_id, text), F.col(replica)))
    return rows.repartition(key).sortWithinPartitions(key)
