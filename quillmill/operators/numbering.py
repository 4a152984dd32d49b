"""Dense global numbers without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample from which the borders of ranges are taken, for each range and in all.
SAMPLE, SAMPLE_MOST = 40, 20_000


def range_of(df: DataFrame, names: list[str]) -> Column:
    """The number of the range of the order that a row falls into, as a column: one range for each shuffle
    partition. Borders are those of a bounded sample by hash, so equal inputs get equal ranges."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = F.xxhash64(*names)
    some = df.select(*names, h.alias("h_")).orderBy("h_", *names).limit(min(SAMPLE * ranges, SAMPLE_MOST)).select(F.sort_array(F.collect_list(F.struct(*names))).alias("all"))
    # The borders travel as one row: every size-th of the sorted sample.
    size = F.greatest(F.lit(1), F.floor(F.size("all") / ranges)).cast("int")
    borders = some.select(F.filter("all", lambda _, i: (i > 0) & (i % size == 0)).alias("borders")).first().borders
    return place(df, names, borders)


def place(df: DataFrame, names: list[str], borders: list) -> Column:
    """How many of the sorted borders, rows of ``names``, are not above a row, as a column."""
    schema = df.select(*names).schema
    own = F.struct(*names)
    literal = F.array(*(F.struct(*(F.lit(v).cast(schema[n].dataType).alias(n) for n, v in zip(names, b))) for b in borders)) if borders else None
    if literal is None:
        return F.lit(0)
    # A binary search in steps of falling powers of two: as many borders are not above the row as the steps add up to.
    steps = F.array(*(F.lit(1 << i) for i in range(len(borders).bit_length() - 1, -1, -1)))
    fits = lambda at, step: F.coalesce(F.get(literal, at + step - 1) <= own, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def dense(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with the 0-based position of each row in the order. Rows are dealt to ranges of the whole order;
    ranges are counted, and a row's number is its place in its range plus what the ranges before hold. Only
    the counts, one row for each range, meet in one task."""
    spread = df.withColumn("range_", range_of(df, order))
    per = spread.groupBy("range_").agg(F.count(F.lit(1)).alias("rows_"))
    first = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("range_", F.coalesce(F.sum("rows_").over(first), F.lit(0)).alias("before_"))
    inside = Window.partitionBy("range_").orderBy(*order)
    placed = spread.withColumn("place_", F.row_number().over(inside))
    numbered = placed.join(F.broadcast(offsets), "range_")
    return numbered.withColumn(name, (F.col("place_") - 1 + F.col("before_") + start).cast("long")).drop("range_", "before_", "place_")


def running_sum(df: DataFrame, value: Column, order: list[str], by: list[str], name: str) -> DataFrame:
    """df with the running total of value within ``by``, in the order. As in dense(), a group is dealt to
    ranges of the order: a total is that inside the range plus the totals of the group's ranges before."""
    spread = df.withColumn("value_", value).withColumn("range_", range_of(df, order))
    per = spread.groupBy(*by, "range_").agg(F.sum("value_").alias("sum_"))
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*(F.col(c).alias(f"{c}_by_") for c in by), F.col("range_").alias("range_of_"), F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("before_"))
    inside = Window.partitionBy(*by, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = spread.withColumn("part_", F.sum("value_").over(inside))
    same = F.col("range_") == F.col("range_of_")
    for c in by:
        same = same & part[c].eqNullSafe(F.col(f"{c}_by_"))
    return part.join(offsets, same).withColumn(name, F.col("part_") + F.col("before_")).select(*df.columns, name)


def chunk_ids(df: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """df with chunk_id: prefix_00000, prefix_00001, ... in the order."""
    numbered = dense(df, order, "number_")
    return numbered.withColumn("chunk_id", F.format_string(prefix + "_%05d", "number_")).drop("number_")
