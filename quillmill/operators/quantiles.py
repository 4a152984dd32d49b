"""Exact quantiles by repeated narrowing: no buffer grows with the number of distinct values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a round, and rows that are fetched once no more are left between the bounds.
BUCKETS, FETCHED = 1_024, 4_096


def finite(df: DataFrame, column: str) -> DataFrame:
    """(v_): the values that are neither null nor infinite nor no number, as doubles."""
    values = df.select(F.col(column).cast("double").alias("v_"))
    return values.filter(~F.isnan("v_") & (F.abs("v_") < F.lit(float("inf"))))


def value_at(values: DataFrame, place: int) -> float:
    """The v_ at the 0-based ``place`` of the sorted rows of finite().

    Each round counts the values between two bounds in buckets of equal width and keeps the one that holds the place,
    with its own least and greatest value as the next bounds: the bounds always close in, equal values included. At
    most BUCKETS rows reach the driver, or FETCHED values once that few are left."""
    ends = values.agg(F.min("v_").alias("low"), F.max("v_").alias("high")).first()
    low, high = ends.low, ends.high
    while low < high:
        inside = values.filter(F.col("v_").between(low, high))
        width = (high / BUCKETS - low / BUCKETS) or math.ulp(0.0)
        bucket = F.least(F.floor((F.col("v_") - low) / width), F.lit(BUCKETS - 1))
        each = inside.groupBy(bucket.alias("b")).agg(F.min("v_").alias("low"), F.max("v_").alias("high"), F.count(F.lit(1)).alias("n"))
        for r in each.orderBy("b").collect():
            if place < r.n:
                break
            place -= r.n
        low, high = r.low, r.high
        if low < high and r.n <= FETCHED:
            return values.filter(F.col("v_").between(low, high)).orderBy("v_").collect()[place].v_
    return low


def median(df: DataFrame, column: str) -> float | None:
    """The middle one of the finite values, or the mean of the two in the middle; null without any."""
    values = finite(df, column)
    n = values.count()
    if not n:
        return None
    lower = value_at(values, (n - 1) // 2)
    if n % 2:
        return lower
    upper = values.agg(F.count_if(F.col("v_") <= lower).alias("upto"), F.min(F.when(F.col("v_") > lower, F.col("v_"))).alias("next")).first()
    return (lower + (lower if upper.upto > n // 2 else upper.next)) / 2
