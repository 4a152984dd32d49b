"""Runs over files in which one failure does not stop the rest, and their checks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def isolated(rows: DataFrame, key: str, work: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """(key, columns of schema, error): what ``work`` makes of each row. A row on which it fails gives one row
    with the error alone; the rows after it are worked on as if nothing had happened."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for pdf in batches:
            out = []
            for record in pdf.to_dict("records"):
                try:
                    out += [(record[key], *(made.get(n) for n in names), None) for made in work(record)]
                except Exception as e:  # noqa: BLE001
                    out.append((record[key], *(None for _ in names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, {schema}, error string")


def output_status(targets: DataFrame, parsed: DataFrame, key: str = "doc") -> DataFrame:
    """(key, status, error): a parsed document is ok if its block list is there and not empty."""
    blocks = parsed.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"))
    found = targets.select(key).join(blocks, key, "left")
    missing = F.coalesce("blocks", F.lit(0)) == 0
    return found.select(key, F.when(missing, "failed").otherwise("ok").alias("status"), F.when(missing, "no blocks in the output").alias("error"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(dimension, value, n): chunks by type, by each of their flags, and by whether they have a page."""
    flags = F.transform(F.coalesce("chunk_quality_flag", F.array().cast("array<string>")), lambda x: F.struct(F.lit("flag").alias("dimension"), x.alias("value")))
    own = F.array(
        F.struct(F.lit("chunk_type").alias("dimension"), F.col("chunk_type").alias("value")),
        F.struct(F.lit("page").alias("dimension"), F.when(F.col("page_start").isNull(), "absent").otherwise("present").alias("value")),
    )
    return chunks.select(F.explode(F.concat(own, flags)).alias("d")).groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))
