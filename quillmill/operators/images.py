"""Image rows: text and descriptions from outside producers, with retries and rows for what failed."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import image_kept, ocr_tier

DESCRIBED = "ocr_text string, ocr_conf double, vlm_desc string, tokens_in long, tokens_out long, error string"


def data_url(content: Column, ext: Column) -> Column:
    """An image as the URL that describing models take; jpg is named jpeg."""
    kind = F.regexp_replace(F.lower(F.regexp_replace(ext, r"^\.", "")), "^jpg$", "jpeg")
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(content))


def selected(images: DataFrame, by: str = "source") -> DataFrame:
    """Of images (path, source, sha256, size, width, height) the first of each content within its source, and
    of those the ones that are large enough; the size is looked at after the copies."""
    first = images.groupBy(by, "sha256").agg(F.min_by(F.struct(*images.columns), "path").alias("r")).select("r.*")
    return first.filter(image_kept(F.col("size"), F.col("width"), F.col("height")))


def attempted(call: Callable, value, tries: int, wait: float, sleep: Callable[[float], None]):
    """(result, None) of the first call that succeeds, or (None, error) of the last; each pause is twice the
    one before."""
    for n in range(tries):
        try:
            return call(value), None
        except Exception as e:  # noqa: BLE001  a producer's failure is a row, not the end of the job
            error = f"{type(e).__name__}: {e}"
            if n + 1 < tries:
                sleep(wait * 2**n)
    return None, error


def described(
    images: DataFrame,
    ocr: Callable[[bytes], list[tuple[str, float]]],
    describe: Callable[[bytes], tuple[str, int, int]],
    tries: int = 5,
    wait: float = 1.0,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """images (with content) with ocr_text, ocr_conf, vlm_desc, tokens_in, tokens_out, error and tier.

    ``ocr`` gives a list of (text, confidence); the mean confidence (0.0 without any) decides whether the image
    is described by ``describe`` (text, tokens in, tokens out) as well or instead. A call that fails is made
    anew up to ``tries`` times; what fails then is a row with its error, for a later run to take up."""

    def run(batches):
        for pdf in batches:
            rows = []
            for data in pdf["content"]:
                boxes, error = attempted(ocr, bytes(data), tries, wait, sleep)
                mean = sum(c for _, c in boxes) / len(boxes) if boxes else 0.0
                text = " ".join(t for t, _ in boxes or ())
                said = ("", 0, 0)
                if error is None and mean <= 0.85:
                    found, error = attempted(describe, bytes(data), tries, wait, sleep)
                    said = found or said
                rows.append((text, mean, *said, error))
            yield pdf.drop(columns="content").assign(**dict(zip(("ocr_text", "ocr_conf", "vlm_desc", "tokens_in", "tokens_out", "error"), zip(*rows))))

    kept = [c for c in images.columns if c != "content"]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*kept).schema), DESCRIBED])
    out = images.select(*kept, "content").mapInPandas(run, shape)
    return out.withColumn("tier", F.when(F.col("error").isNull(), ocr_tier(F.col("ocr_conf"))))


