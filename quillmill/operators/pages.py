"""Page positions: as-of lookup, ranges, formula scores, anchors and image pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import chunk_flags

LOW_CONFIDENCE = 0.6
PROBE = 50


def as_of(offsets: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, offset, page) for offsets (keys, offset) and anchors (keys, pos, seq, page): the page of the last
    anchor at or before the offset, the first anchor's page before that, null without anchors. One window
    over the union of both; no join on an inequality."""
    a = anchors.select(*keys, F.col("pos").alias("p_"), F.lit(0).alias("kind_"), F.col("seq").alias("seq_"), "page", F.lit(None).cast("long").alias("offset"))
    o = offsets.select(*keys, F.col("offset").alias("p_"), F.lit(1).alias("kind_"), F.lit(0).cast("long").alias("seq_"), F.lit(None).cast("int").alias("page"), F.col("offset").cast("long").alias("offset"))
    w = Window.partitionBy(*keys).orderBy("p_", "kind_", "seq_")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    page = F.coalesce(F.last("page", ignorenulls=True).over(upto), F.first("page", ignorenulls=True).over(rest))
    return a.unionByName(o).withColumn("page_", page).filter("kind_ = 1").select(*keys, "offset", F.col("page_").alias("page"))


def page_range_flags(chunks: DataFrame, equations: DataFrame, scores: DataFrame, doc: str, chunk: str) -> DataFrame:
    """(doc, chunk, unverifiable, min_score, low_confidence) for chunks (doc, chunk, page_start, page_end),
    equation pages (doc, page) and lowest scores (doc, page, score). Ranges are exploded to pages, so the
    join stays an equi-join."""
    low, high = F.least("page_start", "page_end"), F.greatest("page_start", "page_end")
    pages = chunks.select(doc, chunk, F.explode_outer(F.when(low.isNotNull(), F.sequence(low, high))).alias("page"))
    marked = equations.select(doc, "page").distinct().withColumn("eq_", F.lit(True))
    joined = pages.join(marked, [doc, "page"], "left").join(scores.select(doc, "page", "score"), [doc, "page"], "left")
    out = joined.groupBy(doc, chunk).agg(F.coalesce(F.bool_or("eq_"), F.lit(False)).alias("unverifiable"), F.min("score").alias("min_score"))
    return out.withColumn("low_confidence", F.coalesce(F.col("min_score") < LOW_CONFIDENCE, F.lit(False)))


def all_flags(text: Column, unverifiable: Column, low: Column) -> Column:
    """The chunk's own flags followed by those of its pages; null if there are none."""
    own = F.coalesce(chunk_flags(text), F.array().cast("array<string>"))
    flags = F.concat(own, F.array_compact(F.array(F.when(unverifiable, "formula_unverifiable"), F.when(low, "formula_low_confidence"))))
    return F.when(F.size(flags) > 0, flags)


def inline_min_scores(middle: DataFrame) -> DataFrame:
    """(doc, page, score): the lowest score of the inline equations of each page. middle: (doc, pdf_info) with
    pages of blocks, nested blocks, lines and spans."""
    page = middle.select("doc", F.posexplode("pdf_info").alias("page", "info"))
    block = page.select("doc", "page", F.explode("info.preproc_blocks").alias("block"))
    nested = F.when(F.size("block.blocks") > 0, F.flatten(F.transform("block.blocks", lambda b: b["lines"])))
    line = block.select("doc", "page", F.explode(F.coalesce(nested, F.col("block.lines"))).alias("line"))
    span = line.select("doc", "page", F.explode("line.spans").alias("span"))
    inline = span.filter("span.type = 'inline_equation' and span.score is not null")
    return inline.groupBy("doc", "page").agg(F.min("span.score").alias("score"))


def equation_pages(blocks: DataFrame) -> DataFrame:
    """(doc, page): pages with an equation block."""
    return blocks.filter("type = 'equation'").select("doc", F.col("page_idx").alias("page")).distinct()


def anchors(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, pos, seq, page) from texts (doc, text) and blocks (doc, seq, type, text, code_body, page_idx): each
    block's first characters are looked for behind the last find, then anywhere; what is not found is left
    out. The cursor makes this sequential within a document, so it runs per document."""
    body = F.when(F.col("type").isin("text", "equation"), F.col("text")).when(F.col("type") == "code", F.col("code_body"))
    probes = blocks.select("doc", "seq", "page_idx", body.alias("probe")).filter("probe is not null and trim(probe) <> ''")
    listed = probes.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "page_idx", F.substr("probe", F.lit(1), F.lit(PROBE)).alias("probe")))).alias("probes"))

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text, found in zip(pdf["doc"], pdf["text"], pdf["probes"]):
                cursor = 0
                for p in found:
                    probe = p["probe"].strip()
                    at = text.find(probe, cursor) if probe else -1
                    at = text.find(probe) if at < 0 and probe else at
                    if at >= 0:
                        rows.append((doc, at, p["seq"], p["page_idx"]))
                        cursor = at + len(probe)
            yield pd.DataFrame(rows, columns=["doc", "pos", "seq", "page"])

    return texts.join(listed, "doc").select("doc", "text", "probes").mapInPandas(run, "doc string, pos long, seq long, page int")


def image_pages(blocks: DataFrame) -> DataFrame:
    """(doc, img, page) from blocks (doc, seq, type, img_path, table_body, page_idx): the last block that names
    an image directly decides; else the first table whose cells hold it."""
    direct = blocks.filter("type in ('image','equation','chart','table') and coalesce(img_path, '') <> ''").select("doc", F.col("img_path").alias("img"), "seq", "page_idx", F.lit(True).alias("direct"))
    nested = blocks.filter("type = 'table'").select(
        "doc", F.explode(F.regexp_extract_all(F.coalesce("table_body", F.lit("")), F.lit(r'<img[^>]*src="(images/[^"]+)"'), F.lit(1))).alias("img"), "seq", "page_idx", F.lit(False).alias("direct")
    )
    every = direct.unionByName(nested)
    return every.groupBy("doc", "img").agg(
        F.coalesce(F.max_by(F.when(F.col("direct"), F.col("page_idx")), F.when(F.col("direct"), F.col("seq"))), F.min_by("page_idx", "seq")).alias("page")
    )
