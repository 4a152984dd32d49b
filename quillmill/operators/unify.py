"""One schema for chunks of all sources, their ids, and export to flat stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.routing import flat_flags
from ..functions.text import blank
from . import numbering

# Chunk types whose borders come from patterns, not from a parser.
PATTERN_TYPES = ["r_function", "r_toplevel", "java_method", "java_constructor", "java_toplevel"]


def conform(df: DataFrame) -> DataFrame:
    """df in the chunk schema: missing columns null, known ones cast, others left out."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CHUNK]
    )


def code_chunks(parsed: DataFrame) -> DataFrame:
    """Parser output (file, course, seq, chunk_type, name, text, locator, ...) in the chunk schema, blank
    chunks dropped, with code_ ids in order of file and place."""
    rough = F.col("chunk_type").isin(*PATTERN_TYPES)
    kind = F.when(F.col("chunk_type").startswith("ipynb_"), "cell_index").when(F.col("chunk_type") == "sql_statement", "statement_index")
    none = F.lit(None)
    position = F.struct(
        none.cast("int").alias("page_start"), none.cast("int").alias("page_end"), none.cast("bigint").alias("char_start"),
        none.cast("bigint").alias("char_end"), none.cast("boolean").alias("estimated"), none.cast("string").alias("note"),
        kind.alias("locator_type"), F.col("locator").alias("value"),
    )
    rows = parsed.filter(~blank(F.col("text"))).withColumns({
        "source_type": F.lit("code"),
        "position": F.when(F.col("locator").isNotNull(), position),
        "extraction_confidence": F.when(rough, "medium").otherwise("high"),
        "chunk_quality_flag": F.when(rough, F.array(F.lit("regex_derived_lower_precision"))),
        "source_note": F.when(rough, "borders found by patterns and bracket counting").otherwise(""),
    })
    return conform(numbering.chunk_ids(rows, ["file", "seq"], "code"))


def image_chunks(images: DataFrame) -> DataFrame:
    """Image rows (path, file, course, source, tier, ocr_text, vlm_desc, ocr_conf, page_idx, error) in the chunk
    schema: of a path's attempts the last without an error counts; pages are kept 0-based."""
    from ..functions.routing import citation, image_chunk_type, image_text

    good = images.filter("error is null or error = ''").filter("coalesce(tier, '') <> ''")
    page = F.col("page_idx").cast("int")
    none = F.lit(None)
    note = F.when(page.isNotNull(), "page of the parsed document").when(F.col("source") == "standalone", "a file of its own").otherwise("no page found")
    position = F.struct(
        page.alias("page_start"), page.alias("page_end"), none.cast("bigint").alias("char_start"), none.cast("bigint").alias("char_end"),
        F.lit(False).alias("estimated"), note.alias("note"), none.cast("string").alias("locator_type"), none.cast("array<int>").alias("value"),
    )
    rows = good.withColumns({
        "text": image_text(F.col("file"), F.col("ocr_text"), F.col("vlm_desc")), "source_type": F.lit("image"),
        "chunk_type": image_chunk_type(F.col("tier")), "position": position, "quality": F.lit("good"),
        "source_citation": citation(F.col("course"), F.col("file"), page, page), "parsed_by": F.col("source"),
        "ocr_confidence": F.expr("try_cast(ocr_conf as double)"), "extraction_confidence": F.lit("medium"),
    })
    return conform(numbering.chunk_ids(rows, ["path"], "img"))


def merge(*sources: DataFrame) -> DataFrame:
    """All sources one after the other, with source_ord."""
    out = None
    for i, df in enumerate(sources):
        part = conform(df).withColumn("source_ord", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def flat_metadata(struct: Column, lists: list[str], nested: list[str], plain: list[str]) -> Column:
    """A map for stores that take no nulls, lists or structs: lists joined by commas, structs as JSON."""
    entries = [F.struct(F.lit(n).alias("k"), flat_flags(struct[n]).alias("v")) for n in lists]
    entries += [F.struct(F.lit(n).alias("k"), F.to_json(struct[n]).alias("v")) for n in nested]
    entries += [F.struct(F.lit(n).alias("k"), struct[n].cast("string").alias("v")) for n in plain]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(course, files, chunks) per course."""
    return chunks.groupBy("course").agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("chunks"))


#: What each quality flag means to a reader.
FLAG_MEANINGS = {
    "formula_missing": "formulas were not decoded",
    "has_unresolved_image": "an image has no text",
    "fragmented": "the text is fragmented",
    "regex_derived_lower_precision": "borders found by patterns",
    "possible_no_header": "the table may have no header",
    "formula_unverifiable": "displayed formulas carry no score",
    "formula_low_confidence": "a formula was read with low confidence",
}


def flag_dimension(spark) -> DataFrame:
    return spark.createDataFrame(list(FLAG_MEANINGS.items()), "flag string, meaning string")


def rendered(chunks: DataFrame, limit: int = 2000) -> DataFrame:
    """Chunks as a reader sees them: a preview of at most ``limit`` characters, as markdown or plain."""
    cut = F.length("text") > limit
    return chunks.withColumns({
        "preview": F.when(cut, F.concat(F.substr("text", F.lit(1), F.lit(limit)), F.lit("..."))).otherwise(F.col("text")),
        "render": F.when(F.col("source_type").isin("text", "image"), "markdown").otherwise("plain"),
    })
