"""Column expressions for extraction quality: ratios, densities, verdicts, flags and tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Thresholds of the quality rules.
GARBLED_LIMIT = 0.08
FRAGMENT_LIMIT = 0.10
FORMULA_LIMIT = 2.0
CHARS_PER_PAGE = (100.0, 500.0)
CHARS_PER_KB = (1.0, 3.0)
MIN_TOKENS = 20
MIN_LINES = 20
FORMULA_MARK = "formula-not-decoded"
IMAGE_MARK = "<!-- image -->"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def size_bucket(size: Column) -> Column:
    return F.when(size < 300_000, "small").when(size < 3_000_000, "medium").otherwise("large")


def _implausible(word: Column) -> Column:
    letters = F.length(word)
    odd = ~word.rlike("[aeiouyAEIOU]") | (F.regexp_count(F.substr(word, F.lit(2), letters), F.lit("[A-Z]")) >= 2)
    return (letters >= 3) & ((letters > 25) | ((word != F.upper(word)) & odd))


def garbled_ratio(text: Column) -> Column:
    """The share of implausible words among all ASCII words; null for fewer than 20 words. A word of three
    letters or more is implausible if it has over 25, or is not all capitals and has no vowel or two capitals
    after the first letter. A capital Y is no vowel."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    return F.when(F.size(words) >= MIN_TOKENS, F.size(F.filter(words, _implausible)) / F.size(words))


def formula_density(text: Column) -> Column:
    """Undecoded formulas per thousand characters; 0 for an empty text."""
    count = F.regexp_count(text, F.lit(FORMULA_MARK))
    return F.when(F.length(text) > 0, count / (F.length(text) / F.lit(1000.0))).otherwise(F.lit(0.0))


def fragmentation_ratio(text: Column) -> Column:
    """The share of lines of up to three characters among lines that are neither blank nor structure; null
    for fewer than 20 such lines."""
    lines = F.transform(F.split(text, LINE_END), strip)
    kept = F.filter(
        lines,
        lambda x: (x != "") & ~(x.startswith("<!--") | x.startswith("|") | x.startswith("#") | x.startswith("```")),
    )
    return F.when(F.size(kept) >= MIN_LINES, F.size(F.filter(kept, lambda x: F.length(x) <= 3)) / F.size(kept))


def output_density(chars: Column, pages: Column, size: Column) -> Column:
    """(value, unit, severity): characters a page, or a kilobyte where pages are unknown."""
    paged = F.coalesce(pages, F.lit(0)) > 0
    value = F.when(paged, chars / F.when(paged, pages)).otherwise(chars / F.greatest(size / F.lit(1024.0), F.lit(1e-9)))

    def severity(limits: tuple[float, float]) -> Column:
        return F.when(value < limits[0], "severe_low").when(value < limits[1], "moderate_low").otherwise("normal")

    return F.struct(
        value.alias("value"),
        F.when(paged, "chars/page").otherwise("chars/KB").alias("unit"),
        F.when(paged, severity(CHARS_PER_PAGE)).otherwise(severity(CHARS_PER_KB)).alias("severity"),
    )


def reasons(garbled: Column, fragmented: Column, formulas: Column, severity: Column) -> Column:
    """Why a document has to be parsed again, in order; empty if it need not."""
    bad_words = F.coalesce(garbled > GARBLED_LIMIT, F.lit(False))
    bad_lines = F.coalesce(fragmented > FRAGMENT_LIMIT, F.lit(False))
    return F.array_compact(
        F.array(
            F.when(bad_words, "garbled"),
            F.when(bad_lines, "fragmented"),
            F.when(formulas > FORMULA_LIMIT, "formula_dense"),
            F.when(severity == "severe_low", "density_severe").when(
                (severity == "moderate_low") & (bad_words | bad_lines), "density_moderate"
            ),
        )
    )


def chunk_flags(text: Column) -> Column:
    """Flags of a chunk, in order; null if there are none."""
    flags = F.array_compact(
        F.array(
            F.when(text.contains(FORMULA_MARK), "formula_missing"),
            F.when(text.contains(IMAGE_MARK), "has_unresolved_image"),
            F.when(fragmentation_ratio(text) > FRAGMENT_LIMIT, "fragmented"),
        )
    )
    return F.when(F.size(flags) > 0, flags)


def ocr_tier(confidence: Column) -> Column:
    return F.when(confidence > 0.85, "ocr_only").when(confidence < 0.5, "vlm_only").otherwise("both")


def image_kept(size: Column, width: Column, height: Column) -> Column:
    return (size >= 5120) & (width >= 50) & (height >= 50)


def manifest_status(flagged: Column, course: Column, priority: list[str]) -> Column:
    return F.when(~flagged, "good").when(course.isin(*priority), "pending_llamaparse").otherwise("degraded")
