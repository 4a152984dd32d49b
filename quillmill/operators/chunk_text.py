"""Two-level text splitting: by headings, then recursively to a size with overlap."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.routing import citation, file_name
from . import numbering, pages

SIZE, OVERLAP = 700, 100
SEPARATORS = ("\n\n", "\n", " ", "")
HEADING = re.compile(r"^(#{1,3})[ \t]+(.*)$")


def sections(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, finest heading) of the stretches between headings of level 1 to 3; fenced code holds no
    headings. A heading belongs to its section."""
    out, names, start, at, fence = [], {}, 0, 0, None
    current: str | None = None
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if fence is None and (bare.startswith("```") or bare.startswith("~~~")):
            fence = bare[:3]
        elif fence is not None and bare.startswith(fence):
            fence = None
        m = HEADING.match(bare) if fence is None else None
        if m:
            if text[start:at].strip():
                out.append((start, at, current))
            start, level = at, len(m[1])
            names = {k: v for k, v in names.items() if k < level} | {level: m[2].strip()}
            current = names[max(names)]
        at += len(line)
    if text[start:].strip():
        out.append((start, len(text), current))
    return out


def pieces(text: str, start: int, end: int, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters that cover all text but white space: split at the coarsest
    separator that occurs, too long parts at the next, and neighbours merged up to the size; a span starts
    with up to ``overlap`` characters of the one before."""

    def split(a: int, b: int, level: int) -> list[tuple[int, int]]:
        while SEPARATORS[level] and text.find(SEPARATORS[level], a, b) < 0:
            level += 1
        sep = SEPARATORS[level]
        if not sep:
            return [(i, min(i + 1, b)) for i in range(a, b)]
        cuts, at = [a], text.find(sep, a + 1, b)
        while at >= 0:
            cuts.append(at)
            at = text.find(sep, at + len(sep), b)
        cuts.append(b)
        return [(x, y) for x, y in zip(cuts, cuts[1:]) if y > x]

    def run(a: int, b: int, level: int) -> list[tuple[int, int]]:
        while SEPARATORS[level] and text.find(SEPARATORS[level], a, b) < 0:
            level += 1
        out: list[tuple[int, int]] = []
        held: list[tuple[int, int]] = []
        for x, y in split(a, b, level):
            if y - x > size and SEPARATORS[level]:
                out += merge(held)
                held = []
                out += run(x, y, level + 1)
            else:
                held.append((x, y))
        return out + merge(held)

    def merge(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        first = 0
        for i, (_, y) in enumerate(parts):
            if y - parts[first][0] > size and i > first:
                out.append((parts[first][0], parts[i - 1][1]))
                while first < i and (parts[i - 1][1] - parts[first][0] > overlap or y - parts[first][0] > size):
                    first += 1
        if parts:
            out.append((parts[first][0], parts[-1][1]))
        return out

    return run(start, end, 0)


def split_text(text: str | None) -> list[tuple[str, str, str | None, int, int]]:
    """(piece, chunk_type, heading, start, end) of a text, with exact offsets of the stripped pieces."""
    out = []
    for a, b, heading in sections(text or ""):
        whole = text[a:b].strip()
        if len(whole) <= SIZE:
            spans, kind = [(a, b)], "heading_section"
        else:
            spans, kind = pieces(text, a, b), "paragraph"
        for x, y in spans:
            piece = text[x:y].strip()
            if piece:
                at = x + len(text[x:y]) - len(text[x:y].lstrip())
                out.append((piece, kind, heading, at, at + len(piece)))
    return out


def split(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, seq, piece, chunk_type, heading, char_start, char_end): one row per piece."""

    def run(batches):
        for pdf in batches:
            rows = [(d, i, *p) for d, t in zip(pdf["d"], pdf["t"]) for i, p in enumerate(split_text(t))]
            yield pd.DataFrame(rows, columns=["doc", "seq", "piece", "chunk_type", "heading", "char_start", "char_end"])

    src = docs.select(F.col(doc).cast("string").alias("d"), F.coalesce(text, F.lit("")).alias("t"))
    return src.mapInPandas(run, "doc string, seq long, piece string, chunk_type string, heading string, char_start long, char_end long")


def chunk(docs: DataFrame, anchors: DataFrame, equations: DataFrame, scores: DataFrame) -> DataFrame:
    """Chunks of docs (doc, course, text) with pages, citation and flags; pages are 0-based."""
    cut = split(docs)
    ends = cut.select("doc", F.explode(F.array("char_start", F.greatest("char_start", F.col("char_end") - 1))).alias("offset")).distinct()
    at = pages.as_of(ends, anchors, ["doc"])
    first = at.select("doc", F.col("offset").alias("char_start"), F.col("page").alias("page_start"))
    last = at.select("doc", F.col("offset").alias("last_"), F.col("page").alias("page_end"))
    placed = cut.withColumn("last_", F.greatest("char_start", F.col("char_end") - 1)).join(first, ["doc", "char_start"], "left").join(last, ["doc", "last_"], "left").drop("last_")
    flags = pages.page_range_flags(placed, equations, scores, "doc", "seq")
    full = placed.join(flags, ["doc", "seq"], "left").join(docs.select("doc", "course"), "doc")
    return full.select(
        "doc", "seq", F.concat_ws("\n", file_name(F.col("doc")), F.col("piece")).alias("text"), "course", "chunk_type",
        F.col("heading").alias("name"), "page_start", "page_end", "char_start", "char_end",
        F.col("page_start").isNull().alias("estimated"),
        citation(F.col("course"), F.col("doc"), F.col("page_start"), F.col("page_end")).alias("source_citation"),
        pages.all_flags(F.col("piece"), F.col("unverifiable"), F.col("low_confidence")).alias("chunk_quality_flag"),
    )


def number(chunks: DataFrame) -> DataFrame:
    return numbering.chunk_ids(chunks, ["doc", "seq"], "txtm")
