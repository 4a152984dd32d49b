"""Removal of repeated line passages by content-defined chunks of lines.

A rolling hash over the hashes of the last ``window`` lines decides where a chunk ends, so chunk borders
depend on the lines around them alone: a passage that is shifted by other lines falls into the same chunks.
Equal chunks of several lines are found by grouping on digest and whole bytes; all but the first go.
Passages of a few lines rarely fill a chunk: they are found as runs of repeated pairs of consecutive lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def strong(body: bytes) -> str:
    """A cryptographic digest: what agrees in it is taken as equal where bytes of other rows are not at hand."""
    return hashlib.blake2b(body, digest_size=16).hexdigest()


def chunks(text: str | None, window: int, every: int, longest: int) -> list[tuple[int, list[str]]]:
    """(first line, lines) of each chunk. A chunk ends where the rolling hash of the ``window`` last lines is
    a multiple of ``every``, at ``longest`` lines and at the end."""
    if not text:
        return []
    lines = text.split("\n")
    hashes = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    out, start, rolled, mask = [], 0, 0, (1 << 64) - 1
    base = 0x9E3779B97F4A7C15
    drop = pow(base, window, 1 << 64)
    for i, h in enumerate(hashes):
        rolled = (rolled * base + h) & mask
        if i >= window:
            rolled = (rolled - drop * hashes[i - window]) & mask
        full = i + 1 >= window and ((rolled ^ rolled >> 31) * base & mask) >> 40
        if (i + 1 >= window and full % every == 0) or i - start + 1 >= longest or i == len(lines) - 1:
            out.append((start, lines[start : i + 1]))
            start = i + 1
    return out


def repeated_chunks(df: DataFrame, text: str, row_id: str, digest, **shape) -> DataFrame:
    """(kid, gone): for each id the keys of chunks that an earlier id holds; the key is the digest, followed
    by the bytes where a digest has several."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kid, t in zip(pdf["kid"], pdf["t"]):
                for body in {"\n".join(lines) for _, lines in chunks(t, **shape) if len(lines) > 1}:
                    rows.append((kid, digest(body.encode("utf-8", "surrogatepass")), body))
            yield pd.DataFrame(rows, columns=["kid", "digest", "body"])

    src = df.select(common.order_id(text, row_id).alias("kid"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cuts = src.mapInPandas(cut, "kid long, digest string, body string")
    # The partial aggregate merges a task's copies before the exchange; whole bytes are part of the key.
    bodies = cuts.groupBy("digest", "body").agg(F.min("kid").alias("keeper"), F.max("kid").alias("last"))
    bodies = bodies.withColumn("shared", F.col("last") > F.col("keeper"))
    per = bodies.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("keeper").alias("keeper"), F.bool_or("shared").alias("shared"))
    per = common.materialise(per.filter("shared"), "line-groups")
    marks = common.salted_join(cuts.drop("body"), per.filter("n = 1"), ["digest"], "kid").filter("kid <> keeper").select("kid", F.col("digest").alias("key"))
    clash = per.filter("n > 1").select("digest")
    if clash.limit(1).count():
        theirs = cuts.join(clash, "digest", "left_semi").join(bodies, ["digest", "body"]).filter("kid <> keeper")
        marks = marks.unionByName(theirs.select("kid", F.concat("digest", F.lit(":"), "body").alias("key")))
    return marks.groupBy("kid").agg(F.collect_set("key").alias("gone"))


def pair_keys(lines: list[str]) -> list[bytes]:
    """A cryptographic digest of each two consecutive lines."""
    one = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines]
    return [hashlib.blake2b(a + b, digest_size=16).digest() for a, b in zip(one, one[1:])]


def repeated_pairs(src: DataFrame) -> DataFrame:
    """(kid, pairs): for each id the keys of two consecutive lines that an earlier id holds."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(kid, key) for kid, t in zip(pdf["kid"], pdf["t"]) for key in set(pair_keys(t.split("\n")))]
            yield pd.DataFrame(rows, columns=["kid", "pair"])

    pairs = src.mapInPandas(cut, "kid long, pair binary")
    shared = pairs.groupBy("pair").agg(F.min("kid").alias("keeper"), F.max("kid").alias("last")).filter("last > keeper")
    shared = common.materialise(shared.select("pair", "keeper"), "line-pairs")
    marks = common.salted_join(pairs, shared, ["pair"], "kid").filter("kid <> keeper")
    return marks.groupBy("kid").agg(F.collect_set("pair").alias("pairs"))


def repeated_passages(lines: list[str], earlier: set[bytes], above: int, first: dict[bytes, int], base: int) -> Iterator[range]:
    """Lines of each longest run of repeated pairs, if it has more than ``above`` words. A pair repeats if an
    earlier document holds it or if it stands before in this one without overlap: ``first`` has where its
    pairs stood first, counted from ``base`` in the rows before."""
    start = None
    keys = pair_keys(lines)
    for i in range(len(keys) + 1):
        again = i < len(keys) and (base + i - first.setdefault(keys[i], base + i) >= 2 or keys[i] in earlier)
        if again and start is None:
            start = i
        elif not again and start is not None:
            if sum(len(x.split()) for x in lines[start : i + 1]) > above:
                yield range(start, i + 1)
            start = None


def remove_repeats(
    df: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    window: int = 2,
    every: int = 4,
    longest: int = 64,
    digest=strong,
    passage_words: int | None = None,
) -> DataFrame:
    """One row per row of df: id, n_lines, n_removed (lines), kept_sha256 and the remaining text.

    Of equal chunks of two lines or more the one in the document with the smallest id stays, in that document
    the first. With ``passage_words`` passages that chunk borders do not fit go as well: every run of repeated
    pairs of consecutive lines that has more than so many words. Null and empty texts have no lines. Rows with
    a null id come before all others, in order of a hash of their texts. Rows that share an id count as one
    document, whose rows follow one another in order of their texts. A last line without an end is a line like
    any other. Other columns are not looked at. An empty table gives an empty result."""
    shape = {"window": window, "every": every, "longest": longest}
    gone = repeated_chunks(df, text, row_id, digest, **shape)
    src = df.select(
        common.order_id(text, row_id).alias("kid"), F.col(row_id).isNull().alias("unnamed"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    joined = src.join(gone, "kid", "left")
    if passage_words is None:
        joined = joined.withColumn("pairs", F.lit(None).cast("array<binary>"))
    else:
        joined = joined.join(repeated_pairs(src.select("kid", "t")), "kid", "left")
    # The window deals rows by id and sorts them by text: rows that share an id come one after the other.
    joined = joined.withColumn("nth", F.row_number().over(Window.partitionBy("kid").orderBy("t")))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        first: dict[bytes, int] = {}
        base = 0
        for pdf in batches:
            rows = []
            for kid, unnamed, t, keys, pairs, nth in zip(pdf["kid"], pdf["unnamed"], pdf["t"], pdf["gone"], pdf["pairs"], pdf["nth"]):
                if nth == 1:
                    seen, first, base = set(), {}, 0
                drop = set(keys) if keys is not None else set()
                lines, out = [], set()
                for start, own in chunks(t, **shape):
                    lines += own
                    if len(own) > 1:
                        body = "\n".join(own)
                        key = digest(body.encode("utf-8", "surrogatepass"))
                        mark = key if digest is strong else strong(body.encode("utf-8", "surrogatepass"))
                        if key in drop or f"{key}:{body}" in drop or mark in seen:
                            out.update(range(start, start + len(own)))
                        seen.add(mark)
                if passage_words is not None:
                    for passage in repeated_passages(lines, set(pairs) if pairs is not None else set(), passage_words, first, base):
                        out.update(passage)
                base += len(lines) + 2
                kept = [x for i, x in enumerate(lines) if i not in out]
                left = "\n".join(kept)
                named = None if unnamed else kid
                rows.append((named, len(lines), len(lines) - len(kept), hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest(), left))
            yield pd.DataFrame(rows, columns=["kid", "n_lines", "n_removed", "kept_sha256", "text"]).astype({"kid": "Int64"})

    done = joined.mapInPandas(rest, "kid long, n_lines long, n_removed long, kept_sha256 string, text string")
    return done.withColumnRenamed("kid", row_id)
