"""Near-duplicate groups by SimHash fingerprints and covering locality-sensitive hashing.

*Fingerprints.* Shingles of lower-cased words, repeats included, are hashed with XXH64; a bit is set if it
is set in more than half of the hashes.

*Covering.* For radius r every bit position gets a vector of r + 1 bits. Table v (v = 1 .. 2^(r+1) - 1)
looks only at the positions whose vector has an odd product with v. At most r differing positions span at
most r dimensions, so some v is orthogonal to all of them: every pair within the radius has equal masked
bits in some table. No link is missed.

*Links.* Copies of a fingerprint are merged first, so groups of copies cost one row. Rows with equal
(table, masked bits) meet in one task, which returns a spanning forest of the bucket's links in place of
its pairs. A bucket of more than ``block`` fingerprints is split into blocks, and pairs of blocks meet, each
in a task of its own, so no bucket has to fit into one task and none is cut short.

*Groups.* Connected components by hooking to the smallest neighbour and pointer jumping over the forest's
edges; every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 42
SIGN = np.uint64(1 << 63)


def masks(radius: int, bits: int = 64, seed: int = 7) -> np.ndarray:
    """The 2^(radius+1) - 1 covering masks as unsigned integers. Positions get the non-zero vectors in turn,
    shuffled, so every mask holds about half of the positions."""
    every = np.arange(1, 2 ** (radius + 1))
    rng = np.random.default_rng(seed)
    vectors = np.concatenate([rng.permutation(every) for _ in range(-(-bits // len(every)))])[:bits]
    out = []
    for v in every:
        odd = np.array([bin(int(v) & int(x)).count("1") & 1 for x in vectors], dtype=bool)
        out.append(sum(1 << i for i in range(bits) if odd[i]))
    return np.array(out, dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words of the UTF-8 text between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(tokens: list[bytes], size: int) -> list[bytes]:
    """All runs of ``size`` words joined by a space; of fewer words the whole sequence; of none nothing."""
    if not tokens:
        return []
    if len(tokens) <= size:
        return [b" ".join(tokens)]
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist())]


def fingerprint(features: list[bytes]) -> int:
    """The SimHash of the features, as an unsigned integer; zero for none. Bits are counted in blocks, so
    long texts need no matrix of all their bits."""
    if not features:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in features), dtype=">u8", count=len(features))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(df: DataFrame, text: str, row_id: str, features) -> DataFrame:
    """(id, th, fp): one row per row of df; th is a hash of the text, which tells rows that share an id apart,
    and fp the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.fromiter((signed(fingerprint(features(t))) for t in pdf["t"]), np.int64, count=len(pdf))
            yield pd.DataFrame({"id": pdf["id"], "th": pdf["th"], "fp": fps})

    body = F.coalesce(F.col(text), F.lit(""))
    src = df.select(F.col(row_id).cast("long").alias("id"), F.xxhash64(body).alias("th"), body.alias("t"))
    return src.mapInPandas(run, "id long, th long, fp long")


def forest(nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest of the links among the nodes (Prim's algorithm, a row of distances
    at a time): what is linked is linked through the shortest distances."""
    n = len(nodes)
    near = np.full(n, 255, dtype=np.uint8)
    via = np.zeros(n, dtype=np.int64)
    outside = np.ones(n, dtype=bool)
    edges, at = [], 0
    for _ in range(n - 1):
        outside[at] = False
        d = np.bitwise_count(nodes ^ nodes[at]).astype(np.uint8)
        closer = outside & (d < near)
        near[closer], via[closer] = d[closer], at
        at = int(np.where(outside, near, 255).argmin())
        if not outside[at]:
            at = int(outside.argmax())
        elif near[at] <= radius:
            edges.append((int(nodes[via[at]]), int(nodes[at])))
    return edges


def links(fps: DataFrame, radius: int, block: int = 2048) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints (column fp, distinct, signed) that links of at
    most ``radius`` differing bits connect."""
    n = common.partitions(fps)
    table_masks = [signed(int(m)) for m in masks(radius)]
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(i).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
                    for i, m in enumerate(table_masks)
                )
            )
        ).alias("key"),
    ).select("fp", "key.t", "key.k")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Buckets of a sorted partition; the last one of a batch waits for the next batch. Of a bucket over
        the block size only its key is returned, and no more than a block of it is ever held."""
        held: list[pd.DataFrame] = []
        size, key, large = 0, None, False
        keys = ["t", "k"]

        def close() -> Iterator[pd.DataFrame]:
            if large:
                yield pd.DataFrame({"a": [key[1]], "b": [0], "t": [key[0]]})
            elif size > 1:
                yield solve(np.concatenate([x["fp"].to_numpy() for x in held]))

        def solve(members: np.ndarray) -> pd.DataFrame:
            found = forest(members.view(np.uint64), radius)
            return frame(found)

        def frame(found: list[tuple[int, int]]) -> pd.DataFrame:
            pair = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": pair[:, 0], "b": pair[:, 1], "t": np.full(len(pair), -1)})

        for pdf in batches:
            if not len(pdf):
                continue
            t, k, fp = pdf["t"].to_numpy(), pdf["k"].to_numpy(), pdf["fp"].to_numpy()
            change = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = np.concatenate(([0], change, [len(pdf)]))
            sizes = np.diff(bounds)
            found: list[tuple[int, int]] = []
            for i in range(len(sizes)):
                a, b = int(bounds[i]), int(bounds[i + 1])
                first, last = i == 0, i == len(sizes) - 1
                if not first and not last and b - a == 1:
                    continue
                if not first and not last and b - a == 2:
                    x, y = fp[a : a + 2].view(np.uint64)
                    if np.bitwise_count(x ^ y) <= radius:
                        found.append((int(x), int(y)))
                    continue
                here = (int(t[a]), int(k[a]))
                if here != key:
                    yield from close()
                    held, size, key, large = [], 0, here, False
                size += b - a
                large = large or size > block
                held = [] if large else [*held, pdf.iloc[a:b][["fp"]]]
            if found:
                yield frame(found)
        if key is not None:
            yield from close()

    dealt = keyed.repartition(n, "t", "k").sortWithinPartitions("t", "k")
    scanned = common.materialise(dealt.mapInPandas(scan, "a long, b long, t int"), "simhash-links")
    edges = scanned.filter("t < 0").select("a", "b")
    large = scanned.filter("t >= 0").select(F.col("t").cast("short").alias("t"), F.col("a").alias("k"))
    if large.limit(1).count():
        members = keyed.join(large, ["t", "k"])
        sizes = members.groupBy("t", "k").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        placed = members.join(sizes, ["t", "k"]).withColumn(
            "at", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        )
        # Block i of m meets block j for all j: it is sent once for each unordered pair it belongs to.
        sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "t", "k", "fp", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j")
        )

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            found = forest(pdf["fp"].to_numpy().view(np.uint64), radius)
            pair = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": pair[:, 0], "b": pair[:, 1]})

        met = sent.groupBy("t", "k", "i", "j").applyInPandas(meet, "a long, b long")
        edges = edges.unionByName(common.materialise(met, "simhash-large"))
    return edges.distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): for every node of the edges (a, b) the smallest node that it reaches.

    Each round sends every edge's larger end to the smallest neighbour (large star), then joins the rest to
    the smallest of its own (small star), until nothing changes; labels of a star need no further round."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = common.materialise(
        edges.filter("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(),
        "cc",
    )
    before = None
    for _ in range(rounds):
        # Large star: neighbours above a node hook to the smallest of the node and its neighbours.
        wide = both(current)
        low = wide.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = wide.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours hook to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        current = common.materialise(small, "cc")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def group(
    df: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    shingle: int = 4,
    radius: int = 4,
    block: int = 2048,
    features=None,
) -> DataFrame:
    """One row per row of df: id, fingerprint (16 hexadecimal digits), component_id: the smallest id that
    links of at most ``radius`` differing bits reach.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id get the
    component of their fingerprint; a component without any id has null. Repeated rows come back once each.
    An empty table gives an empty result. Other columns are not looked at."""
    shape = features or (lambda t: shingles(words(t), shingle))
    rows, by_fp = linked_rows(df, text, row_id, shape, radius, block)
    return common.salted_join(rows, by_fp.select("fp", "component_id"), ["fp"], "id").select(
        F.col("id").alias(row_id),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def linked_rows(df: DataFrame, text: str, row_id: str, features, radius: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, fp) and fingerprints with the component each belongs to (fp, component_id)."""
    rows = common.materialise(fingerprints(df, text, row_id, features), "simhash-rows")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("low"))
    distinct = common.materialise(distinct, "simhash-distinct")
    edges = common.materialise(links(distinct.select("fp"), radius, block), "simhash-edges")
    linked = components(edges)
    placed = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows, placed.join(lowest, "root").select("fp", "component_id")


def word_set(text: str | None) -> list[bytes]:
    return sorted(set(words(text)))


class ShingleIndex:
    """Sets of shingles by their hashes, in flat sorted arrays; what the hashes find is verified on the texts."""

    def __init__(self, texts: list[str], shingle: int, similarity: float):
        self.texts, self.shingle, self.similarity = texts, shingle, similarity
        own = [self.hashes(t) for t in texts]
        self.sizes = np.array([len(x) for x in own], dtype=np.int64)
        every = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys, self.owners = every[order], np.repeat(np.arange(len(texts)), self.sizes)[order]

    def hashes(self, text: str) -> np.ndarray:
        found = shingles(words(text), self.shingle)
        return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), np.uint64, count=len(found)))

    def resembling(self, text: str) -> Iterator[int]:
        """Places of the texts whose Jaccard similarity with ``text`` reaches the bound, in order."""
        mine = self.hashes(text)
        low, high = np.searchsorted(self.keys, mine, "left"), np.searchsorted(self.keys, mine, "right")
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else low
        both = np.bincount(self.owners[at], minlength=len(self.texts))
        # A little below the bound, so that no collision of hashes hides a pair.
        likely = np.flatnonzero((both > 0) & (both >= (self.similarity - 0.01) * (len(mine) + self.sizes - both)))
        exact = set(shingles(words(text), self.shingle)) if len(likely) else set()
        for i in likely.tolist():
            theirs = set(shingles(words(self.texts[i]), self.shingle))
            shared = len(exact & theirs)
            if shared > 0 and shared >= self.similarity * (len(exact) + len(theirs) - shared):
                yield i


def drop_near_copies(
    df: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 7,
    batch: int = 256,
    block: int = 2048,
) -> DataFrame:
    """The rows of df without near copies: in order of id, a row goes if it resembles an earlier row that stays.

    Candidates are components by the SimHash of each text's set of words: a few replaced words move that far
    fewer bits than they move of a shingle fingerprint, so texts at the similarity asked for come within the
    radius. Rows resemble if their ``shingle``-word shingles have a Jaccard similarity of at least
    ``similarity``, taken exactly on whole texts. In each round the first ``batch`` rows of a component are
    settled among themselves; the component's other rows meet those of them that stay, in slices of ``batch``
    rows, and what resembles none is open in the next round. Rounds go on until no row is open. Rows with a
    null id and null or empty texts stay. Rows that share an id and differ in their texts are documents of
    their own, in order of a hash of their texts; rows that repeat id and text stay or go together. Columns
    come back as they are, and an empty table gives an empty result."""
    i, h, gone, gone_h = common.fresh(df, "key_", "hash_", "gone_", "gone_hash_")
    own = ["id", "th"]
    rows, by_fp = linked_rows(df, text, row_id, word_set, radius, block)
    linked = common.salted_join(rows.filter("id is not null"), by_fp, ["fp"], "id")
    placed = linked.select("id", "th", F.col("component_id").alias("comp")).distinct()
    sizes = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("comp")
    body = F.coalesce(F.col(text), F.lit(""))
    bodies = df.select(F.col(row_id).cast("long").alias("id"), F.xxhash64(body).alias("th"), body.alias("t")).filter("t <> ''")
    members = common.salted_join(placed, sizes, ["comp"], "id").join(bodies, own).dropDuplicates(own).select("comp", "id", "th", "t")
    open_ = common.materialise(members, "simhash-members")
    gone_rows = []

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(own)
        index, stays = ShingleIndex(pdf["t"].tolist(), shingle, similarity), np.zeros(len(pdf), dtype=bool)
        for at, t in enumerate(pdf["t"] if len(pdf) > 1 else ()):
            stays[at] = not any(stays[j] for j in index.resembling(t) if j < at)
        return pdf.assign(stays=stays if len(pdf) > 1 else True)[["comp", "id", "th", "t", "stays"]]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a sorted partition: in each slice first the texts that stay, then the rows that meet them."""
        key, texts, index = None, [], None
        for pdf in batches:
            out = []
            for comp, part, row, th, t, settled in zip(pdf["comp"], pdf["slice"], pdf["id"], pdf["th"], pdf["t"], pdf["settled"]):
                if (comp, part) != key:
                    key, texts, index = (comp, part), [], None
                if settled:
                    texts.append(t)
                else:
                    index = index or ShingleIndex(texts, shingle, similarity)
                    if next(index.resembling(t), None) is not None:
                        out.append((row, th))
            yield pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 2), columns=own)

    while True:
        order = Window.partitionBy("comp").orderBy("id", "th")
        ranked = open_.select("comp", "id", "th").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= batch)
        first = open_.join(ranked.select("id", "th"), own, "left_semi")
        settled = first.groupBy("comp").applyInPandas(settle, "comp long, id long, th long, t string, stays boolean")
        settled = common.materialise(settled, "simhash-settled")
        gone_rows.append(settled.filter("not stays").select("id", "th"))
        large = open_.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > batch)
        large = common.materialise(large.select("comp", F.ceil(F.col("n") / batch).cast("int").alias("slices")), "simhash-large")
        if not large.limit(1).count():
            break
        rest = common.salted_join(open_, large, ["comp"], "id").join(settled.select("id", "th"), own, "left_anti")
        place = F.pmod(F.xxhash64("id", "th"), F.col("slices")).cast("int")
        rest = common.materialise(rest.select("comp", place.alias("slice"), "id", "th", "t"), "simhash-rest")
        kept = settled.filter("stays").join(large, "comp").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        tagged = kept.select("comp", "slice", "id", "th", "t", F.lit(True).alias("settled")).unionByName(rest.withColumn("settled", F.lit(False)))
        dealt = tagged.repartition(common.partitions(df), "comp", "slice").sortWithinPartitions("comp", "slice", F.desc("settled"), "id", "th")
        found = common.materialise(dealt.mapInPandas(meet, "id long, th long"), "simhash-found")
        gone_rows.append(found)
        open_ = common.materialise(rest.select("comp", "id", "th", "t").join(found, own, "left_anti"), "simhash-open")
    out = reduce(DataFrame.unionByName, gone_rows).select(F.col("id").alias(gone), F.col("th").alias(gone_h)).distinct()
    keyed = df.withColumn(i, F.col(row_id).cast("long")).withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(out, (F.col(i) == F.col(gone)) & (F.col(h) == F.col(gone_h)), "left_anti").select(df.columns)
