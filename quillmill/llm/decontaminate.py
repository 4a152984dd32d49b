"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A hit of a mask fixes an alignment of an item and a document; along it equal tokens count 1 and different
ones -4, and the best-scoring stretch is the overlap. An item counts as leaked if a stretch scores
``min_score`` or if nine tenths of the item's tokens are equal along the alignment.

*Masks.* The nine masks 111111111, 10 11111111, 110 1111111, ... look at nine tokens and ignore one place among
them. They miss no leak. Cut a stretch at its m different tokens into m + 1 runs of equal ones. If any two
neighbouring runs have together at most eight tokens, taking the runs in pairs gives at most 4 m + r tokens,
where r is one run left over, so the score is at most r: it reaches nine only with a run of nine, which the
first mask sees. Otherwise two neighbours a and b have nine together, and the mask with the ignored place
between a' <= a and b' <= b tokens (a' + b' = 9) sees them. The same count holds for nine tenths of an item of
ten or more tokens. Items of fewer tokens are looked for as a whole.

*Filter.* Every mask has five neighbouring tokens in a row. A position is hashed under the masks only if the
five tokens that start there also stand in the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WEIGHT = 9
MASKS = ("1" * WEIGHT, *("1" * a + "0" + "1" * (WEIGHT - a) for a in range(1, WEIGHT)))
GRAM = 5
#: Items of at least this many tokens are looked for by the masks, shorter ones as a whole.
MASKED = WEIGHT + 1
SPLIT = r"[^\p{L}\p{N}]+"
#: Benchmark windows up to this number are broadcast: at some 50 bytes each, 50 MB at most.
BROADCAST_WINDOWS = 1_000_000
#: Beyond it, windows meet in so many parts a hash, so a common phrase fills no single task.
SALTS = 16


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda x: x != "")


def _gram(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(-size), *(F.get(hashes, at + i) for i in range(size)))


def _seed(hashes: Column, at: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(hashes, at + o) for o, bit in enumerate(MASKS[mask]) if bit == "1"))


def _gram_at(mask: int) -> int:
    """Where in the mask the first five tokens in a row stand."""
    return MASKS[mask].index("1" * GRAM)


def _along(words: Column, item: Column, shift: Column) -> Column:
    """(best, equal): the score of the best stretch along the alignment (Kadane's scan) and its equal tokens."""
    low, high = F.greatest(F.lit(0), -shift), F.least(F.size(item), F.size(words) - shift) - 1
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("equal"))

    def step(acc: Column, i: Column) -> Column:
        same = F.coalesce(F.get(item, i) == F.get(words, i + shift), F.lit(False))
        run = F.greatest(F.lit(0), acc["run"] + F.when(same, 1).otherwise(-4))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"), (acc["equal"] + same.cast("int")).alias("equal"))

    return F.aggregate(F.sequence(low, high), start, step)


def leaks(
    docs: DataFrame, items: DataFrame, text: str, row_id: str, item_text: str, item_id: str, min_score: int, min_tokens: int
) -> DataFrame:
    """(key, id, item, item_tokens, overlap) of overlaps(), for each alignment; key tells rows apart by id and text."""
    if min_score < WEIGHT:
        raise ValueError(f"the masks see every stretch of a score of {WEIGHT} or more")
    bench = items.select(F.col(item_id).alias("item"), tokens(F.col(item_text)).alias("item_words"))
    bench = bench.filter(F.size("item_words") >= min_tokens).distinct()
    bench = common.materialise(bench.withColumn("item_hashes", F.transform("item_words", lambda w: F.xxhash64(w))), "bench")
    n = F.size("item_words")
    short = bench.filter(n < MASKED).select(n.alias("n")).distinct()
    lengths = sorted(r.n for r in short.collect())  # at most nine numbers
    longest = bench.agg(F.max(n)).first()[0] or 0

    # Windows of the benchmark: (g, h, item, shift to the item's start); g is the hash that lets a position in.
    long_at = bench.filter(n >= MASKED).select("item", "item_hashes", F.explode(F.sequence(F.lit(0), n - WEIGHT)).alias("at"))
    parts = []
    for m, mask in enumerate(MASKS):
        inside = long_at.filter(F.col("at") + len(mask) <= F.size("item_hashes"))
        parts.append(inside.select(_gram(F.col("item_hashes"), F.col("at") + _gram_at(m), GRAM).alias("g"), _seed(F.col("item_hashes"), F.col("at"), m).alias("h"), "item", F.col("at").alias("item_at")))
    for size in lengths:
        whole = _gram(F.col("item_hashes"), F.lit(0), size)
        parts.append(bench.filter(n == size).select(whole.alias("g"), whole.alias("h"), "item", F.lit(0).alias("item_at")))
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.unionByName(part)
    windows = common.materialise(windows, "bench-windows")
    grams = windows.select("g").distinct()

    words = docs.select(
        F.struct(common.order_id(text, row_id).alias("row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body")).alias("key"),
        F.col(row_id).cast("long").alias("id"),
        F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPLIT).alias("words"),
    )
    # A text that begins or ends with a separator has an empty token there; it matches no item's token.
    words = words.filter(F.size("words") >= min_tokens).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    least = min([GRAM, *lengths])
    at = words.select("key", "id", "words", "hashes", F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("p"))
    sizes = sorted({GRAM, *lengths})
    gram = lambda size: _gram(F.col("hashes"), F.col("p"), size)
    looked = at.withColumn("g", gram(GRAM)) if sizes == [GRAM] else at.withColumn("g", F.explode(F.array(*map(gram, sizes))))

    few = common.rows_at_most(windows, BROADCAST_WINDOWS)
    if few:
        near = looked.join(F.broadcast(grams), "g")
    else:  # the documents' positions travel by hash, and only those that the benchmark knows fetch their texts
        salted = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        some = looked.select("key", "p", "g", F.pmod(F.xxhash64("key", "p"), F.lit(SALTS)).cast("int").alias("salt"))
        near = some.join(salted, ["g", "salt"]).select("key", "p", "g").distinct().join(words, "key")
    # No alignment through a position reaches further from it than the longest item and a mask, so a long text's position
    # goes on with the words around it alone; places are then those in this stretch, which starts at base.
    reach = longest + WEIGHT + 1
    base = F.greatest(F.lit(0), F.col("p") - reach)
    around = lambda c: F.slice(c, base + 1, F.lit(2 * reach + 1))
    near = near.select("key", "id", "g", around("words").alias("words"), around("hashes").alias("hashes"), base.alias("base"), (F.col("p") - base).alias("p"))
    hashed = near.select(
        "key", "id", "words", "base",
        F.explode(F.array(
            *(F.struct((F.col("p") - _gram_at(m)).alias("at"), _seed(F.col("hashes"), F.col("p") - _gram_at(m), m).alias("h")) for m in range(len(MASKS))),
            *([F.struct(F.col("p").alias("at"), F.col("g").alias("h"))] if lengths else []),
        )).alias("seed"),
    ).select("key", "id", "words", "base", "seed.at", "seed.h")

    found = windows.select("h", "item", "item_at")
    if few:
        hits = hashed.join(F.broadcast(found), "h").join(F.broadcast(bench.drop("item_hashes")), "item")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        some = hashed.select("key", (F.col("base") + F.col("at")).alias("at"), "h").withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int"))
        pairs = some.join(salted, ["h", "salt"]).select("key", "item", (F.col("at") - F.col("item_at")).alias("at")).distinct()
        hits = pairs.withColumn("item_at", F.lit(0)).join(bench.drop("item_hashes"), "item").join(words.drop("hashes"), "key")
    # Exploded, for the optimiser would copy the scan into each place that reads its result.
    along = F.explode(F.array(_along(F.col("words"), F.col("item_words"), F.col("at") - F.col("item_at"))))
    scored = hits.select("key", "id", "item", n.alias("item_tokens"), along.alias("a"))
    size, best, equal = F.col("item_tokens"), F.col("a.best"), F.col("a.equal")
    leaked = F.when(size < MASKED, equal == size).otherwise((best >= min_score) | (equal * 10 >= size * 9))
    return scored.filter(leaked).select("key", "id", "item", "item_tokens", F.col("a.best").alias("overlap"))


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    min_score: int = 12,
    min_tokens: int = 5,
) -> DataFrame:
    """(id, item id, item_tokens, overlap): a row for each pair of a document and an item that leaked into it;
    overlap is the score of the best stretch.

    An item of ten or more tokens leaked if a stretch scores ``min_score`` (nine at least, for the masks to see
    all) or if nine tenths of its tokens are equal along one alignment; a shorter one if all of it stands in
    the document. Items of fewer than ``min_tokens`` tokens say too little and are left out; with 1 every item
    is looked for. Null and empty texts overlap with nothing; rows with a null id are reported under null. Rows
    that repeat an id give one pair, as do rows that repeat an item. Further columns are not looked at. Empty
    tables give an empty result."""
    found = leaks(docs, items, text, row_id, item_text, item_id, min_score, min_tokens)
    most = found.groupBy("id", "item", "item_tokens").agg(F.max("overlap").alias("overlap"))
    return most.select(F.col("id").alias(row_id), F.col("item").alias(item_id), "item_tokens", "overlap")


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    min_score: int = 12,
    min_tokens: int = 5,
) -> DataFrame:
    """The rows of docs, all columns, without those that overlap with an item; cases as in overlaps(). Each row is
    judged by its own text: rows without an id, or that share one, go only if they overlap themselves."""
    gone, body = common.fresh(docs, "gone_", "gone_body_")
    found = leaks(docs, items, text, row_id, item_text, item_id, min_score, min_tokens)
    found = common.materialise(found.select(F.col("key.row").alias(gone), F.col("key.body").alias(body)).distinct(), "leaks")
    if common.rows_at_most(found, BROADCAST_WINDOWS):  # then the documents need not travel
        found = F.broadcast(found)
    same = (common.order_id(text, row_id) == F.col(gone)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(body))
    return docs.join(found, same, "left_anti").select(docs.columns)
