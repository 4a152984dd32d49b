"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``width`` bytes over it also starts earlier. Sorting the suffixes of all positions
would move every text a hundred times over, so a sparse set of suffixes stands for all of them:

*Anchors.* Each window of ``width`` bytes owns one anchor: the leftmost of its ``gram``-byte strings with the
smallest hash. Equal windows own equal anchors at equal places, so two windows can be equal only where two
anchors are, and about one position in thirty is an anchor. Anchors whose gram occurs once are dropped.

*Runs.* A task cuts the suffix at each anchor left (as far as its windows reach), adds the bytes before it
in reverse, sorts the suffixes of each destination and merges equal ones; the run travels front-coded: each
suffix as the length of the prefix it shares with the one before and the rest of it.

*Merge.* The destination merges its runs with a loser tree whose nodes keep the length of the prefix that a
loser shares with the last winner. Two suffixes are compared by those lengths; only where they tie are bytes
read, from the known prefix on. The tree's output is the sorted suffixes with their common prefixes.

*Windows.* The windows with a bytes before the anchor are equal where suffixes share width - a bytes and the
reversed contexts share a bytes; both follow from the two orders' common prefixes. In each class all but the
earliest window is removed.

An anchor with more than ``hot`` occurrences is not gathered in one task: its windows travel one by one to
destinations chosen by the whole window, where equal ones have been merged in every run before.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BASE = 0x9E3779B97F4A7C15
BYTE_CODES = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64)


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every ``gram``-byte string, by doubling."""
    n = len(data) - gram + 1
    level, size = BYTE_CODES[data], 1
    total, done = None, 0
    rest = gram
    while rest:
        if rest & 1:
            part = level[done : done + n]
            total = part.copy() if total is None else total * power(size) + part
            done += size
        rest >>= 1
        if rest:
            level = level[:-size] * power(size) + level[size:]
            size *= 2
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total


def anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, their grams' hashes, and the first and last start of the windows that own each."""
    if len(data) < width:
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none, none
    hashes = gram_hashes(data, gram)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span, size = width - gram + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    owner = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut - 1, [len(owner) - 1]))
    at = owner[first]
    return at, hashes[at], first, last


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix of a and b, known to be start at least."""
    n = min(len(a), len(b))
    i = start
    while i < n and a[i : i + 16] == b[i : i + 16]:
        i += 16
    if i >= n:
        return n
    while i < n and a[i] == b[i]:
        i += 1
    return i


class LoserTree:
    """Merges sorted front-coded runs: each yields (shared, string) where shared is the length of the prefix
    common with the run's last string. Gives (shared with the last output, run) in order."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.text: list[bytes | None] = [None] * self.size
        self.known = [0] * self.size
        self.loser = [-1] * self.size
        for k, run in enumerate(runs):
            self.text[k] = next(run, (0, None))[1]
        winner = list(range(self.size))
        while len(winner) > 1:
            base = len(winner) // 2
            winner = [self.play(winner[2 * i], winner[2 * i + 1], base + i) for i in range(base)]
        self.top = winner[0]

    def play(self, a: int, b: int, node: int) -> int:
        """Both share ``known`` bytes with the same earlier string; the loser stays at the node."""
        x, y = self.text[a], self.text[b]
        if x is None or y is None:
            first = y is None
        elif self.known[a] != self.known[b]:
            first = self.known[a] > self.known[b]
        else:
            n = common_prefix(x, y, self.known[a])
            first = n == len(x) or (n < len(y) and x[n] < y[n])
            self.known[b if first else a] = n
        win, lose = (a, b) if first else (b, a)
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, int]]:
        text, known, loser, size = self.text, self.known, self.loser, self.size
        top = self.top
        while text[top] is not None:
            yield known[top], top
            shared, text[top] = next(self.runs[top], (0, None))
            known[top] = shared
            node = (top + size) // 2
            while node:
                other = loser[node]
                y = text[other]
                if y is not None:
                    x = text[top]
                    if x is None:
                        first = False
                    elif known[top] != known[other]:
                        first = known[top] > known[other]
                    else:
                        n = common_prefix(x, y, known[top])
                        first = n == len(x) or (n < len(y) and x[n] < y[n])
                        known[other if first else top] = n
                    if not first:
                        loser[node], top = top, other
                node //= 2


def encode_run(entries: list[tuple[bytes, bytes, int, int, int, int, int]]) -> bytes:
    """A front-coded run of (suffix, reversed context, low, high, id, seq, position). Of entries that agree
    in the first four the earliest stays; the windows of the others are listed as removed."""
    entries.sort()
    kept, gone, last = [], [], None
    for e in entries:
        if e[:4] == last:
            gone.append((e[4], e[5], e[6] - e[3], e[6] - e[2]))
        else:
            kept.append(e)
            last = e[:4]
    shared, rest, before = [], [], b""
    for e in kept:
        n = common_prefix(before, e[0])
        shared.append(n)
        rest.append(e[0][n:])
        before = e[0]
    meta = np.array([(e[2], e[3], e[4], e[5], e[6]) for e in kept], dtype=np.int64).reshape(-1, 5)
    sizes = np.array([(s, len(r), len(e[1])) for s, r, e in zip(shared, rest, kept)], dtype=np.int32).reshape(-1, 3)
    out = np.array(gone, dtype=np.int64).reshape(-1, 4)
    head = np.array([len(kept), len(gone), sum(map(len, rest))], dtype=np.int64)
    parts = (head.tobytes(), meta.T.tobytes(), sizes.T.tobytes(), out.T.tobytes(), b"".join(rest), b"".join(e[1] for e in kept))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


class Run:
    def __init__(self, blob: bytes):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, m, body = np.frombuffer(raw, dtype=np.int64, count=3).tolist()
        at = 24
        self.meta = np.frombuffer(raw, dtype=np.int64, count=5 * n, offset=at).reshape(5, n).T
        at += 40 * n
        sizes = np.frombuffer(raw, dtype=np.int32, count=3 * n, offset=at).reshape(3, n)
        at += 12 * n
        self.gone = np.frombuffer(raw, dtype=np.int64, count=4 * m, offset=at).reshape(4, m).T
        at += 32 * m
        self.shared, self.lengths = sizes[0].tolist(), sizes[1].tolist()
        self.rest = raw[at : at + body]
        self.left = raw[at + body :]
        self.left_sizes = sizes[2]

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at, text = 0, b""
        for shared, n in zip(self.shared, self.lengths):
            text = text[:shared] + self.rest[at : at + n]
            at += n
            yield shared, text


def repeated(blobs: list[bytes], width: int, gram: int) -> np.ndarray:
    """Rows (id, seq, start, end) of byte ranges that the runs' windows show to be repeats."""
    runs = [Run(b) for b in blobs]
    out = [np.stack([r.gone[:, 0], r.gone[:, 1], r.gone[:, 2], r.gone[:, 3] + width], axis=1) for r in runs if len(r.gone)]
    offsets = np.cumsum([0] + [len(r.meta) for r in runs])
    next_of = offsets[:-1].tolist()
    shared, order = [], []
    for n, k in LoserTree([iter(r) for r in runs]):
        shared.append(n)
        order.append(next_of[k])
        next_of[k] += 1
    shared, order = np.array(shared, dtype=np.int64), np.array(order, dtype=np.int64)
    if len(order) > 1:
        head = np.concatenate(([True], shared[1:] < gram))
        group = np.cumsum(head) - 1
        take = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(take):
            meta = np.concatenate([r.meta for r in runs])[order[take]]
            lefts = left_matrix(runs, width - gram)[order[take]]
            lengths = np.concatenate([r.left_sizes for r in runs])[order[take]]
            out.append(windows(group[take], np.where(head, -1, shared)[take], meta, lefts, lengths, width, gram))
    return np.concatenate(out) if out else np.zeros((0, 4), dtype=np.int64)


def left_matrix(runs: list[Run], reach: int) -> np.ndarray:
    out = []
    for r in runs:
        sizes = r.left_sizes.astype(np.int64)
        flat = np.frombuffer(r.left, dtype=np.uint8)
        m = np.zeros((len(sizes), reach), dtype=np.uint8)
        inside = np.arange(reach)[None, :] < sizes[:, None]
        m[inside] = flat
        out.append(m)
    return np.concatenate(out)


def windows(group, shared, meta, lefts, lengths, width: int, gram: int) -> np.ndarray:
    """The repeated ranges of suffixes in sorted order that share their gram with a neighbour."""
    n, reach = lefts.shape
    low, high = meta[:, 0], meta[:, 1]
    padded = np.zeros((n, -(-reach // 8) * 8), dtype=np.uint8)
    padded[:, :reach] = lefts
    keys = padded.view(">u8")
    order = np.lexsort((lengths, *(keys[:, i] for i in range(keys.shape[1] - 1, -1, -1)), group))
    same = lefts[order[1:]] == lefts[order[:-1]]
    prefix = np.where(same.all(axis=1), reach, same.argmin(axis=1))
    prefix = np.minimum(prefix, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    prefix = np.concatenate(([-1], np.where(group[order[1:]] == group[order[:-1]], prefix, -1)))
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort((meta[:, 4], meta[:, 3], meta[:, 2]))] = np.arange(n)
    flagged = np.zeros((n, reach + 2), dtype=np.int8)
    left_class = np.empty(n, dtype=np.int64)
    for a in range(reach + 1):
        sel = np.flatnonzero((low <= a) & (a <= high))
        if len(sel) < 2:
            continue
        left_class[order] = np.cumsum(prefix < a)
        key = np.cumsum(shared < width - a)[sel] * (n + 1) + left_class[sel]
        by = np.lexsort((rank[sel], key))
        later = np.concatenate(([False], key[by[1:]] == key[by[:-1]]))
        flagged[sel[by[later]], a + 1] = 1
    edges = np.diff(np.concatenate([flagged, np.zeros((n, 1), np.int8)], axis=1), axis=1)
    row, start = np.nonzero(edges == 1)
    _, stop = np.nonzero(edges == -1)
    at = meta[row, 4]
    return np.stack([meta[row, 2], meta[row, 3], at - (stop - 1), at - start + width], axis=1)


def merged(ranges: np.ndarray) -> np.ndarray:
    """Overlapping and touching ranges (start, end) joined, in order."""
    if len(ranges) < 2:
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    ends = np.maximum.accumulate(ranges[:, 1])
    head = np.concatenate(([True], ranges[1:, 0] > ends[:-1]))
    firsts = np.flatnonzero(head)
    return np.stack([ranges[firsts, 0], ends[np.concatenate((firsts[1:] - 1, [len(ranges) - 1]))]], axis=1)


def remove_repeats(
    df: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    width: int = 100,
    gram: int = 40,
    hot: int = 20_000,
    run_entries: int = 150_000,
    texts: bool = False,
    dest_chars: int = 16_000_000,
) -> DataFrame:
    """One row per row of df: the id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if
    ``texts``, the remaining bytes (kept_bytes; a removal may split a character).

    A string counts as earlier if it starts in a document with a smaller id or earlier in the same document.
    A null text counts as empty; empty texts and texts under ``width`` bytes lose nothing unless they are
    that long. Rows that repeat an id count as separate documents in the order of their texts; rows with a
    null id come before all others, in order of a hash of their texts. An empty table gives an empty result. Other columns are not looked at.

    There is a destination for every ``dest_chars`` characters of the table, so that what one task merges
    (some five bytes a character at most, and ``hot`` suffixes of any one gram) does not grow with it."""
    if not 0 < gram <= width <= gram + 255:
        raise ValueError("a window has to hold its gram and may be up to 255 bytes longer")
    base = df.select(
        common.order_id(text, row_id).alias("kid"), F.col(row_id).isNull().alias("unnamed"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    # One exchange of the texts, which the plan's three readers share.
    docs = base.repartition("kid").withColumn(
        "seq", F.row_number().over(Window.partitionBy("kid").orderBy("t")).cast("long") - 1
    )
    chars = df.agg(F.sum(F.length(text)).alias("n")).first().n or 0
    parts = max(common.partitions(df), -(-chars // dest_chars))

    def as_bytes(t: str) -> np.ndarray:
        return np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, more = [], []
            for kid, seq, t in zip(pdf["kid"], pdf["seq"], pdf["t"]):
                at, h, first, last = anchors(as_bytes(t), width, gram)
                if not len(at):
                    continue
                # The anchor's place with its windows' reach to the left: position, high, low.
                packed = at << 16 | (at - first) << 8 | (at - last)
                distinct, own, where = np.unique(h, return_index=True, return_inverse=True)
                own_more: list = [None] * len(distinct)
                if len(distinct) < len(h):  # a text of one repeated phrase has few grams: one row for each
                    order = np.argsort(where, kind="stable")
                    cuts = np.flatnonzero(np.diff(where[order])) + 1
                    for k, places in enumerate(np.split(order, cuts)):
                        if len(places) > 1:
                            own_more[k] = packed[places[1:]]
                more += own_more
                n = len(distinct)
                rows.append((np.full(n, kid), np.full(n, seq), packed[own], distinct.view(np.int64)))
            if rows:
                kids, seqs, packed, hashes = (np.concatenate(x) for x in zip(*rows))
                yield pd.DataFrame({"kid": kids, "seq": seqs, "at": packed, "more": more, "h": hashes})

    found = docs.mapInPandas(find, "kid long, seq long, at long, more array<long>, h long")
    here = F.lit(1) + F.coalesce(F.size("more"), F.lit(0))
    counted = found.withColumn("n", F.sum(here).over(Window.partitionBy("h"))).filter("n > 1")
    places = F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<long>")))
    wanted = counted.groupBy("kid").agg(
        F.collect_list(F.struct("seq", places.alias("at"), (F.col("n") > hot).alias("hot"))).alias("wanted")
    )

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = defaultdict(list)
        size = 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"dest": list(held), "run": [encode_run(v) for v in held.values()]})

        for pdf in batches:
            for kid, seq, t, rows in zip(pdf["kid"], pdf["seq"], pdf["t"], pdf["wanted"]):
                data = t.encode("utf-8", "surrogatepass")
                for packed, is_hot in ((x, row["hot"]) for row in rows if row["seq"] == seq for x in row["at"]):
                    packed = int(packed)
                    at, high, low = packed >> 16, packed >> 8 & 255, packed & 255
                    if is_hot:
                        for a in range(low, high + 1):
                            whole = data[at - a : at - a + width]
                            dest = xxhash.xxh64_intdigest(whole) % parts
                            held[dest].append((whole[a:], whole[:a][::-1], a, a, kid, seq, at))
                    else:
                        dest = xxhash.xxh64_intdigest(data[at : at + gram]) % parts
                        suffix, before = data[at : at + width - low], data[at - high : at][::-1]
                        held[dest].append((suffix, before, low, high, kid, seq, at))
                    size += high - low + 1 if is_hot else 1
                if size >= run_entries:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    sent = docs.join(wanted, "kid").mapInPandas(runs, "dest int, run binary")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = repeated(pdf["run"].tolist(), width, gram)
        return pd.DataFrame({"kid": out[:, 0], "seq": out[:, 1], "s": out[:, 2], "e": out[:, 3]})

    ranges = sent.repartition(parts, "dest").groupBy("dest").applyInPandas(merge, "kid long, seq long, s long, e long")
    by_doc = ranges.groupBy("kid").agg(F.collect_list(F.struct("seq", "s", "e")).alias("ranges"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kid, unnamed, seq, t, found in zip(pdf["kid"], pdf["unnamed"], pdf["seq"], pdf["t"], pdf["ranges"]):
                data = t.encode("utf-8", "surrogatepass")
                cut = [(r["s"], r["e"]) for r in found if r["seq"] == seq] if found is not None else []
                gone = merged(np.array(cut, dtype=np.int64).reshape(-1, 2)).tolist()
                kept, last = [], 0
                for a, b in gone:
                    kept.append(data[last:a])
                    last = b
                left = b"".join([*kept, data[last:]])
                row = (None if unnamed else kid, len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest())
                rows.append((*row, left) if texts else row)
            names = ["kid", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * texts
            yield pd.DataFrame(rows, columns=names).astype({"kid": "Int64"})

    shape = "kid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * texts
    done = docs.join(by_doc, "kid", "left").mapInPandas(finish, shape)
    # Partitions that fit the texts are far too small for digests: gathered, they are written in few files, without
    # Python's workers at work. Remaining bytes are as large as the texts and stay where they are.
    done = done if texts else done.hint("rebalance")
    return done.withColumnRenamed("kid", row_id)
