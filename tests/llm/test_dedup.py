import hashlib
import pathlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import common, exact_dedup, line_dedup, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, kept string, digest string, n int"
EDGES = [
    (1, "a b\tc", "x", "x", 1), (2, "abc  ", "x", "x", 1), (3, "abc", None, None, None), (4, None, "x", "x", 1), (5, "", "x", "x", 1), (6, " \n\x0b\x0c\r", "x", "x", 1),
    (7, "other", "x", "x", 1), (7, "other", "x", "x", 1), (None, "null id", "x", "x", 1), (None, None, "x", "x", 1), (8, "abc\x85", "x", "x", 1), (9, "long " * 40_000, "x", "x", 1), (10, "long " * 40_000, "x", "x", 1),
]


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, len(t or "")))
    out, seen = [], set()
    for body, members in groups.items():
        ids = [m for m in members if m[0] is not None]
        best = max(n for _, n in members)
        same = [i for i, n in members if n == best and i is not None]
        # the longest, then the smallest id; rows without an id only if none of the longest has one
        keep = min(same) if same else None
        for i, n in sorted(members, key=lambda m: -m[1]):
            kept = i == keep and (i, body) not in seen
            if kept:
                seen.add((i, body))
            out.append((i, keep, len(members), kept, hashlib.sha256(body.encode()).hexdigest()))
        assert ids or keep is None
    return sorted(out, key=repr)


def test_exact_groups_match_brute_force_and_keep_one_row_each(spark):
    got = exact_dedup.assign(spark.createDataFrame(EDGES, SCHEMA))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_exact(EDGES)
    stay = exact_dedup.keep_first(spark.createDataFrame(EDGES, SCHEMA))
    assert stay.columns == ["doc_id", "text", "kept", "digest", "n"]
    assert sorted([r.doc_id for r in stay.collect()], key=repr) == sorted([r[0] for r in brute_exact(EDGES) if r[3]], key=repr)


def test_a_weak_digest_does_not_merge_different_texts(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "a a"), (4, "c"), (5, "b b")], "doc_id long, text string")
    weak = exact_dedup.assign(df, digest=lambda body: F.length(body).cast("string"))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in weak.collect()} == {1: (3, 2), 2: (5, 2), 3: (3, 2), 4: (4, 1), 5: (5, 2)}


def part_files(folder):
    return sum(p.name.startswith("part-") for p in folder.iterdir())


def test_exact_groups_are_written_in_few_files(spark, tmp_path):
    """Forty partitions of a few rows each are no reason for forty files, neither of the groups nor of the result."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    groups = pathlib.Path(common.shared_dir(spark).removeprefix("file://"), "quillmill")
    old = set(groups.glob("exact-groups-*"))
    rows = [(i, f"text {i % 300}", None, None, None) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        exact_dedup.assign(spark.createDataFrame(rows, SCHEMA)).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    (new,) = set(groups.glob("exact-groups-*")) - old
    assert part_files(new) <= 2 and part_files(tmp_path / "out") <= 2
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.assign(none).count() == 0
    assert exact_dedup.keep_first(none).count() == 0
    assert simhash.group(none).count() == 0
    assert simhash.drop_near_copies(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert line_dedup.remove_repeats(none).count() == 0


def brute_fingerprint(text, k=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [2048, 3])
def test_simhash_groups_match_brute_force(spark, block):
    rng = random.Random(block)
    words = ["".join(rng.choice("abcdé") for _ in range(4)) for _ in range(80)]
    docs = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "\x85a b")]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(5, 90):
        w = list(base) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 150))]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join(w)))
    got = {r.doc_id: r for r in simhash.group(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


def test_every_pair_within_the_radius_meets_in_a_table():
    rng = np.random.default_rng(3)
    for radius in (1, 4, 6):
        table = simhash.masks(radius)
        assert len(table) == 2 ** (radius + 1) - 1
        for _ in range(300):
            bits = rng.choice(64, rng.integers(0, radius + 1), replace=False)
            diff = np.uint64(sum(1 << int(b) for b in bits))
            assert ((table & diff) == 0).any()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(-5, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}, -5: -5, 300: -5}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = text(300)
    near = list(base)
    near[10], near[200] = "changed", "too"
    docs = [(5, " ".join(base), "a"), (2, " ".join(near), "b"), (9, " ".join(base), "c"), (7, " ".join(text(300)), "d"), (8, None, "e"), (3, "", "f"), (None, " ".join(base), "g")]
    got = simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string, member string"))
    assert sorted(r.member for r in got.collect()) == ["b", "d", "e", "f", "g"]


def brute_near(docs, similarity=0.8):
    kept, stay = [], []
    for i, t in sorted(docs):
        w = t.encode().lower().split()
        own = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
        if not any(len(own & x) >= similarity * len(own | x) for x in kept):
            kept.append(own)
            stay.append(i)
    return stay


@pytest.mark.parametrize("batch", [256, 3])
def test_families_of_one_component_are_all_compared(spark, batch):
    """Rows with one set of words are one component; more families in it than any fixed number of pivots."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(120)]
    docs = []
    for family in range(12):
        base = rng.sample(vocabulary, len(vocabulary))
        for copy in range(3):
            own = list(base)
            own[copy * 30 + 5], own[copy * 30 + 6] = own[copy * 30 + 6], own[copy * 30 + 5]
            docs.append((100 * copy + family, " ".join(own)))
    got = simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"), batch=batch)
    assert sorted(r.doc_id for r in got.collect()) == brute_near(docs) == list(range(12))


def brute_repeats(docs, width=100):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if b[p : p + width] in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(b[p : p + width])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_strings_match_brute_force(spark, hot):
    rng = random.Random(hot)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 70))) for _ in range(5)]
    docs = [(None, passages[0]), (0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 101), (4, "x" * 101), (5, "ab " * 300), (6, "é" * 400)]
    for i in range(7, 60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 5))]
        docs.append((i, " ".join(parts)[rng.randint(0, 9) :]))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot, run_entries=40)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repeats(docs)


def test_digests_of_texts_are_written_in_few_files(spark, tmp_path):
    """Forty partitions of texts are no reason for forty files of digests; remaining bytes are not moved once more."""
    few = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(k) for k in few}
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    passage = noise(200)
    docs = [(None, passage), *((i, f"{noise(2500)} {passage if i % 3 else ''} {noise(2500)}") for i in range(80))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        suffix_dedup.remove_repeats(df).write.parquet(str(tmp_path / "out"))
        suffix_dedup.remove_repeats(df, texts=True).write.parquet(str(tmp_path / "texts"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert part_files(tmp_path / "out") <= 2 and part_files(tmp_path / "texts") > 4
    for name in ("out", "texts"):
        got = spark.read.parquet(str(tmp_path / name)).collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_repeats(docs)


def test_loser_tree_sorts_and_knows_common_prefixes():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    runs = [sorted(strings[i::7]) for i in range(7)]

    def coded(run):
        before = b""
        for x in run:
            yield suffix_dedup.common_prefix(before, x), x
            before = x

    places, out, shared = [0] * 7, [], []
    for n, k in suffix_dedup.LoserTree([coded(r) for r in runs]):
        out.append(runs[k][places[k]])
        places[k] += 1
        shared.append(n)
    assert out == sorted(strings)
    assert all(n == suffix_dedup.common_prefix(a, b) for n, a, b in zip(shared[1:], out, out[1:]))


def test_simhash_of_odd_rows(spark):
    long = "word " * 50_000 + "end"
    rows = [(None, "a b c d e", "x"), (None, None, "x"), (1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, long, "x"), (3, long + " more", None), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("fp", F.lit("z")).withColumn("root", F.lit(1))
    got = sorted((r.doc_id is not None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.group(df).collect() if r.doc_id is not None)
    fps = {i: brute_fingerprint(t) for i, t, _ in rows if i is not None}
    want = brute_components(fps)
    assert [g[1:] for g in got] == [(i, f"{fps[i]:016x}", want[i]) for i in (1, 1, 2, 3, 4)]
    nulls = [(r.fingerprint, r.component_id) for r in simhash.group(df).collect() if r.doc_id is None]
    assert sorted(nulls) == sorted([(f"{fps[1]:016x}", 1), ("0" * 16, 4)])


def test_rows_that_share_an_id_are_near_copies_of_their_own(spark):
    rng = random.Random(8)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(200)]
    base, other = text(), text()
    near = [*base[:100], "changed", *base[101:]]
    rows = [(1, " ".join(base)), (5, " ".join(near)), (5, " ".join(other)), (7, " ".join(other)), (5, " ".join(other))]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone_", F.lit(1)).withColumn("comp", F.lit(2)))
    assert got.columns == ["doc_id", "text", "gone_", "comp"]
    assert sorted((r.doc_id, r.text == rows[0][1]) for r in got.collect()) == [(1, True), (5, False), (5, False)]


def test_near_copies_in_a_long_chain_and_their_recall(spark):
    """Each text is a near copy of the ones before and after it, those further off are not."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    chain, docs = [word() for _ in range(300)], []
    for i in range(60):
        docs.append((i, " ".join(chain)))
        chain[rng.randrange(300)] = word()
        chain[rng.randrange(300)] = word()
    got = simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"), batch=7)
    left, want = sorted(r.doc_id for r in got.collect()), brute_near(docs)
    assert 5 < len(want) < 30 and left == want


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, "line one\nline two\n" * 20_000, 1, "a"), (2, "short", 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kid int, n_removed string").withColumn("seq", F.lit(0)).withColumn("dest", F.lit(0)).withColumn("digest", F.lit(0))
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect())) == brute_repeats([r[:2] for r in rows])
    got = {r.doc_id: r for r in line_dedup.remove_repeats(df, passage_words=50).collect()}
    assert got[1].n_lines == 40_001 and got[1].n_removed > 39_900 and got[2].text == "short"


def test_rows_that_share_an_id_are_one_document_of_lines(spark):
    rng = random.Random(2)
    block = "\n".join(f"line {i} of the block {rng.random()}" for i in range(10))
    more = "\n".join(f"tail {i}" for i in range(9))
    rows = [(1, block), (1, block), (1, block + "\n" + more), (0, "first\n" + more), (None, block), (2, "x")]
    for passage in (None, 50):
        got = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), passage_words=passage)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_rows(rows, passage)


def brute_rows(rows, passage, window=2, every=4, longest=64):
    """Chunks and passages over all rows in order, by a rolling hash that is computed anew for each line."""
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def cut(lines):
        h = [xxhash.xxh64_intdigest(x.encode()) for x in lines]
        out, start = [], 0
        for i in range(len(lines)):
            rolled = 0
            for x in h[max(0, i + 1 - window) : i + 1]:
                rolled = (rolled * base + x) & mask
            ends = i + 1 >= window and ((((rolled ^ (rolled >> 31)) * base) & mask) >> 40) % every == 0
            if ends or i - start + 1 >= longest or i == len(lines) - 1:
                out.append((start, i + 1))
                start = i + 1
        return out

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, pairs, out = set(), {}, []
    for place, (i, t) in enumerate(order):
        lines, gone = t.split("\n"), set()
        for a, b in cut(lines):
            body = tuple(lines[a:b])
            if b - a > 1 and body in seen:
                gone |= set(range(a, b))
            seen.add(body)
        if passage is not None:
            again, start = [], None
            for k, pair in enumerate(zip(lines, lines[1:])):
                first = pairs.setdefault(pair, (place, k))
                again.append(first[0] < place or k - first[1] >= 2)
            for k, x in enumerate([*again, False]):
                if x and start is None:
                    start = k
                elif not x and start is not None:
                    if sum(len(y.split()) for y in lines[start : k + 1]) > passage:
                        gone |= set(range(start, k + 1))
                    start = None
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, len(lines), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out, key=repr)


def brute_lines(docs, **shape):
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for _, lines in line_dedup.chunks(t, **shape):
            if len(lines) > 1:
                first.setdefault(tuple(lines), i)
    out = []
    for i, t in docs:
        kept, seen, n = [], set(), 0
        for _, lines in line_dedup.chunks(t, **shape):
            n += len(lines)
            if len(lines) > 1 and (first[tuple(lines)] != i or tuple(lines) in seen):
                continue
            seen.add(tuple(lines))
            kept += lines
        left = "\n".join(kept)
        out.append((i, n, n - len(kept), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [line_dedup.strong, lambda body: "same"])
def test_repeated_line_chunks_match_brute_force(spark, digest):
    rng = random.Random(4)
    lines = [f"line {i} {'x' * rng.randint(0, 9)}" for i in range(60)]
    blocks = [[rng.choice(lines) for _ in range(rng.randint(6, 20))] for _ in range(4)]
    docs = [(None, "\n".join(blocks[0])), (0, None), (1, ""), (2, "\n"), (3, "one line")]
    for i in range(4, 40):
        own = [rng.choice(lines) for _ in range(rng.randint(0, 6))]
        docs.append((i, "\n".join(own + (rng.choice(blocks) if rng.random() < 0.7 else []) + own[:2])))
    shape = {"window": 2, "every": 4, "longest": 64}
    got = line_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), digest=digest)
    expected = brute_lines(docs, **shape)
    assert sum(r[2] for r in expected) > 0
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected


def test_short_passages_inside_different_documents_go(spark, tmp_path):
    from quillmill.llm import queries

    rng = random.Random(9)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    passages = [[line() for _ in range(2 + n % 5)] for n in range(20)]
    docs, expected = [(-1, "a\nb\n" + line())], {-1: 0}
    for i in range(60):
        head, tail = [line() for _ in range(rng.randint(1, 6))], [line() for _ in range(rng.randint(1, 6))]
        docs.append((i, "\n".join(head + passages[i % 20] + tail)))
        expected[i] = len(passages[i % 20]) if i >= 20 else 0
    own = [line(), line()]
    docs += [(70, "\n".join([*own, line(), *own])), (71, "a\nb\n" + line())]
    expected |= {70: 2, 71: 0}
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    for i, t in docs[:-2]:
        gone = set(passages[i % 20]) if i >= 20 else set()
        assert got[i].text == "\n".join(x for x in t.split("\n") if x not in gone)
    assert {i: r.n_removed for i, r in got.items()} == expected


def test_chunk_borders_resist_shifts():
    lines = [f"row {i}" for i in range(400)]
    a = {tuple(x) for _, x in line_dedup.chunks("\n".join(lines), 2, 4, 64)}
    b = {tuple(x) for _, x in line_dedup.chunks("\n".join(["new", "lines"] + lines), 2, 4, 64)}
    assert len(a & b) >= len(a) - 2


def test_shared_folder_is_the_session_one(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
