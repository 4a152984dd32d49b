"""Conversation repair, centroid clustering and secret scans against brute force."""

import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest

from quillmill.llm import clustering, conversations, queries, secrets

SPACE = " \t\n\x0b\x0c\r"

# ---- conversations


def brute_damage(rows):
    out, known = [], []
    for conv, turn, role, text in rows:
        known.append(conv)
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(key.encode()) % 20
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        row = (conv, turn, "user" if draw == 4 else role, text)
        out += [row] * (2 if draw == 3 else 1)
    return known, out


def brute_repair(rows):
    """All cheapest edits by states and whole letter strings: (cost, letters, repaired rows), letters compared last."""
    paths = {"": (0, "", ())}

    def better(found, state, path):
        if state not in found or path[:2] < found[state][:2]:
            found[state] = path

    def grown(found):
        for _ in range(3):
            for state, (cost, letters, kept) in list(found.items()):
                if state in ("", "s", "a"):
                    better(found, "u", (cost + 5, letters + "I", (*kept, ("user", ""))))
                else:
                    better(found, "a", (cost + 5, letters + "I", (*kept, ("assistant", ""))))
        return found

    for role, text, fault in rows:
        found = {}
        extra = 5 if fault == "truncated" else 0
        for state, (cost, letters, kept) in grown(paths).items():
            better(found, state, (cost + 2, letters + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            for to in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                if role[:1] == to:
                    better(found, to, (cost + extra, letters + "K", (*kept, (role, text))))
                elif to != "s":
                    name = "user" if to == "u" else "assistant"
                    better(found, to, (cost + extra + 1, letters + "R", (*kept, (name, text))))
        paths = found
    ends = [p for s, p in grown(paths).items() if s in ("", "a")]
    return min(ends, key=lambda p: p[:2])


def brute_conversations(rows):
    known, left = brute_damage(rows)
    out = []
    for conv in set(known):
        mine = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, judged, faults, odd = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, 0
        for i, (_, _, role, text) in enumerate(mine):
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            odd += i > 0 and mine[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
            judged.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, letters, kept = brute_repair(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], odd, cost, letters, digest))
    return sorted(out, key=repr)


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def summary(df):
    return sorted((tuple(r) for r in conversations.summaries(conversations.damaged(df)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repairs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]
    texts = ["Hello there.", "Yes!", "Why?", "cut off here", "", "\t ", None, "a\nb.", "Ünï。", "x ! \x0b"]
    rows = []
    for conv in range(120):
        length = rng.choice([0, 1, 2, 5, 9, 30])
        for turn in range(length):
            at = rng.choice([turn, turn, turn, turn + 3, None, -turn, 0])
            rows.append((rng.choice([conv] * 9 + [None]), at, rng.choice(roles), rng.choice(texts)))
    assert summary(talk(spark, rows)) == brute_conversations(rows)


def test_letters_are_the_least_of_all_cheapest_edits():
    """Against every edit sequence of short conversations, not a search by states."""
    legal = {"", *("s" * s + "ua" * n for s in (0, 1) for n in range(4))} - {"s"}
    for kinds in itertools.product(["u", "a", "s", "x"], repeat=3):
        for faults in itertools.product(["", "blank", "truncated"], repeat=2):
            judged = list(zip(kinds, ["t."] * 3, [*faults, ""], strict=True))
            best = None
            for final in legal:
                # D or use of each row in order; a place of the result that no row fills is inserted
                for used in range(min(len(final), 3) + 1):
                    for rows in itertools.combinations(range(3), used):
                        for places in itertools.combinations(range(len(final)), used):
                            cost, marks, fine = 5 * (len(final) - used), {}, True
                            for r, p in zip(rows, places, strict=True):
                                role, _, fault = judged[r]
                                fine &= fault != "blank" and (role == final[p] or final[p] != "s")
                                cost += (role != final[p]) + 5 * (fault == "truncated")
                                marks[r] = p
                            fine &= "s" not in [final[p] for p in range(len(final)) if p not in places]
                            cost += 2 * (3 - used)
                            if not fine or best is not None and cost > best[0]:
                                continue
                            # between two used rows, inserted places and deleted rows may stand in any order
                            for letters in orders(marks, judged, final):
                                if best is None or (cost, letters) < best:
                                    best = (cost, letters)
            got = []
            names = {"u": "user", "a": "assistant", "s": "system", "x": "x"}
            repair = conversations.Repair(lambda edit, role, text: got.append(edit))
            code = {"": conversations.NONE, "blank": conversations.BLANK, "truncated": conversations.TRUNCATED}
            for role, text, fault in judged:
                repair.read(names[role], text, code[fault])
            assert (repair.end(), "".join(got)) == best


def orders(marks, judged, final):
    gaps, row, place = [], 0, 0
    for r, p in [*sorted(marks.items()), (len(judged), len(final))]:
        d, i = r - row, p - place
        mixed = {"".join("I" if at in chosen else "D" for at in range(d + i)) for chosen in itertools.combinations(range(d + i), i)}
        gaps.append(mixed)
        if r < len(judged):
            gaps.append({"K" if judged[r][0] == final[p] else "R"})
        row, place = r + 1, p + 1
    return map("".join, itertools.product(*gaps))


def test_open_edits_stay_few_in_a_long_conversation():
    given, most = 0, 0

    def give(*_):
        nonlocal given
        given += 1

    repair, rng = conversations.Repair(give), random.Random(5)
    for i in range(20_000):
        role = rng.choice(["user", "assistant"]) if i % 7 == 0 else ("user", "assistant")[i % 2]
        repair.read(role, f"t{i}.", conversations.NONE)
        deepest = max(node.depth for _, node in repair.paths.values())
        most = max(most, deepest - repair.root.depth)
    repair.end()
    assert given >= 20_000 and most < 200


def test_conversations_of_odd_rows(spark):
    """Empty table; only damaged-away rows; nulls everywhere; a very long text; columns whose names clash."""
    assert summary(talk(spark, [])) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, None, None), (None, None, None, None), (5000, 1, "user", "w " * 200_000 + ".")]
    found = summary(talk(spark, rows))
    assert found == brute_conversations(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found
    wide = talk(spark, rows)
    for name in ("gone", "digest_", "seen_", "fault", "copy_", "place", "edit", "cost"):
        wide = wide.selectExpr("*", f"7 as {name}")
    assert summary(wide) == found


def test_edits_are_those_of_the_summary(spark):
    rows = conversations.damaged(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    edits = {}
    for r in sorted(conversations.repaired(rows).collect(), key=lambda r: (r.conv_id, r.place)):
        edits.setdefault(r.conv_id, []).append(r)
    for r in conversations.summaries(rows).collect():
        mine = edits.get(r.conv_id, [])
        assert "".join(e.edit for e in mine) == r.audit
        body = "\n".join(f"{e.role}:{e.text}" for e in mine if e.edit != "D")
        assert hashlib.sha256(body.encode()).hexdigest() == r.repaired_sha256


# ---- clusters


def brute_clusters(rows, k, dims, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (named(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        own = [min((far(v, c), n) for n, c in enumerate(at)) for _, v in kept]
        if turn < rounds:
            for n in range(len(at)):
                mine = [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == n]
                at[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else at[n]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, own, strict=True)), key=repr), at


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize(("seed", "k", "step"), [(1, 7, 1.0), (2, 12, 0.25), (3, 1, 0.5), (4, 2, 1.0)])
def test_clusters_match_brute_force(spark, seed, k, step):
    """Coarse grids give many equal distances and equal rows; odd vectors are left out; ids are null or repeat."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-4, 5, 4) * step]) for i in range(300)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (None, [0.1, -0.1, 1e-9, 3.0])]
    rows += [(901, None), (902, [1.0]), (903, [1.0, None, 0.0, 0.0]), (904, [math.nan] * 4), (905, [math.inf, 0.0, 0.0, 0.0]), (906, [])]
    for n in (300, 40):
        sample = rows[:n] + rows[300:]
        found, at = clustering.cluster(vectors(spark, sample), k=k, dims=4, rounds=4)
        want, centroids = brute_clusters(sample, k, 4, 4)
        assert at.tolist() == centroids
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=repr) == want


def test_clusters_of_few_rows_and_of_none(spark):
    two = vectors(spark, [(1, [0.0] * 4), (2, [1.0] * 4)]).selectExpr("*", "3 as a_", "4 as count_", "5 as cluster")
    found, at = clustering.cluster(two, k=40, dims=4)
    assert len(at) == 2 and sorted(r.distance for r in found.collect()) == [0, 0]
    none, at = clustering.cluster(vectors(spark, [(1, None)]), k=40, dims=4)
    assert none.collect() == [] and clustering.described(none, at).collect() == []


def test_bounds_leave_most_rows_unsearched():
    """On separate groups most rows keep their centroid by the bounds alone."""
    rng = np.random.default_rng(9)
    middles = rng.integers(-20_000, 20_000, (20, 8))
    x = middles[rng.integers(0, 20, 4000)] + rng.integers(-100, 100, (4000, 8))
    old = clustering.Centroids(middles.astype(np.int64))
    state = old.first(x)
    now = clustering.Centroids(middles + 3, middles.astype(np.int64))
    searched = []
    plain = now.search
    now.search = lambda rows, *rest: searched.append(len(rows)) or plain(rows, *rest)
    a, *_ = now.again(x, *state)
    assert sum(searched) < 400
    assert (a == np.stack([clustering.squares(x, np.broadcast_to(c, x.shape)) for c in now.at], axis=1).argmin(axis=1)).all()


# ---- secrets

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")


def brute_base(text):
    """The three patterns by hand, character by character."""
    out, at = [], 0
    while at < len(text):
        end = None
        for word in WORDS:
            part = text[at : at + len(word)]
            if part.isascii() and part.lower() == word:
                for quoted in ((1, 0) if text[at + len(word) : at + len(word) + 1] in ("'", '"') else (0,)):
                    p = at + len(word) + quoted
                    while text[p : p + 1] == " ":
                        p += 1
                    if text[p : p + 1] not in (":", "="):
                        continue
                    p += 1
                    while text[p : p + 1] == " ":
                        p += 1
                    p += text[p : p + 1] in ("'", '"') and text[p : p + 1] != ""
                    q = p
                    while q < len(text) and text[q] in VALUE:
                        q += 1
                    if q > p:
                        end = q
                        if q - p >= 12:
                            out.append((at, 0, q))
                        break
                if end:
                    break
        at = end or at + 1
    for kind, (head, allowed, least) in enumerate((("AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), ("", "0123456789abcdef", 16)), 1):
        at = 0
        while at < len(text):
            q = at + len(head)
            while text.startswith(head, at) and q < len(text) and text[q] in allowed:
                q += 1
            if text.startswith(head, at) and q > at + len(head):
                if q - at >= least:
                    out.append((at, kind, q))
                at = q
            else:
                at += 1
    return sorted(out)


def test_base_spans_match_a_scan_by_hand(spark):
    rng = random.Random(4)
    bits = [*WORDS, "PassWord", "API_KEY", "ſecret", "toKen", ":", "=", " ", '"', "'", "\t", "\n", "AKIA", "AKIAIOSF", "IOSFODNN7EXAMPLE", "abcdef0123456789", "deadbeef", "x+/_.=-9", "ü", "𝒳", "0" * 16, "A1B2C3D4E5F6"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(1, 40)))) for i in range(1500)] + [(-1, ""), (-2, None), (None, "token=abcdefabcdef"), (7, "same"), (7, "same")]
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows += [(r.doc_id + 10_000, r.text) for r in whole]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as text_", "2 as spans")
    found = secrets.digests(secrets.scan(docs)).collect()
    want = []
    for i, text in rows:
        spans = brute_base(text or "")
        shown = ",".join(f"{secrets.KINDS[kind]}:{start}:{end}" for start, kind, end in spans)
        counts = [sum(kind == k for _, kind, _ in spans) for k in range(3)]
        want.append((i, *counts, hashlib.sha256(shown.encode()).hexdigest(), shown))
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, ",".join(s for s in r.spans.split(",") if s and not s.startswith("lexed"))) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 100 and sum(w[2] for w in want) > 100 and sum(w[3] for w in want) > 100
    assert secrets.digests(secrets.scan(docs.limit(0))).collect() == []


@pytest.mark.parametrize(
    ("source", "literals"),
    [
        ("db_password = 'Tr0ub4dor&3x'", ["Tr0ub4dor&3x"]),
        ('{"client_secret": "q8Zr-11xPw_0"}', ["q8Zr-11xPw_0"]),
        ("conf['auth_token'] = \"u7Gh2kLm9Qp\"", ["u7Gh2kLm9Qp"]),
        ("x = 'k9Fj3mQ0zW1'\ny = x\nstorage_key = y", ["k9Fj3mQ0zW1"]),
        ("private_key = a + b\na = 'Zx81Qm'\nb = 'p0Lk77'", ["Zx81Qm", "p0Lk77"]),
        ('put("apiKey", "aB3dE5fG7h")', ["aB3dE5fG7h"]),
        ('conn.setPassword("aB3dE5fG7h")', ["aB3dE5fG7h"]),
        ("<password>aB3dE5fG7h</password>", ["aB3dE5fG7h"]),
        ("run --access-key aB3dE5fG7h", ["aB3dE5fG7h"]),
        ("export SIGNING_KEY=aB3dE5fG7h", ["aB3dE5fG7h"]),
        ('val pwd: String = "aB3dE5fG7h"', ["aB3dE5fG7h"]),
        ("colour = 'aB3dE5fG7h'", []),
        ("password = 'changeme'", []),
        ("password = os.environ['PASSWORD']", []),
        ("password_file = '/etc/app/pw.txt'", []),
        ("password: ${DB_PASSWORD}", []),
        ("if password == 'aB3dE5fG7h':", []),
        ("a = b\nb = a\nsecret = a", []),
        ("The secret: patience and time, he said.", []),
    ],
)
def test_literals_by_the_names_they_reach(source, literals):
    lexed = [source[s[1] : s[2]] for s in secrets.spans_of(source, 0.4) if s[0] == "lexed"]
    assert lexed == literals


@pytest.mark.parametrize("unit", ["password = '", "a = b + ", "x(\"", "<a>", "token: ", "p = q\n", "--", "\\\"", "key='x',"])
def test_time_of_a_scan_grows_with_the_text(unit):
    taken = []
    for size in (50_000, 400_000):
        text = unit * (size // len(unit))
        start = time.process_time()
        secrets.spans_of(text, 0.4)
        taken.append(time.process_time() - start)
    assert taken[1] < 24 * taken[0] + 1


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_clustering", "op13_secret_scan"])
def test_queries_return_one_row_each(spark, name):
    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES[name](spark, sf)
    if name == "op11_conversation_repair":
        assert rows.count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    elif name == "op13_secret_scan":
        assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    else:
        assert rows.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
