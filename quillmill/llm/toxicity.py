"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

*Kernel.* A window of text is mapped to its gapped character subsequences of three and four letters; a
subsequence that spans s characters counts decay^s. The kernel of two windows is the product of these
vectors, so an insult with a character put in, left out or spaced apart still shares most of them.

*Training.* A labelled document says only that some sentence in it is toxic. Windows around character
sequences that toxic documents hold far more often than clean ones start as positives, with copies that have
characters inserted; then positives and the hardest windows of clean documents are taken anew by score. The
machine (squared hinge, Newton's method) is linear in the Nyström features K(L, L)^-1/2 K(L, x).

*Scoring.* f(x) = sum_j a_j K(l_j, x) = W . phi(x) with W = sum_j a_j phi(l_j): the subsequence map is
explicit, so all landmarks fold into one table of weights and a text of n characters costs O(n). A document's
score is a logistic function, fitted on labelled documents that the machine did not see, of its best
window's value. Nothing but the text enters a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LETTERS = 64
SPAN = 7
STARTS = 8
REACH = SPAN + STARTS
#: Digits that stand for letters: 0 o, 1 i, 3 e, 4 a, 5 s, 7 t.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
BUCKETS = 1 << 20


def _alphabet() -> np.ndarray:
    """Codes of the Basic Multilingual Plane: 0 separates; a-z 1 to 26; other digits 27; other letters share
    28 to 63 by code point."""
    points = np.arange(1 << 16)
    codes = 28 + points % 36
    codes[:128] = 0
    codes[0x80:0xAA] = 0
    codes[0x2000:0x2070] = 0
    codes[0x3000:0x3040] = 0
    for i in range(26):
        codes[97 + i] = 1 + i
    for d in "0123456789":
        codes[ord(d)] = codes[ord(LOOKS_LIKE[d])] if d in LOOKS_LIKE else 27
    return codes.astype(np.uint8)


CODES = _alphabet()


def encode(text: str | None) -> np.ndarray:
    """The text's letters as codes, with each run of other characters as one 0; letters that stand alone next
    to one another, as in a word spaced apart, are joined."""
    raw = (text or "").lower().encode("utf-32-le", "surrogatepass")
    codes = CODES[np.minimum(np.frombuffer(raw, dtype=np.uint32), 0xFFFF)]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    gap = np.concatenate([[True], codes == 0, [True]])
    alone = ~gap[1:-1] & gap[:-2] & gap[2:]
    between = np.zeros(len(codes), dtype=bool)
    between[1:-1] = alone[:-2] & alone[2:]
    return codes[~between]


def terms(codes: np.ndarray, decay: float) -> Iterator[tuple[np.ndarray, np.ndarray, float, bool]]:
    """For each shape of subsequence: feature ids and validity by start position, the weight, and whether it
    has four. A separator counts only in three neighbouring characters and as the first of four: it marks a
    word's edge."""
    n = len(codes) - SPAN
    if n <= 0:
        return
    codes = codes.astype(np.uint32)
    letter = codes != 0
    for a in range(1, SPAN):
        two = codes[:n] * LETTERS + codes[a : a + n]
        for b in range(a + 1, SPAN):
            three = two * LETTERS + codes[b : b + n]
            inner = letter[a : a + n] & letter[b : b + n]
            if b == 2:
                edge = letter[:n] & (letter[a : a + n] | letter[b : b + n])
                yield three, inner | edge, decay ** (b + 1), False
            else:
                yield three, inner & letter[:n], decay ** (b + 1), False
            for c in range(b + 1, SPAN):
                four = (three * LETTERS + codes[c : c + n]) * np.uint32(0x9E3779B1) >> np.uint32(12)
                yield four, inner & letter[c : c + n], decay ** (c + 1), True


def features(windows: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and weights, a row for each window of REACH codes; four-letter ids follow the others."""
    ids, weights = [], []
    windows = windows.astype(np.uint8)
    for s in range(STARTS):
        part = windows[:, s : s + SPAN + 1]
        flat = np.concatenate([part, np.zeros((len(part), 1), dtype=np.uint8)], axis=1)
        width = flat.shape[1]
        for got, valid, w, four in terms(np.concatenate([flat.ravel(), np.zeros(SPAN, dtype=np.uint8)]), decay):
            at = np.arange(len(part)) * width
            ids.append(got[at].astype(np.int64) + (LETTERS**3 if four else 0))
            weights.append(np.where(valid[at], w, 0.0))
    return np.stack(ids, axis=1), np.stack(weights, axis=1).astype(np.float32)


@dataclass
class Model:
    triples: np.ndarray
    quads: np.ndarray
    bias: float
    decay: float
    logistic: np.ndarray

    def profile(self, texts: list[str | None], piece: int = 1 << 19) -> np.ndarray:
        """Each text's best window's value. Texts run through in pieces of bounded length that overlap by a
        window, so nothing is cut off."""
        best = np.full(len(texts), -np.inf)
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            stream = np.concatenate([x for _, _, x in held])
            starts = np.cumsum([0] + [len(x) for _, _, x in held[:-1]])
            values = self.windows(stream)
            # Windows that start behind a piece belong to the next one or would reach into the next text.
            bounds = np.stack([starts, starts + [own for _, own, _ in held]], axis=1).ravel()
            top = np.maximum.reduceat(values, bounds)[::2]
            for (doc, _, _), value in zip(held, top):
                best[doc] = max(best[doc], value)
            held, size = [], 0

        pad = np.zeros(REACH, dtype=np.uint8)
        for doc, text in enumerate(texts):
            codes = encode(text)
            for at in range(0, max(len(codes), 1), piece):
                part = np.concatenate([pad[:1], codes[at : at + piece + REACH - 1], pad])
                held.append((doc, 1 + len(codes[at : at + piece]), part))
                size += len(part)
                if size >= piece:
                    flush()
        flush()
        return best[:, None]

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """The value of the window that starts at each code."""
        total = np.zeros(len(codes), dtype=np.float32)
        n = len(codes) - SPAN
        for ids, valid, w, four in terms(codes, self.decay):
            total[:n] += (self.quads if four else self.triples).take(ids) * valid * np.float32(w)
        sums = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64), np.zeros(STARTS)])
        sums[len(codes) + 1 :] = sums[len(codes)]
        return sums[STARTS : STARTS + len(codes)] - sums[: len(codes)] + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.profile(texts) @ self.logistic[:1] + self.logistic[1])))


def newton(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 15) -> np.ndarray:
    """The squared-hinge machine: weights and bias (last), regularised by 1."""
    ridge = np.ones(z.shape[1] + 1)
    ridge[-1] = 1e-3
    w = np.zeros(z.shape[1] + 1)
    for _ in range(rounds):
        hessian, right = np.diag(ridge), np.zeros(len(w))
        for a in range(0, len(z), 2048):  # in blocks: no second copy of all features
            part = np.concatenate([z[a : a + 2048], np.ones((len(z[a : a + 2048]), 1), z.dtype)], axis=1, dtype=float)
            active = y[a : a + 2048] * (part @ w) < 1
            part, c = part[active], cost[a : a + 2048][active]
            hessian = hessian + (part * c[:, None]).T @ part
            right += part.T @ (c * y[a : a + 2048][active])
        new = np.linalg.solve(hessian, right)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by damped Newton steps; weights, then the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ (y - p) - 1e-2 * w)
        w = w + step / max(1.0, np.abs(step).max())
    return w


def cut(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Windows of REACH codes at the positions given."""
    padded = np.concatenate([codes, np.zeros(REACH, dtype=np.uint8)])
    return padded[np.clip(at, 0, len(codes))[:, None] + np.arange(REACH)]


def spread(windows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Copies of windows with one to four characters put in: separators or letters."""
    out = np.zeros_like(windows)
    for i, row in enumerate(windows):
        new = list(row)
        if rng.random() < 0.4:  # spaced apart altogether
            new = [x for c in row if c for x in (c, 0)]
        else:
            for _ in range(rng.integers(1, 4)):
                new.insert(int(rng.integers(2, 9)), 0 if rng.random() < 0.6 else int(rng.integers(1, 27)))
        out[i] = (new + [0] * REACH)[:REACH]
    return out


def fit(
    texts: list[str],
    labels: list[int],
    decay: float = 0.8,
    landmarks: int = 400,
    seed: int = 11,
    per_text: int = 40,
    max_toxic_windows: int = 4000,
    max_clean_windows: int = 8000,
    max_found_windows: int = 5000,
) -> Model:
    """A model of labelled texts (1: toxic). Without both labels every text gets the share of ones.

    The machine is fitted on at most per_text windows of a toxic text, max_toxic_windows and
    max_clean_windows windows in the first round and max_found_windows toxic windows in later ones, all drawn
    by the seed; the windows themselves are looked for in the whole of every text."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels)
    flat = Model(np.zeros(LETTERS**3, np.float32), np.zeros(BUCKETS, np.float32), 0.0, decay, np.zeros(2))
    if len(y) < 10 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        flat.logistic = np.array([0.0, np.log(share / (1 - share))])
        return flat
    codes = [np.concatenate([np.zeros(1, dtype=np.uint8), encode(t)]) for t in texts]
    fold = rng.random(len(y)) < 0.25
    for label in (0, 1):  # both parts see both labels
        own = np.flatnonzero(y == label)
        fold[own[0]], fold[own[-1]] = False, True
    learn, toxic = ~fold, y == 1

    def grams(c: np.ndarray) -> np.ndarray:
        n = len(c) - 4
        ids = c[:n].astype(np.int64) if n > 0 else np.zeros(0, dtype=np.int64)
        for k in range(1, 5):
            ids = ids * LETTERS + c[k : k + n] if n > 0 else ids
        return ids

    def counts(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = [np.unique(grams(codes[i])) for i in np.flatnonzero(which)]
        return np.unique(np.concatenate(seen or [np.zeros(0, np.int64)]), return_counts=True)

    bad, bad_n = counts(learn & toxic)
    good, good_n = counts(learn & ~toxic)
    at = np.clip(np.searchsorted(good, bad), 0, max(len(good) - 1, 0))
    clean = np.where(good[at] == bad, good_n[at], 0) if len(good) else np.zeros(len(bad))
    n_bad, n_good = int((learn & toxic).sum()), int((learn & ~toxic).sum())
    ratio = (bad_n / n_bad) / ((clean + 0.5) / n_good)
    telling = bad[(bad_n >= max(3, 0.006 * n_bad)) & (ratio >= 8)]
    positives = []
    for i in np.flatnonzero(learn & toxic):
        hit = np.flatnonzero(np.isin(grams(codes[i]), telling))
        if len(hit):
            starts = hit[np.concatenate(([True], np.diff(hit) > 6))]
            positives.append(cut(codes[i], np.concatenate([starts - 1, starts - 3])[:per_text]))
    if not positives:
        positives = [cut(codes[i], rng.integers(0, len(codes[i]), 4)) for i in np.flatnonzero(learn & toxic)]
    pos = np.unique(np.concatenate(positives), axis=0)
    pos = pos[rng.permutation(len(pos))[:max_toxic_windows]]
    neg = np.concatenate([cut(codes[i], rng.integers(0, len(codes[i]), 4)) for i in np.flatnonzero(learn & ~toxic)])
    neg = np.unique(neg, axis=0)
    neg = neg[rng.permutation(len(neg))[:max_clean_windows]]
    # Windows with little or nothing in them, as at a text's end, are clean.
    short = neg[rng.integers(0, len(neg), len(neg) // 10 + 5)].copy()
    short[np.arange(REACH)[None, :] >= rng.integers(0, 8, len(short))[:, None]] = 0
    neg = np.concatenate([neg, short])

    model = flat
    for round_ in range(3):
        every = np.concatenate([pos, spread(pos, rng), neg])
        target = np.concatenate([np.ones(2 * len(pos)), -np.ones(len(neg))])
        chosen = np.concatenate(
            [pos[rng.permutation(len(pos))[: landmarks * 5 // 8]], neg[rng.permutation(len(neg))[: landmarks * 3 // 8]]]
        )
        ids, weights = features(chosen, decay)
        known, inverse = np.unique(ids, return_inverse=True)
        whole = np.zeros((len(known) + 1, len(chosen)), dtype=np.float32)  # the last row: any other feature
        phi = whole[:-1]
        np.add.at(phi, (inverse.reshape(ids.shape), np.arange(len(chosen))[:, None]), weights)
        phi /= np.sqrt(np.einsum("ij,ij->j", phi, phi)) + 1e-6
        values, vectors = np.linalg.eigh((phi.T @ phi).astype(np.float64))
        whiten = vectors * (1 / np.sqrt(np.maximum(values, 1e-3)))
        row_of = np.full(LETTERS**3 + BUCKETS, len(known), dtype=np.int32)
        row_of[known] = np.arange(len(known))
        z = np.zeros((len(every), len(chosen)), dtype=np.float32)
        for a in range(0, len(every), 64):
            got, w = features(every[a : a + 64], decay)
            z[a : a + 64] = np.einsum("ij,ijk->ik", w, whole[row_of[got]])
        z = z @ whiten.astype(np.float32)
        cost = np.where(target > 0, len(neg) / (2 * len(pos)), 1.0)
        solved = newton(z, target, cost)
        table = np.zeros(LETTERS**3 + BUCKETS, dtype=np.float32)
        table[known] = phi @ (whiten @ solved[:-1]).astype(np.float32)
        model = Model(table[: LETTERS**3], table[LETTERS**3 :], float(solved[-1]), decay, np.zeros(2))
        if round_ == 2:
            break
        found, hard = [pos], [neg]
        for i in np.flatnonzero(learn):
            f = model.windows(np.concatenate([codes[i], np.zeros(REACH, dtype=np.uint8)]))
            if toxic[i]:
                top = np.array([int(f.argmax())])
                if f[top[0]] > -0.2:
                    found.append(cut(codes[i], top))
            else:
                top = np.argsort(-f)[:2]
                hard.append(cut(codes[i], top[f[top] > -0.8]))
        pos = np.unique(np.concatenate(found), axis=0)
        pos = pos[rng.permutation(len(pos))[:max_found_windows]]
        neg = np.unique(np.concatenate(hard), axis=0)
    shown = model.profile([texts[i] for i in np.flatnonzero(fold)])
    model.logistic = logistic(shown, y[fold].astype(float))
    return model


def labelled_sample(
    docs: DataFrame, labels: DataFrame, text: str, row_id: str, label: str, max_positive: int, max_negative: int, max_chars: int
) -> DataFrame:
    """(id, y, h, t): at most max_positive and max_negative labelled texts, those whose ids have the smallest
    hashes, and of each label no more than max_chars characters together: where they have more, the longest texts
    are left out, so one long text takes no other's place. Of rows that share an id the smallest text counts."""
    known = labels.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.filter("id is not null and y in (0, 1) and pmod(crc32(cast(id as string)), 5) <> 0")
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    take = lambda y, n: known.filter(F.col("y") == y).orderBy("h", "id").limit(n)
    ids = take(1, max_positive).unionByName(take(0, max_negative))
    texts = docs.select(F.col(row_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(ids), "id").groupBy("id", "y", "h").agg(F.min("t").alias("t"))
    upto = Window.partitionBy("y").orderBy(F.length("t"), "h", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chars", F.sum(F.length("t")).over(upto)).filter(F.col("chars") <= max_chars).drop("chars")


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    label: str = "toxic",
    max_positive: int = 1500,
    max_negative: int = 3500,
    max_chars: int = 30_000_000,
    **options,
) -> Model:
    """A model fitted on at most max_positive and max_negative labelled documents, taken whole, of at most
    max_chars characters a label (the longest are left out beyond it), whose id does not fall in the held-out fifth (crc32 of the id as text,
    modulo 5). The fit runs in one task of an executor; the driver gets the weight table alone (5 MB)."""
    sample = labelled_sample(docs, labels, text, row_id, label, max_positive, max_negative, max_chars)

    def fit_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(row for pdf in batches for row in zip(pdf["id"], pdf["y"], pdf["t"]))
        model = fit([t for _, _, t in rows], [y for _, y, _ in rows], **options)
        yield pd.DataFrame({"model": [pickle.dumps((model.triples, model.quads, model.bias, model.decay, model.logistic))]})

    fitted = sample.select("id", "y", "t").repartition(1).mapInPandas(fit_all, "model binary")
    found = common.materialise(fitted, "toxicity-model").first()
    return Model(*pickle.loads(found.model)) if found is not None else fit([], [])


def score(df: DataFrame, model: Model, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per row of df: id and score (0 to 1). Null and empty texts get the score of a text without
    any window, a constant. Repeated rows come back once each; an empty table gives an empty result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "score": model.score(pdf["t"].tolist())})

    src = df.select(F.col(row_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return src.mapInPandas(run, "id long, score double").withColumnRenamed("id", row_id)


def classify(df: DataFrame, model: Model, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """score() with held_out (the id's fifth that training never sees) and predicted (score >= 0.5).
    A null id counts as not held out."""
    fifth = F.pmod(F.crc32(F.col(row_id).cast("string").cast("binary")), F.lit(5))
    return score(df, model, text, row_id).select(
        row_id,
        F.coalesce(fifth == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df, all columns, whose score is below the threshold; null and empty texts stay."""
    (mark,) = common.fresh(df, "toxic_score_")

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    blank = F.coalesce(F.length(text), F.lit(0)) == 0
    return df.withColumn(mark, scored(F.coalesce(F.col(text), F.lit("")))).filter(blank | (F.col(mark) < threshold)).drop(mark)
