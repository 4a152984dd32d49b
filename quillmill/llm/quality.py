"""Document quality by co-training of two views.

One logistic classifier reads the text (hashed words and character shapes, and measures of form), the other
the row's metadata (source and language). Both start from labelled documents. In each round both views score
all unlabelled documents; those that one view is surest of, a share of the corpus, the other view learns, in
shards whose weights are averaged, and then it sees the labelled documents again. The views are calibrated on
labelled documents that neither learned, and a logistic model of the two calibrated logits, fitted on others
of those, scores all documents.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import logistic

WORDS = 4096
FORMS = 9
META = 512
#: Classes of bytes: 0 others, 1 capitals, 2 digits, 3 marks that prose seldom has.
KIND = np.zeros(256, dtype=np.uint8)
KIND[65:91], KIND[48:58] = 1, 2
KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'!?()\"-_"]] = 3
LETTERS = bytes(88 if 65 <= b < 91 else 57 if 48 <= b < 58 else 120 if 97 <= b < 123 or b == 63 else b for b in range(256))


FEATURES = "idx array<int>, cnt array<int>, form array<double>, meta array<int>"


def text_features(text: str | None) -> tuple[list[int], list[int], np.ndarray]:
    """Hashed indices, their counts, and measures of the text's form."""
    text = text or ""
    words = text.split()
    distinct = Counter(words)
    counts: dict[int, int] = defaultdict(int)
    shapes: dict[bytes, int] = defaultdict(int)
    crc = zlib.crc32
    for w, n in distinct.items():
        counts[crc(w.lower().encode("utf-8", "surrogatepass")) % (WORDS // 2)] += n
        shapes[w[-4:].encode("ascii", "replace").translate(LETTERS)] += n
    for s, n in shapes.items():
        counts[WORDS // 2 + crc(s) % (WORDS // 2)] += n
    kinds = np.bincount(KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)], minlength=4)
    n, m = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    form = np.array([
        np.log1p(len(words)) / 8, len(distinct) / n, sum(map(len, words)) / n / 10, kinds[1] / m, kinds[3] / m,
        kinds[2] / m, len(set(lines)) / len(lines), sum(map(eq, words, words[1:])) / n,
        (text.count(".") + text.count("!") + text.count("?")) / n,
    ])
    return list(counts), list(counts.values()), form


def meta_features(source: str | None, lang: str | None) -> list[int]:
    """Hashed indices of the metadata's values and their pair."""
    keys = (f"source={source}", f"lang={lang}", f"{source}|{lang}")
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % META for k in keys]


def both_views(idx, cnt, form, meta):
    """(indices, weights) of the row for the text view and for the metadata view."""
    weight = np.log1p(np.asarray(cnt, dtype=float))
    weight /= np.sqrt((weight**2).sum()) + 1e-9
    text = np.concatenate([np.asarray(idx, dtype=np.int64), WORDS + np.arange(FORMS)]), np.concatenate([weight, form])
    return text, (np.asarray(meta, dtype=np.int64), np.ones(len(meta)))


def rows_of(pdf: pd.DataFrame) -> list:
    return [both_views(*x) for x in zip(pdf["idx"], pdf["cnt"], pdf["form"], pdf["meta"])]


@dataclass
class View:
    """A linear classifier of sparse rows (indices, weights) with dense columns behind them."""

    dims: int
    w: np.ndarray

    def logit(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([self.w[i] @ v for i, v in rows]) + self.w[-1]

    def learn(self, rows, y: np.ndarray, cost: np.ndarray, rounds: int, seed: int = 3) -> None:
        """AdaGrad on the logistic loss, from the weights it has, in one fixed order of rows a pass."""
        rng = np.random.default_rng(seed)
        self.w = self.w.copy()
        seen = np.full(self.dims + 1, 1e-2)
        for _ in range(rounds):
            for k in rng.permutation(len(rows)):
                i, v = rows[k]
                p = 1 / (1 + np.exp(-np.clip(self.w[i] @ v + self.w[-1], -30, 30)))
                g = cost[k] * (p - y[k])
                grad = g * v + 1e-4 * self.w[i]
                seen[i] += grad**2
                self.w[i] -= 0.3 * grad / np.sqrt(seen[i])
                seen[-1] += g * g
                self.w[-1] -= 0.3 * g / np.sqrt(seen[-1])


@dataclass
class Model:
    text: View
    meta: View
    text_scale: np.ndarray
    meta_scale: np.ndarray
    joint: np.ndarray

    def score(self, texts, sources, langs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [both_views(*text_features(t), meta_features(s, g)) for t, s, g in zip(texts, sources, langs)]
        a, b = calibrated(self.text, self.meta, self.text_scale, self.meta_scale, rows)
        joint = np.stack([a, b], axis=1) @ self.joint[:2] + self.joint[2]
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (a, b, joint))


def calibrated(text: View, meta: View, text_scale: np.ndarray, meta_scale: np.ndarray, rows: list) -> list[np.ndarray]:
    views = (text, text_scale), (meta, meta_scale)
    return [v.logit([r[k] for r in rows]) * scale[0] + scale[1] for k, (v, scale) in enumerate(views)]


def fresh_views() -> tuple[View, View]:
    return View(WORDS + FORMS, np.zeros(WORDS + FORMS + 1)), View(META, np.zeros(META + 1))


def constant(share: float) -> Model:
    """Without both labels every document gets the share of ones."""
    flat = np.array([0.0, np.log(share / (1 - share))])
    return Model(*fresh_views(), flat, flat, np.array([0.5, 0.5, 0.0]))


def on_sample(sample: DataFrame, work: Callable[[list, np.ndarray, np.ndarray], object]):
    """What ``work`` makes, in one task, of the bounded sample's rows, labels and parts, in order of id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("id")
        yield pd.DataFrame({"out": [pickle.dumps(work(rows_of(pdf), pdf["y"].to_numpy(dtype=float), pdf["part"].to_numpy()))]})

    return pickle.loads(sample.repartition(1).mapInPandas(run, "out binary").first().out)


def study(weights: list[np.ndarray], passes: int) -> Callable:
    """Both views learn the labelled rows of part 0, from the weights given."""

    def work(rows, y, part):
        views = fresh_views()
        own = np.flatnonzero(part == 0)
        for k, view in enumerate(views):
            view.w = weights[k]
            view.learn([rows[i][k] for i in own], y[own], np.ones(len(own)), passes)
        return [v.w for v in views]

    return work


def calibrate(weights: list[np.ndarray]) -> Callable:
    """The scales of both views by the rows of part 1, the joint model by those of part 2."""

    def work(rows, y, part):
        views = fresh_views()
        scales = []
        one, two = np.flatnonzero(part == 1), np.flatnonzero(part == 2)
        for k, view in enumerate(views):
            view.w = weights[k]
            scales.append(logistic(view.logit([rows[i][k] for i in one])[:, None], y[one]))
        both = np.stack(calibrated(*views, *scales, [rows[i] for i in two]), axis=1)
        return [*scales, logistic(both, y[two])]

    return work


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", source: str = "source",
    lang: str = "lang", label: str = "quality", max_labelled: int = 3000, rounds: int = 2, sure: float = 0.02,
    shard: int = 5000,
) -> Model:
    """A model fitted on at most max_labelled labelled documents, those with the smallest hashes, and in each
    round on the surest unlabelled ones of the whole table: of both classes together a share ``sure``, divided
    as the labels are, and whatever ties with them. No document of the held-out fifth (crc32 of the id as
    text, modulo 5) teaches anything. Rows without an id are not learned from; of labelled rows that share an
    id one counts. The driver holds two weight tables (37 kB) and thresholds."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = labels.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    usable = "id is not null and pmod(crc32(cast(id as string)), 5) <> 0"
    chosen = known.filter(usable).orderBy(F.xxhash64("id"), "id").limit(max_labelled)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *text_features(t), meta_features(s, g)) for i, t, s, g in zip(pdf["id"], pdf["t"], pdf["s"], pdf["l"])]
            yield pd.DataFrame(rows, columns=["id", "idx", "cnt", "form", "meta"])

    src = docs.select(F.col(row_id).cast("long").alias("id"), blank(text).alias("t"), blank(source).alias("s"), blank(lang).alias("l"))
    rows = common.materialise(src.filter(usable).mapInPandas(extract, f"id long, {FEATURES}"), "quality-features")
    whole = F.min(F.struct("idx", "cnt", "form", "meta")).alias("f")
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(whole).select("id", "y", "f.*")
    # Seven tenths are learned; of the rest one half sets the scales, the other the joint model.
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(20))
    sample = common.materialise(sample.withColumn("part", F.when(place < 14, 0).when(place < 17, 1).otherwise(2)), "quality-sample")
    sizes = {(r.part, r.y): r.n for r in sample.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, every = sum(n for (_, y), n in sizes.items() if y), sum(sizes.values())
    if any(not sizes.get((p, y)) for p in range(3) for y in (0, 1)):
        return constant(float(np.clip(ones / every if every else 0.5, 1e-3, 1 - 1e-3)))

    weights = on_sample(sample, study([v.w for v in fresh_views()], 25))
    # One exchange of the features, by the same join at any size of the labels; the rounds read what it leaves.
    free = common.materialise(rows.join(known.select("id").hint("merge"), "id", "left_anti"), "quality-free")
    cuts = [sure * (1 - ones / every), 1 - sure * ones / every]
    for _ in range(rounds):
        weights = taught(free, weights, cuts, shard)
        weights = on_sample(sample, study(weights, 8))
    text_view, meta_view = fresh_views()
    text_view.w, meta_view.w = weights
    return Model(text_view, meta_view, *on_sample(sample, calibrate(weights)))


def taught(free: DataFrame, weights: list[np.ndarray], cuts: list[float], shard: int) -> list[np.ndarray]:
    """The weights of both views after each has learned what the other one is surest of among all rows."""

    def logits(pdf: pd.DataFrame) -> tuple[list, list[np.ndarray]]:
        views, rows = fresh_views(), rows_of(pdf)
        for view, w in zip(views, weights):
            view.w = w
        return rows, [v.logit([r[k] for r in rows]) for k, v in enumerate(views)]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, (a, b) = logits(pdf)
            yield pd.DataFrame({"a": a, "b": b})

    found = free.mapInPandas(score, "a double, b double").agg(*(F.percentile_approx(c, cuts, 10_000).alias(c) for c in "ab")).first()
    if found.a is None:
        return weights
    low, high = zip(*((min(q[0], -1.0), max(q[1], 1.0)) for q in (found.a, found.b)))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows with the label that the metadata view gives the text view (to_text), and the other way round."""
        for pdf in batches:
            _, values = logits(pdf)
            marks = [np.where(v <= lo, 0, np.where(v >= hi, 1, -1)) for v, lo, hi in zip(values, low, high)]
            out = pdf.assign(to_text=marks[1], to_meta=marks[0])
            yield out[(marks[0] >= 0) | (marks[1] >= 0)]

    shape = f"id long, {FEATURES}, to_text int, to_meta int"
    chosen = common.materialise(free.mapInPandas(pick, shape), "quality-taught")
    shards = max(1, -(-chosen.count() // shard))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        rows, out = rows_of(pdf), []
        for k, (view, mark) in enumerate(zip(fresh_views(), ("to_text", "to_meta"))):
            own = np.flatnonzero(pdf[mark].to_numpy() >= 0)
            view.w = weights[k]
            view.learn([rows[i][k] for i in own], pdf[mark].to_numpy(dtype=float)[own], np.full(len(own), 0.5), 2)
            out.append(pd.DataFrame({"k": k, "i": np.arange(len(view.w)), "w": view.w * len(own), "n": len(own)}))
        return pd.concat(out)

    dealt = chosen.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    sums = dealt.groupBy("shard").applyInPandas(learn, "k int, i int, w double, n long").groupBy("k", "i").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    new = [w.copy() for w in weights]
    for r in sums.filter("n > 0").collect():  # a row for each weight
        new[r.k][r.i] = r.w / r.n
    return new


def classify(df: DataFrame, model: Model, text: str = "text", row_id: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """One row per row of df: id, held_out, text_score, meta_score, score (0 to 1, higher: better) and
    predicted (score >= 0.5). Null and empty texts and null metadata are scored like any value. Repeated rows
    come back once each; an empty table gives an empty result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b, joint = model.score(pdf["t"].tolist(), pdf["s"].tolist(), pdf["l"].tolist())
            yield pd.DataFrame({"id": pdf["id"], "text_score": a, "meta_score": b, "score": joint})

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = df.select(F.col(row_id).cast("long").alias("id"), blank(text).alias("t"), blank(source).alias("s"), blank(lang).alias("l"))
    scored = src.mapInPandas(run, "id long, text_score double, meta_score double, score double")
    fifth = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5))
    return scored.select(
        F.col("id").alias(row_id), F.coalesce(fifth == 0, F.lit(False)).alias("held_out"), "text_score", "meta_score", "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
