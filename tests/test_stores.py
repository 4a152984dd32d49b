"""Stored indexes and exact quantiles against brute force."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import blockmax, bm25, feedback, ivf, quantiles, vector
from quillmill.sources import stores


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")


def found(df):
    return sorted((r.qid, r["rank"], r.id) for r in df.collect())


def test_index_of_cells_is_exact_if_all_is_probed_and_close_if_not(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((30, 16))[rng.integers(0, 30, 1500)] * 3 + rng.standard_normal((1500, 16))
    x[100:160] = x[7]  # many equal rows
    rows = vectors(spark, x).unionByName(spark.createDataFrame([(9000, None)], "id long, vector array<double>"))
    asked = vectors(spark, x[::50]).withColumnRenamed("id", "qid").unionByName(spark.createDataFrame([(77, None)], "qid long, vector array<double>"))
    path = str(tmp_path / "ivf")
    ivf.build(rows, path, cells=20, parts=4, sample=600)
    assert spark.read.parquet(f"{path}/rows").count() == 1500
    exact = found(vector.top_k(rows, asked, 10))
    assert found(ivf.search(spark, path, asked, probe=20, shortlist=1500)) == exact
    near = found(ivf.search(spark, path, asked, probe=5, shortlist=150))
    assert len(set(near) & set(exact)) >= 0.9 * len(exact)
    plan = ivf.candidates(spark, path, [r for r in asked.filter("vector is not null").select("qid", F.col("vector").alias("qv")).limit(1).collect()], 2, 10)
    assert len(plan.select("cell").distinct().collect()) <= 2 and plan.count() == 10


def test_index_of_no_rows_finds_nothing(spark, tmp_path):
    none = vectors(spark, [])
    ivf.build(none, str(tmp_path / "ivf"))
    asked = vectors(spark, [[1.0, 2.0]]).withColumnRenamed("id", "qid")
    assert ivf.search(spark, str(tmp_path / "ivf"), asked).collect() == []


def test_stored_text_index_gives_the_same_and_follows_the_table(spark, tmp_path):
    at = str(tmp_path / "docs")
    spark.createDataFrame([(1, "alpha beta_gamma"), (2, "alpha alpha"), (3, None)], "id long, text string").write.parquet(at)
    builds = []

    def index():
        docs = spark.read.parquet(at)
        return stores.stored(docs, "test", "stats", lambda path: builds.append(path) or bm25.store(docs, "id", "text", path))

    first = index()
    assert index() == first and len(builds) == 1
    shape = lambda i: [sorted(map(tuple, t.collect())) for t in (i.postings, i.lengths, i.terms, i.stats)]
    assert shape(bm25.Index.read(spark, first)) == shape(bm25.build(spark.read.parquet(at), "id", "text"))
    spark.createDataFrame([(4, "delta")], "id long, text string").write.mode("append").parquet(at)
    assert index() != first and len(builds) == 2


@pytest.mark.parametrize("n", [0, 1, 2, 9, 500, 501])
def test_medians(spark, monkeypatch, n):
    monkeypatch.setattr(quantiles, "BUCKETS", 4)
    monkeypatch.setattr(quantiles, "FETCHED", 3)
    rng = random.Random(n)
    values = [rng.choice([0.0, 1e-300, -5.5, 7.0, 7.0, rng.random(), rng.gauss(0, 1e9), 1e308, -1e308]) for _ in range(n)]
    rows = [(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)]
    got = quantiles.median(spark.createDataFrame(rows, "x double"), "x")
    assert got == (statistics.median(values) if n else None)


def brute_scores(index, terms):
    """{(qid, id): score} of all pairs that share a term."""
    idf = {r.term: r.idf for r in index.terms.collect()}
    dl = {r.id: r.dl for r in index.lengths.collect()}
    avg = index.stats.first().avgdl
    held: dict = {}
    for r in index.postings.collect():
        held.setdefault(r.term, []).append((r.id, r.tf))
    out: dict = {}
    for qid, term, qtf in terms:
        for doc, tf in held.get(term, ()):
            part = qtf * idf[term] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl[doc] / avg))
            out[qid, doc] = out.get((qid, doc), 0.0) + part
    return out


def brute_top(scores, k):
    out = []
    for qid in {q for q, _ in scores}:
        rows = sorted((-round(s, 6), d) for (q, d), s in scores.items() if q == qid)[:k]
        out += [(qid, i + 1, d) for i, (_, d) in enumerate(rows)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([1, 3, 10, 40, 200]))) for _ in range(400)]
    texts[50:90] = [texts[49]] * 40  # ties beyond k
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "w0 " * 3000), (903, "中文")]
    return bm25.build(spark.createDataFrame(rows, "id long, text string"), "id", "text")


ASKED = [(1, "w0", 1.0), (1, "w7", 2.0), (2, "w60", 1.0), (2, "w90", 1.0), (2, "w3", 1.0), (3, "none", 1.0), (4, "w119", 0.5), (5, "w0", 1.0)]


@pytest.mark.parametrize("window,probe", [(1, 1), (8, 2), (16, 24), (10_000, 1)])
def test_pruned_search_equals_scoring_all(spark, tmp_path, corpus, window, probe):
    path = str(tmp_path / "blocks")
    blockmax.store(corpus, path, window)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg(F.sum("n")).first()[0] == corpus.postings.count()
    assert blocks.filter(f"size(entries) > {window} or size(entries) <> n").count() == 0
    terms = spark.createDataFrame(ASKED, "qid long, term string, qtf double")
    assert found(blockmax.search(spark, path, terms, 10, probe)) == brute_top(brute_scores(corpus, ASKED), 10)


def test_windows_that_cannot_win_are_left_out(spark, tmp_path):
    """One document of 600 holds all words of the question, ten hold two: the others' windows are not scored."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "b", "c", "d"], k=1) + [f"x{i}"] * 3) for i in range(600)]
    texts[300:312] = ["a b c d rare"] * 12
    index = bm25.build(spark.createDataFrame([*enumerate(texts)], "id long, text string"), "id", "text")
    blockmax.store(index, str(tmp_path / "b"), 8)
    terms = spark.createDataFrame([(1, t, 1.0) for t in ("a", "b", "c", "d", "rare")], "qid long, term string, qtf double")
    row = blockmax.reading(spark, str(tmp_path / "b"), terms, 10, 4).first()
    assert row.postings > 600 and row.live_postings <= 12 * 5 + 40 and row.live_windows <= 3


def test_blocks_of_no_documents_find_nothing(spark, tmp_path):
    blockmax.store(bm25.build(spark.createDataFrame([], "id long, text string"), "id", "text"), str(tmp_path / "b"))
    terms = spark.createDataFrame(ASKED, "qid long, term string, qtf double")
    assert blockmax.search(spark, str(tmp_path / "b"), terms).collect() == []


def test_feedback_equals_a_plain_relevance_model(spark, corpus):
    terms = spark.createDataFrame(ASKED, "qid long, term string, qtf double")
    first = bm25.top(bm25.scores(corpus, terms), 10)
    ranked = [r for r in first.collect() if r.score > 0]
    tf: dict = {}
    for r in corpus.postings.collect():
        tf.setdefault(r.id, {})[r.term] = r.tf
    dl = {r.id: r.dl for r in corpus.lengths.collect()}
    idf = {r.term: r.idf for r in corpus.terms.collect()}
    want = {}
    for qid in {r.qid for r in ranked}:
        rows = [r for r in ranked if r.qid == qid]
        total = sum(r.score for r in rows)
        p: dict = {}
        for r in rows:
            for term, n in tf[r.id].items():
                if idf[term] > 0:
                    p[term] = p.get(term, 0.0) + r.score / total * n / dl[r.id] * idf[term]
        kept = sorted(p, key=lambda t: (-round(p[t], 12), t))[:7]
        want |= {(qid, t): 0.5 * p[t] / sum(p[x] for x in kept) for t in kept}
    for qid, term, n in ASKED:
        want[qid, term] = want.get((qid, term), 0.0) + 0.5 * n / sum(x for q, _, x in ASKED if q == qid)
    model = feedback.relevance_model(corpus, first, added=7)
    got = {(r.qid, r.term): r.qtf for r in feedback.rewritten(terms, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert {t for q, t in got if q == 3} == {"none"}  # nothing found: the question's own words stay
