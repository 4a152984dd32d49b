"""Searches inside the tasks: against scoring all pairs, on odd rows, and what their plans exchange."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.operators import blockmax, bm25, fusion, vector
from quillmill.plans import catalogue


@pytest.fixture()
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def words(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(["the", "aB", "cat_x", "dog", "rare%d" % (i % 7)], [9, 3, 2, 2, 1], k=rng.randint(0, 30))) for i in range(n)]


@pytest.fixture()
def tables(spark, tmp_path):
    """Documents with repeated ids, rows without one, and quoted questions."""
    texts = words(120, 1)
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "cat_x only here"), (5, None), (None, "dog the"), (None, "rare1 aB")]
    rows = [(i, t, "en", f"src{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(i, texts[i * 9][:40]) for i in range(8)] + [(50, "nothing zz"), (51, ""), (52, "the the dog")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def oracle(name, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    return sorted(map(repr, con.execute(catalogue.ORACLES[name]).fetchall()))


@pytest.mark.parametrize("name", ["bm25_idf", "bm25_stats", "bm25_topk", "feedback_topk"])
def test_repeated_and_missing_ids_count_as_in_the_sql(spark, tables, name):
    assert sorted(repr(tuple(r)) for r in catalogue.QUERIES[name](spark, tables).collect()) == oracle(name, tables)


def pairs(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


def test_search_and_ranks_equal_scoring_all_pairs_in_any_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(words(300, 2))), "id long, text string")
    index = bm25.build(docs, "id", "text")
    terms = bm25.question_terms(spark.createDataFrame(list(enumerate(words(9, 3))), "qid long, q string"), "qid", "q")
    every = bm25.scores(index, terms)
    targets = spark.createDataFrame([(q, t) for q in range(9) for t in (q * 3, 299 - q)] + [(77, 1), (1, 5000)], "qid long, target long")
    placed = sorted(map(str, bm25.rank_of(every, targets).collect()))
    best = pairs(bm25.top(every, 7))
    assert pairs(bm25.search(index, terms, 7)) == best and sorted(map(str, bm25.ranks(index, terms, targets).collect())) == placed
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 9)
    monkeypatch.setattr(bm25, "CELLS", 50)
    monkeypatch.setattr(bm25, "COUNTED", 7)
    assert pairs(bm25.search(index, terms, 7)) == best and sorted(map(str, bm25.ranks(index, terms, targets).collect())) == placed


def test_only_the_best_rows_are_exchanged(spark, no_small_tables):
    index = bm25.build(spark.createDataFrame(list(enumerate(words(60, 4))), "id long, text string"), "id", "text")
    asked = spark.createDataFrame([(1, "the dog"), (2, "cat_x")], "qid long, question string")
    plan = physical(bm25.retrieve(index, asked, "qid", "question"))
    assert "Join" not in plan and plan.count("Exchange ") == 1
    assert "Exchange hashpartitioning" not in physical(vector.hashed_embedding(index.documents.select("id", F.lit("a").alias("text")), "id", "text"))


def test_texts_do_not_travel_to_few_results(spark, no_small_tables, monkeypatch):
    chunks = spark.range(50).selectExpr("id", "'t' as text", "'f' as file", "'k' as chunk_type", "'n' as name")
    fused = spark.createDataFrame([(1, 3, 1), (1, 4, 2)], "qid long, id long, rank int")
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "qid long, question string")
    made = fusion.prompts(fused, chunks, asked)
    assert "BroadcastHashJoin [id" in physical(made)
    rows = sorted(map(str, made.collect()))
    monkeypatch.setattr(fusion, "BROADCAST_RESULTS", 1)
    other = fusion.prompts(fused, chunks, asked)
    assert "BroadcastHashJoin" not in physical(other) and sorted(map(str, other.collect())) == rows


def test_judged_texts_do_not_travel(spark, tables, no_small_tables):
    assert "BroadcastHashJoin [id" in physical(catalogue.QUERIES["judged_answers"](spark, tables))


def test_a_second_run_needs_no_blocks(spark, tables, monkeypatch):
    monkeypatch.setattr(blockmax, "store", None)
    assert catalogue.QUERIES["feedback_topk"](spark, tables).count() > 0


@pytest.mark.parametrize("name", ["eval_transition", "eval_three_way"])
def test_documents_are_searched_for_quotations_once(spark, tmp_path, name):
    texts = words(40, 6)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[3]), (2, texts[4])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    assert "MapInPandas" not in optimised(found)
    assert sorted(repr(tuple(r)) for r in found.collect()) == oracle(name, tmp_path)


def test_blank_documents_count_in_the_statistics(spark, tmp_path):
    rows = [(1, "a", "s"), (2, " \t", "s"), (3, None, "s"), (4, "", "t"), (4, "b", "t"), (None, "c", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["corpus_stats"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == [("s", 3, 3), ("t", 1, 2), (None, 0, 1)]


@pytest.mark.parametrize("probe", [False, True])
def test_candidates_are_those_of_the_buckets_and_do_not_travel(spark, monkeypatch, no_small_tables, probe):
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.standard_normal((150, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, vector array<double>")
    asked = rows.filter("id % 10 = 0").withColumnRenamed("id", "qid")
    signs = (x @ np.random.default_rng(5).standard_normal((6, 8)) > 0).reshape(150, 2, 4)
    want = []
    for q in range(0, 150, 10):
        near = [i for i in range(150) if ((signs[i] != signs[q]).sum(axis=1) <= probe).any()]
        order = sorted(near, key=lambda i: (round(float(((x[i] - x[q]) ** 2).sum()), 6), i))[:4]
        want += [(q, r, i) for r, i in enumerate(order, 1)]
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 6)
    monkeypatch.setattr(vector, "BLOCK_ROWS", 40)
    found = vector.approximate_top_k(rows, asked, 4, 6, probe=probe, bits=4, tables=2, seed=5)
    assert sorted((r.qid, r["rank"], r.id) for r in found.collect()) == sorted(want)
    assert "Join" not in physical(found)


def test_windows_that_tasks_cut_are_put_together(spark, tmp_path, monkeypatch):
    """Blocks dealt at random, a few at a time: nearly no window is whole anywhere."""
    index = bm25.build(spark.createDataFrame(list(enumerate(words(200, 7))), "id long, text string"), "id", "text")
    terms = bm25.question_terms(spark.createDataFrame(list(enumerate(words(6, 8))), "qid long, q string"), "qid", "q")
    blockmax.store(index, str(tmp_path / "own"))
    best, read = (f(spark, str(tmp_path / "own"), terms, 5, 3) for f in (blockmax.search, blockmax.reading))
    want = pairs(bm25.top(bm25.scores(index, terms), 5)), sorted(map(str, read.collect()))
    assert pairs(best) == want[0] and read.filter("live_windows < windows").count() > 0
    spark.read.parquet(str(tmp_path / "own" / "terms")).write.parquet(str(tmp_path / "cut" / "terms"))
    spark.read.parquet(str(tmp_path / "own" / "blocks")).repartition(5).write.parquet(str(tmp_path / "cut" / "blocks"))
    monkeypatch.setattr(blockmax, "CELLS", 20)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 12)
    cut = str(tmp_path / "cut")
    assert (pairs(blockmax.search(spark, cut, terms, 5, 3)), sorted(map(str, blockmax.reading(spark, cut, terms, 5, 3).collect()))) == want


def test_blocks_are_exchanged_once_and_not_at_all_by_a_search(spark, tmp_path, no_small_tables):
    index = bm25.build(spark.createDataFrame(list(enumerate(words(60, 4))), "id long, text string"), "id", "text")
    terms = bm25.question_terms(spark.createDataFrame([(1, "the dog")], "qid long, q string"), "qid", "q")
    blockmax.store(index, str(tmp_path))
    plan = physical(blockmax.search(spark, str(tmp_path), terms))
    assert "Join" not in plan and "term" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


@pytest.mark.parametrize("name", ["bm25_pruned_topk", "bm25_postings_read"])
def test_blocks_of_odd_tables_give_the_rows_of_the_sql(spark, tables, name):
    found = catalogue.QUERIES[name](spark, tables)
    assert sorted(repr(tuple(r)) for r in found.collect()) == oracle(name, tables)


def test_texts_without_an_asked_word_are_scored_too(spark):
    """A task that meets no term of any question, and a target among its documents."""
    index = bm25.build(spark.createDataFrame([(1, "a"), (2, "b"), (3, "")], "id long, text string").repartition(3), "id", "text")
    terms = spark.createDataFrame([(1, "a", 1)], "qid long, term string, qtf long")
    targets = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "qid long, target long")
    assert sorted((r.target, r["rank"]) for r in bm25.ranks(index, terms, targets).collect()) == [(1, 1), (2, None), (3, None)]
