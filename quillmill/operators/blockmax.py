"""Exact BM25 top-k that leaves out what cannot win: postings in blocks of documents, each with its highest weight.

Documents are numbered by length and cut into windows of a few documents; a block is the postings of one term in one
window. A first pass reads terms and highest weights alone and bounds each window's scores for each question. The best
windows are scored whole; their k-th score is a threshold that the final k-th score cannot fall below, so only windows
whose bound reaches it are scored. Nothing is lost, however ids and lengths are spread.

The blocks of a window lie together, so the task that reads them bounds and scores the window for all questions. Where a
window is cut by the border of two tasks, each gives out its part, and the parts are added up: bounds, postings and
scores are sums over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bm25 import CELLS, Asked, Best, Index, asked_blocks, top, weight, write_table
from .numbering import dense, place

#: Documents of a window; windows of a question that are scored before the threshold is known.
WINDOW, PROBE = 4, 60
#: Scores are compared to six places, so bounds get a little more room.
SLACK = 1e-5
#: Documents that a task cuts into blocks at a time.
DOCUMENTS = 1_000
BLOCKS = "term string, window long, of long, n long, highest double, entries array<struct<id: long, weight: double>>"


def store(index: Index, path: str, window: int = WINDOW) -> None:
    """Writes blocks (term, window, of, n, highest, entries of (id, weight)) in ranges of windows. ``of`` is the number of
    the window's blocks; a block has at most ``window`` entries; weights are without the term's own, which stands in terms
    (term, idf). Only documents with a length are numbered. Whole documents travel once, to the range of their windows."""
    avgdl = index.stats.first().avgdl
    docs = index.documents.filter("id is not null and dl > 0").withColumn("id", F.col("id").cast("long"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = window * max(1, -(-docs.count() // (ranges * window)))
    first = (F.col("number_") > 0) & (F.col("number_") % size == 0)
    borders = dense(docs.select("dl", "id"), ["dl", "id"], "number_").filter(first).select("dl", "id").orderBy("dl", "id").collect()
    spread = docs.withColumn("range_", place(docs, ["dl", "id"], borders))
    number = F.col("range_") * F.lit(size).cast("long") + F.row_number().over(Window.partitionBy("range_").orderBy("dl", "id")) - 1
    placed = spread.withColumn("window", F.floor(number / window).cast("long")).select("window", "id", "dl", "terms", "tfs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = (batch.slice(at, DOCUMENTS) for batch in batches for at in range(0, batch.num_rows, DOCUMENTS))
        for table in whole_windows(few):
            lists = table["terms"].combine_chunks()
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            own, ids, dl = (table[c].to_numpy()[row] for c in ("window", "id", "dl"))
            coded = pc.dictionary_encode(lists.flatten())
            code = coded.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, code, own))
            own, code = own[order], code[order]
            value = weight(table["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dl, avgdl)[order]
            start = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (code[1:] != code[:-1])]) if len(own) else np.zeros(0, np.int64)
            _, place_of, blocks = np.unique(own[start], return_inverse=True, return_counts=True)
            ends = np.r_[start, len(own)]
            entries = pa.StructArray.from_arrays([pa.array(ids[order]), pa.array(value)], ["id", "weight"])
            columns = [
                coded.dictionary.take(pa.array(code[start])), pa.array(own[start]), pa.array(blocks[place_of]), pa.array(np.diff(ends)),
                pa.array(np.maximum.reduceat(value, start) if len(start) else value), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["term", "window", "of", "n", "highest", "entries"])

    write_table(index.terms.select("term", "idf"), f"{path}/terms")
    write_table(placed.mapInArrow(cut, BLOCKS), f"{path}/blocks")


def whole_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches in tables that end where a window ends."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        window = table["window"].to_numpy()
        end = int(np.flatnonzero(window != window[-1])[-1]) + 1 if len(window) and (window != window[-1]).any() else 0
        if end:
            yield table.slice(0, end)
        rest = table.slice(end)
    if rest is not None and rest.num_rows:
        yield rest


class Piece:
    """Some windows, whether each is whole, and those of their blocks whose terms are asked for."""

    def __init__(self, asked: Asked, windows: np.ndarray, whole: np.ndarray, row: np.ndarray, term: np.ndarray, blocks: pa.Table):
        self.asked, self.windows, self.whole, self.row, self.term, self.blocks = asked, windows, whole, row, term, blocks

    def total(self, column: str | None = None, by: np.ndarray | None = None) -> np.ndarray:
        """(windows, questions): the sum of a column of the blocks, or their number."""
        value = np.ones(len(self.row)) if column is None else self.blocks[column].to_numpy()
        return self.asked.sums(self.row, self.term, value, len(self.windows), by)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """No document of a window scores more than its bound; and whether the window holds a term of the question. A term
        of negative weight counts 0, since a document need not hold it."""
        return self.total("highest", self.asked.bound), self.total() > 0

    def scores(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, scores, held, whole) of the documents; held is true for pairs of ``wanted`` (windows, questions) alone."""
        some = wanted.any(axis=1)[self.row]
        lists = self.blocks["entries"].combine_chunks().filter(pa.array(some))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        entries = lists.flatten()
        ids, own = np.unique(entries.field("id").to_numpy(zero_copy_only=False), return_inverse=True)
        window = np.zeros(len(ids), dtype=np.int64)
        window[own] = np.repeat(self.row[some], sizes)
        found, held = self.asked.scores(own, np.repeat(self.term[some], sizes), entries.field("weight").to_numpy(zero_copy_only=False), len(ids))
        return ids, found, held & wanted[window], self.whole[window]


def pieces(batches: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[Piece]:
    for table in whole_windows(batches):
        windows, first, row, sizes = np.unique(table["window"].to_numpy(), return_index=True, return_inverse=True, return_counts=True)
        whole = sizes == table["of"].to_numpy()[first]
        term = asked.at(table["term"].combine_chunks())
        known = np.flatnonzero(term >= 0)
        # So many windows at a time that their terms meet no more than so many of the questions'.
        met = np.bincount(row[known], asked.start[term[known] + 1] - asked.start[term[known]], len(windows))
        part = (np.cumsum(met) // CELLS).astype(np.int64)
        for p in np.unique(part):
            low, high = np.searchsorted(part, [p, p + 1])
            mine = known[(row[known] >= low) & (row[known] < high)]
            yield Piece(asked, windows[low:high], whole[low:high], row[mine] - low, term[mine], table.take(pa.array(mine)))


def _rows(asked: Asked, row: np.ndarray, question: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(asked.qids[question]), *(pa.array(c[row, question] if c.ndim == 2 else c[row]) for c in columns.values())], ["qid", *columns])


def thresholds(blocks: DataFrame, asked: Asked, k: int, probe: int) -> np.ndarray:
    """The k-th score in each question's ``probe`` windows of the highest bounds; -inf for questions with fewer than k
    documents there, whose windows all stay."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(asked.qids, probe, 9)
        for piece in pieces(batches, asked):
            bound, held = piece.bounds()
            best.add(piece.windows, bound, held & piece.whole[:, None])
            yield _rows(asked, *np.nonzero(held & ~piece.whole[:, None]), window=piece.windows, bound=bound)
        yield best.batch().rename_columns(["qid", "window", "bound"])

    bounds = blocks.select("term", "window", "of", "highest").mapInArrow(bounded, "qid long, window long, bound double")
    bounds = bounds.groupBy("qid", "window").agg(F.sum("bound").alias("score")).withColumnRenamed("window", "id")
    first = top(bounds, probe, 9).select("qid", F.col("id").alias("window")).toPandas()
    n = len(asked.qids)
    pairs = np.unique(first["window"].to_numpy() * n + np.searchsorted(asked.qids, first["qid"].to_numpy()))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, asked):
            wanted = np.isin(piece.windows[:, None] * n + np.arange(n)[None, :], pairs)
            if wanted.any():
                ids, found, held, _ = piece.scores(wanted)
                yield _rows(asked, *np.nonzero(held), id=ids, score=found)

    scored = blocks.select("term", "window", "of", "entries").mapInArrow(probed, "qid long, id long, score double")
    least = top(scored.groupBy("qid", "id").agg(F.sum("score").alias("score")), k).filter(F.col("rank") == k).select("qid", "score").collect()
    out = np.full(n, -np.inf)
    for r in least:
        out[np.searchsorted(asked.qids, r.qid)] = r.score
    return out


def search(spark: SparkSession, path: str, terms: DataFrame, k: int = 10, probe: int = PROBE) -> DataFrame:
    """(qid, id, score, rank): the same rows as a ranking of all scores, for question terms (qid, term, qtf)."""
    blocks, found = spark.read.parquet(f"{path}/blocks"), spark.createDataFrame([], "qid long, id long, score double")
    for asked, _ in asked_blocks(spark.read.parquet(f"{path}/terms"), terms):
        least = thresholds(blocks, asked, k, probe)

        def best(batches: Iterator[pa.RecordBatch], asked=asked, least=least) -> Iterator[pa.RecordBatch]:
            kept = Best(asked.qids, k)
            for piece in pieces(batches, asked):
                bound, held = piece.bounds()
                ids, scores, held, whole = piece.scores(held & (~piece.whole[:, None] | (bound >= least - SLACK)))
                kept.add(ids, scores, held & whole[:, None])
                yield _rows(asked, *np.nonzero(held & ~whole[:, None]), id=ids, score=scores)
            yield kept.batch()

        part = blocks.select("term", "window", "of", "highest", "entries").mapInArrow(best, "qid long, id long, score double")
        found = found.unionByName(part)
    return top(found.groupBy("qid", "id").agg(F.sum("score").alias("score")), k)


def reading(spark: SparkSession, path: str, terms: DataFrame, k: int = 10, probe: int = PROBE) -> DataFrame:
    """(qid, windows, postings, live_windows, live_postings): what a question's terms have in all and what is scored."""
    counts = ["windows", "postings", "live_windows", "live_postings"]
    schema = "qid long, window long, bound double, least double, " + ", ".join(f"{c} long" for c in counts)
    names = schema.replace(" long", "").replace(" double", "").split(", ")
    blocks, found = spark.read.parquet(f"{path}/blocks"), spark.createDataFrame([], schema)
    for asked, _ in asked_blocks(spark.read.parquet(f"{path}/terms"), terms):
        least = thresholds(blocks, asked, k, probe)

        def count(batches: Iterator[pa.RecordBatch], asked=asked, least=least) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(counts), len(asked.qids)))
            for piece in pieces(batches, asked):
                (bound, held), n = piece.bounds(), piece.total("n")
                whole = held & piece.whole[:, None]
                live = whole & (bound >= least - SLACK)
                sums += [whole.sum(axis=0), (n * whole).sum(axis=0), live.sum(axis=0), (n * live).sum(axis=0)]
                row, question = np.nonzero(held & ~piece.whole[:, None])
                none = pa.nulls(len(row), pa.int64())
                parts = [asked.qids[question], piece.windows[row], bound[row, question], least[question], none, n[row, question].astype(np.int64), none, none]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names)
            none = [pa.nulls(len(asked.qids), t) for t in (pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(asked.qids), *none, *(pa.array(x.astype(np.int64)) for x in sums)], names)

        found = found.unionByName(blocks.select("term", "window", "of", "n", "highest").mapInArrow(count, schema))
    # The parts of a window that was cut are put together first; counts of whole windows have no window.
    each = found.groupBy("qid", "window").agg(F.sum("bound").alias("bound"), F.first("least").alias("least"), *(F.sum(c).alias(c) for c in counts))
    live = (F.col("bound") >= F.col("least") - SLACK).cast("long")
    own = {"windows": F.lit(1), "postings": F.col("postings"), "live_windows": live, "live_postings": live * F.col("postings")}
    each = each.select("qid", *(F.when(F.col("window").isNull(), F.col(c)).otherwise(own[c]).alias(c) for c in counts))
    return each.groupBy("qid").agg(*(F.sum(c).alias(c) for c in counts)).filter("windows > 0")
