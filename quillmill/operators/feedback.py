"""Query rewriting from the corpus: a relevance model of the first results, mixed with the question's own words (RM3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import BROADCAST_TERMS, Index

#: Terms that the relevance model adds, and the share of the question's own words.
ADDED, OWN_SHARE = 20, 0.5


def relevance_model(index: Index, found: DataFrame, added: int = ADDED) -> DataFrame:
    """(qid, term, p): the terms that tell the found documents (qid, id, score) from the rest, p adding up to 1 for each
    question. A document counts by its share of the question's scores, a term by its share of the document times its
    weight in the corpus; words that stand everywhere would fill the model otherwise. Only scores and weights above 0
    count; terms of equal p (to twelve places) go in order. ``found`` has a bounded number of rows a question."""
    good = found.filter("score > 0").select("qid", "id", "score")
    share = good.withColumn("share_", F.col("score") / F.sum("score").over(Window.partitionBy("qid"))).drop("score")
    if good.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        share = F.broadcast(share)
    of_each = F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))
    held = index.documents.join(share, "id").select("qid", "share_", "dl", of_each)
    seen = held.groupBy("qid", "term").agg(F.sum(F.col("share_") * F.col("tf") / F.col("dl")).alias("seen_"))
    model = seen.join(index.terms.filter("idf > 0").select("term", "idf"), "term").select("qid", "term", (F.col("seen_") * F.col("idf")).alias("p"))
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("p", 12)), "term")
    kept = model.withColumn("place_", F.row_number().over(best)).filter(F.col("place_") <= added).drop("place_")
    return kept.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("qid")))


def rewritten(terms: DataFrame, model: DataFrame, own_share: float = OWN_SHARE) -> DataFrame:
    """(qid, term, qtf): the question's terms (qid, term, qtf) at their share of its length, mixed with the model (qid,
    term, p). A question without a model keeps its terms, at own_share of their weight, which changes no order."""
    own = terms.select("qid", "term", (own_share * F.col("qtf") / F.sum("qtf").over(Window.partitionBy("qid"))).alias("part_"))
    more = model.select("qid", "term", ((1 - own_share) * F.col("p")).alias("part_"))
    return own.unionByName(more).groupBy("qid", "term").agg(F.sum("part_").alias("qtf"))
