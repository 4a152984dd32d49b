"""Producers: columns that come from models or parsers outside the engine.

A producer takes a DataFrame and returns it with further columns. The defaults here are deterministic and
need no model, so that every composition runs offline; a real one is any callable of the same shape, for
instance a pandas UDF that loads its model once per worker.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize


class Producer(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame: ...


def extractive_answer(df: DataFrame) -> DataFrame:
    """answer: the first source of the prompt, in place of a language model."""
    return df.withColumn("answer", F.regexp_extract("prompt", r"(?s)```\n(.*?)\n```", 1))


def longest_tokens(df: DataFrame) -> DataFrame:
    """reply: the two longest identifiers of the question as entities, in place of a language model."""
    words = F.array_distinct(tokenize(F.col("question")))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    names = F.transform(F.slice(ranked, 1, 2), lambda x: x["w"])
    return df.withColumn("reply", F.to_json(F.struct(names.alias("core_entities"))))


def overlap_judge(df: DataFrame) -> DataFrame:
    """faithfulness, context_precision, context_recall, answer_relevancy: shares of common tokens, in place of
    a judge; honesty of refusals by their wording. Rows without content have no relevancy."""
    tok = lambda c: F.array_distinct(tokenize(F.coalesce(F.col(c), F.lit(""))))
    share = lambda a, b: F.try_divide(F.size(F.array_intersect(a, b)), F.size(a))
    context = F.array_distinct(F.flatten(F.transform("contexts", tokenize)))
    empty = F.coalesce(F.col("abstention_type") == "no_content", F.lit(False))
    return df.withColumns({
        "faithfulness": share(tok("response"), context), "context_precision": share(context, tok("question")),
        "context_recall": share(tok("reference"), context), "answer_relevancy": F.when(~empty, share(tok("question"), tok("response"))),
        "abstention_honesty": F.when(empty, F.lower("response").rlike("not enough|no information|没有足够")),
    })


def html_text(df: DataFrame) -> DataFrame:
    """text: the page without tags, scripts and styles, in place of a document parser."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    return df.withColumn("text", F.trim(F.regexp_replace(bare, r"\s+", " ")))


FLAGGED_TASK = "Ask about this damaged passage; the right answer says what cannot be read."
PLAIN_TASK = "Ask a question that this passage answers."


def question_of(df: DataFrame) -> DataFrame:
    """qa_prompt: the request for a question and answer about a chunk; flagged chunks ask for an honest one."""
    flagged = F.coalesce(F.size("chunk_quality_flag"), F.lit(0)) > 0
    task = F.when(flagged, FLAGGED_TASK).otherwise(PLAIN_TASK)
    return df.withColumn("qa_prompt", F.concat_ws("\n\n", task, F.col("description"), F.col("text")))
