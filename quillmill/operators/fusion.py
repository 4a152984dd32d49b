"""Rank fusion, lookup, prompts and the question-to-prompt composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
ENTITY_WEIGHT = 1.5
FINAL_TOP_K = 5
#: Results up to this number are broadcast (three numbers each).
BROADCAST_RESULTS = 500_000

# The wording of the prompt.
PROMPT_HEAD = (
    "你是一个帮助学生查阅课程代码资料的助手。请只根据下面提供的代码片段回答问题,"
    "如果片段里没有足够信息回答,请明确说明。回答时请说明依据来自哪个来源(比如[来源1])。\n\n### 检索到的代码片段:\n"
)
PROMPT_QUESTION = "\n\n### 问题:\n"


def fuse(arms: list[tuple[DataFrame, float]], k: int | None = FINAL_TOP_K, constant: int = RRF_K) -> DataFrame:
    """(qid, id, score, rank) of ranked lists (qid, id, rank) with weights: the sum of weight / (constant +
    rank). Equal scores keep the order of the lists and then of the ranks."""
    every = None
    for number, (arm, weight) in enumerate(arms):
        part = arm.select(
            "qid", "id", (F.lit(float(weight)) / (constant + F.col("rank"))).alias("part"),
            (F.lit(number * 1_000_000) + F.col("rank")).cast("long").alias("place"),
        )
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("qid", "id").agg(F.sum("part").alias("score"), F.min("place").alias("place"))
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "place")
    ranked = fused.withColumn("rank", F.row_number().over(best)).drop("place")
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def source_line(file: Column, chunk_type: Column, name: Column) -> Column:
    known = F.when(F.coalesce(name, F.lit("")) != "", name)
    return F.concat_ws(" | ", F.coalesce(file, F.lit("?")), F.coalesce(chunk_type, F.lit("?")), known)


def few(found: DataFrame) -> DataFrame:
    """Results to be broadcast, if they are few enough: then the texts that they are looked up in need not travel."""
    return F.broadcast(found) if found.limit(BROADCAST_RESULTS + 1).count() <= BROADCAST_RESULTS else found


def prompts(fused: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, prompt) from fused (qid, id, rank), chunks (id, text, file, chunk_type, name) and questions
    (qid, question): the sources in order of rank, then the question."""
    found = few(fused.select("qid", "id", "rank")).join(chunks.select("id", "text", "file", "chunk_type", "name"), "id")
    head = F.concat(F.lit("[来源"), F.col("rank").cast("string"), F.lit("] "), source_line(F.col("file"), F.col("chunk_type"), F.col("name")))
    block = F.concat(head, F.lit("\n```\n"), F.coalesce("text", F.lit("")), F.lit("\n```"))
    blocks = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    joined = questions.select("qid", "question").join(blocks, "qid", "left")
    context = F.coalesce(F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit(""))
    return joined.select("qid", F.concat(F.lit(PROMPT_HEAD), context, F.lit(PROMPT_QUESTION), F.col("question"), F.lit("\n")).alias("prompt"))


def target_hits(ranked: DataFrame, targets: DataFrame, k: int = FINAL_TOP_K) -> DataFrame:
    """(qid, target, hit, rank): whether and where the target (qid, target) is in the ranked list."""
    found = ranked.select("qid", F.col("id").alias("target"), "rank")
    return targets.join(found, ["qid", "target"], "left").select(
        "qid", "target", (F.coalesce("rank", F.lit(k + 1)) <= k).alias("hit"), "rank"
    )


def hybrid(
    dense: DataFrame, sparse: DataFrame, entities: DataFrame | None = None, rewrite: bool = False, k: int = FINAL_TOP_K
) -> DataFrame:
    """Both arms fused; with ``rewrite`` the entity arm as a third with its own weight."""
    arms = [(dense, 1.0), (sparse, 1.0)]
    if rewrite and entities is not None:
        arms.append((entities, ENTITY_WEIGHT))
    return fuse(arms, k)


def parsed_entities(answers: DataFrame, limit: int = 2) -> DataFrame:
    """(qid, core_entities, error) from model replies (qid, reply): JSON with core_entities; at most two,
    trimmed, blanks dropped. Anything else gives no entities and an error, never a failure."""
    parsed = F.from_json("reply", "struct<core_entities:array<string>>")
    names = F.filter(F.transform(parsed["core_entities"], lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return answers.select(
        "qid",
        F.coalesce(F.slice(names, 1, limit), F.array().cast("array<string>")).alias("core_entities"),
        F.when(parsed["core_entities"].isNull(), "no entities in the reply").alias("error"),
    )
