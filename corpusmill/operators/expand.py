"""Rewritten questions: what a variant may be, which are taken, and the samples they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import packs
from corpusmill.functions.rules import OK, Rule, coded, first_failure
from corpusmill.functions.text import hits, holds_any, last_of_role, normal, strip
from corpusmill.operators.dedup import near_pairs
from corpusmill.store import dropped, written


def question_intent(text: Column) -> Column:
    return holds_any(text, packs.QUESTION_MARKERS)


def looks_like_answer(text: Column) -> Column:
    """A strong marker tells before a question does; without a question one weak marker is enough."""
    return F.when(holds_any(text, packs.VARIANT_STRONG), True).when(question_intent(text), False).otherwise(holds_any(text, packs.VARIANT_WEAK))


def introduced(new: Column, old: Column, patterns) -> Column:
    return hits(new, patterns) & ~hits(old, patterns)


def variant_rules(variant: Column, original: Column, chars=(4, 120)) -> list[Rule]:
    text = strip(variant)
    return [
        Rule("too_short", F.length(text) < chars[0]),
        Rule("too_long", F.length(text) > chars[1]),
        Rule("same_as_original", normal(text, "short") == normal(original, "short")),
        Rule("looks_like_answer", looks_like_answer(text)),
        coded(F.coalesce(*[F.when(introduced(text, original, p), F.lit(name)) for name, p in packs.NEW_INFORMATION])),
        Rule("new_risky_policy_or_commitment", introduced(text, original, packs.NEW_POLICY)),
    ]


def accepted(variants: DataFrame, taken: DataFrame, quota: int = 15, least: float = 0.88) -> DataFrame:
    """``variants`` (seed_id, original, variant, ord) that one after the other would be taken: sound, equal to no
    text that exists or was taken, alike to none taken for the same seed, and up to ``quota`` a seed; ``taken``
    (text) are texts that exist.

    A variant that is not taken blocks none.  So it is settled in rounds: a variant goes if an earlier one that blocks it
    was taken or its seed is full, and is taken if all earlier ones that could block it went and the
    seed has room for all that are still open before it."""
    text = normal(strip(F.col("variant")), "short")
    sound = variants.where(first_failure(variant_rules(F.col("variant"), F.col("original"))) == OK).withColumn("_text", text)
    sound = sound.join(taken.select(normal(F.col("text"), "short").alias("_text")).distinct(), "_text", "left_anti").withColumn("_seed", F.coalesce(F.col("seed_id").cast("string"), F.lit("")))
    # once the first of a seed's equal variants is settled, so are the others: they go
    nodes = written(sound.groupBy(F.col("_seed").alias("seed"), F.col("_text").alias("text")).agg(F.min("ord").alias("node")).select("node", "seed", "text"), "variants")
    # texts that are not equal have a ratio below 1
    pairs = near_pairs(nodes.select(F.col("seed").alias("block"), "node", "text"), least) if least < 1 else nodes.select(F.col("node").alias("late"), F.col("node").alias("early")).limit(0)
    near = written(pairs, "variants-near")
    state = nodes.withColumn("taken", F.lit(None).cast("boolean"))
    while not state.where("taken is null").isEmpty():
        earlier = near.join(state.select(F.col("node").alias("early"), F.col("taken").alias("t")), "early").groupBy("late").agg(F.max("t").alias("near_taken"), F.max(F.col("t").isNull()).alias("near_open"))
        equal = state.groupBy("text").agg(F.max("taken").alias("text_taken"), F.min(F.when(F.col("taken").isNull(), F.col("node"))).alias("text_first"))
        before = Window.partitionBy("seed").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # what was asked for one seed
        told = state.withColumns({"full": F.coalesce(F.count_if(F.col("taken")).over(before), F.lit(0)), "open": F.coalesce(F.count_if(F.col("taken").isNull()).over(before), F.lit(0))})
        told = told.join(equal, "text").join(earlier, F.col("node") == F.col("late"), "left")
        blocked = F.coalesce(F.col("text_taken"), F.lit(False)) | F.coalesce(F.col("near_taken"), F.lit(False)) | (F.col("full") >= quota)
        free = (F.col("node") == F.col("text_first")) & ~F.coalesce(F.col("near_open"), F.lit(False)) & (F.col("full") + F.col("open") < quota)
        now = F.when(F.col("taken").isNotNull(), F.col("taken")).when(blocked, False).when(free, True)
        state, last = written(told.select("node", "seed", "text", now.alias("taken")), "variants"), state
        dropped(last)
    kept = state.where("taken").select(F.col("node").alias("_node"))
    return sound.join(kept, F.col("ord") == F.col("_node"), "left_semi").drop("_text", "_seed")


def rewritten(messages: Column, user: Column) -> Column:
    """The messages with every user text replaced."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", user).otherwise(m["content"]).alias("content")))


def seed_texts(df: DataFrame) -> DataFrame:
    """``df`` with user and answer, the last of each role; rows without either go."""
    return df.withColumns({"user": strip(last_of_role(F.col("messages"), "user")), "answer": strip(last_of_role(F.col("messages"), "assistant"))}).where("user is not null and answer is not null")


def resume_state(existing: DataFrame, prefix: str = "sft_llm") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted by seed, known texts, largest number used) of what an earlier run has written."""
    by_seed = existing.where("seed_id is not null").groupBy("seed_id").agg(F.count("*").alias("n"))
    texts = existing.select(normal(last_of_role(F.col("messages"), "user"), "short").alias("text")).where("text <> ''").distinct()
    number = F.max(F.try_to_number(F.nullif(F.regexp_extract("id", f"^{prefix}_([0-9]+)$", 1), F.lit("")), F.lit("999999999999")).cast("long"))
    return by_seed, texts, existing.agg(F.coalesce(number, F.lit(0)).alias("last"))
