"""The driver's tables seen as samples, knowledge base, evaluation items, judged answers and vectors.

Each view has a Spark form and, where queries are checked by SQL, the same as a DuckDB expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill import packs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category_of(column):
    return F.element_at(F.lit(list(packs.CATEGORIES)), (F.pmod(column, F.lit(len(packs.CATEGORIES))) + 1).cast("int"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return turns.select(
        F.concat(F.lit("conv_"), "conv_id").alias("id"), "conv_id", category_of(F.col("conv_id")).alias("category"), F.floor(F.col("conv_id") / 10).cast("string").alias("seed_id"), F.lit("conversations").alias("source"), messages.alias("messages")
    )


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn after it, under one system message."""
    turns = table(spark, sf_dir, "conversations")
    after = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumns({"next_role": F.lead("role").over(after), "next_text": F.lead("text").over(after)}).where("role = 'user' and next_role = 'assistant'")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return pairs.select(
        F.concat_ws("_", F.lit("pair"), "conv_id", "turn").alias("id"), "conv_id", "turn", category_of(F.col("conv_id")).alias("category"), F.floor(F.col("conv_id") / 10).cast("string").alias("seed_id"),
        F.col("text").alias("user"), F.col("next_text").alias("answer"), F.array(message("system", F.lit("s")), message("user", F.col("text")), message("assistant", F.col("next_text"))).alias("messages"),
    )


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a knowledge base: the source is the category, the language the type."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("doc_"), "doc_id").alias("chunk_id"), F.col("lang").alias("doc_type"), F.col("source").alias("category"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries: every row whose id is divisible by 20; documents: all rows)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("category"))
    return rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), rows


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as answers to judge: the source is the category, the language the model."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("lang").alias("model"), F.col("text").alias("answer"), (F.col("toxic") == 1).alias("need_human"),
        F.when(F.col("doc_id") % 5 > 0, F.array(F.lit("the "), F.lit("Idiot"), F.col("lang"), F.lit(""))).alias("must_include"),
        F.when(F.col("doc_id") % 7 > 0, F.array(F.lit("password"), F.lit(" ! ! "), F.lit(""))).alias("must_not_include"),
    )


# ---- the same in DuckDB's SQL
_CATS = "[" + ", ".join(f"'{c}'" for c in packs.CATEGORIES) + "]"
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"

DIALOGUES = f"""SELECT 'conv_' || conv_id AS id, conv_id, {_CATS}[conv_id % 8 + 1] AS category, CAST(conv_id // 10 AS VARCHAR) AS seed_id, 'conversations' AS source,
  list({{'role': role, 'content': text}} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id"""
PAIRS = f"""SELECT 'pair_' || conv_id || '_' || turn AS id, conv_id, turn, {_CATS}[conv_id % 8 + 1] AS category, CAST(conv_id // 10 AS VARCHAR) AS seed_id, text AS "user", next_text AS answer
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"""
KB = """SELECT 'doc_' || doc_id AS chunk_id, lang AS doc_type, source AS category, split_part(text, chr(10), 1) AS title, text AS content, doc_id FROM documents"""
ANSWERS = """SELECT doc_id AS id, source AS category, lang AS model, text AS answer, toxic = 1 AS need_human,
  CASE WHEN doc_id % 5 > 0 THEN ['the ', 'Idiot', lang, ''] END AS must_include, CASE WHEN doc_id % 7 > 0 THEN ['password', ' ! ! ', ''] END AS must_not_include
  FROM documents JOIN labels USING (doc_id)"""


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_normal(e: str, form: str = "full") -> str:
    bare = f"lower(regexp_replace(coalesce({e}, ''), '{SPACE}+', '', 'g'))"
    fold = {"full": ("？！。，、：；", "?!.,,:;"), "short": ("？！。，、", "?!.,,"), "plain": None}[form]
    return f"translate({bare}, '{fold[0]}', '{fold[1]}')" if fold else bare


def sql_role(messages: str, role: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_filter({messages}, lambda m: m.role = '{role}' AND {sql_strip('m.content')} <> ''), lambda m: {sql_strip('m.content')}), chr(10)), '')"


def sql_hits(e: str, patterns, ignore_case: bool = True) -> str:
    """RE2 has no look-around: the guards of a digit run become characters."""
    any_of = "|".join(f"(?:{re.sub(r'[(][?]<![^)]*[)]', '(?:^|[^0-9])', p).replace('(?!' + chr(92) + 'd)', '(?:$|[^0-9])')})" for p in patterns).replace("'", "''")
    return f"regexp_matches(coalesce({e}, ''), '{any_of}', '{'i' if ignore_case else 'c'}')"


def sql_holds(e: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(coalesce({e}, ''), '{p}')" for p in phrases) + ")"


def sql_first_hit(e: str, kinds, prefix: str = "", ignore_case: bool = True) -> str:
    return "CASE " + " ".join(f"WHEN {sql_hits(e, p, ignore_case)} THEN '{prefix}{name}'" for name, p in kinds) + " END"


def sql_all_hits(e: str, kinds, ignore_case: bool = True) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_hits(e, p, ignore_case)} THEN '{name}' END" for name, p in kinds) + "], lambda x: x IS NOT NULL)"
