"""Knowledge-base rendering and its canonical form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import blank, filled, first_full, strip
from corpusmill.operators.split import places, sampled

CHUNK = ("chunk_id", "doc_type", "category", "title", "content", "source")


def _lines(values: Column, render) -> Column:
    return filled(F.array_join(F.transform(values, render), "\n"))


def faq_chunks(df: DataFrame) -> DataFrame:
    content = F.concat(F.lit("问题："), "question", F.lit("\n答案："), "answer")
    return df.select(F.col("id").alias("chunk_id"), F.lit("faq").alias("doc_type"), "category", F.col("question").alias("title"), content.alias("content"), F.coalesce("source", F.lit("manual_faq")).alias("source"))


def sop_chunks(df: DataFrame) -> DataFrame:
    steps = _lines(F.col("steps"), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    risks = _lines(F.coalesce("risk_points", F.array().cast("array<string>")), lambda r: F.concat(F.lit("- "), r))
    content = F.concat(F.lit("场景："), "title", F.lit("\n处理步骤：\n"), steps, F.lit("\n风险点：\n"), risks)
    return df.select(F.col("id").alias("chunk_id"), F.lit("sop").alias("doc_type"), "category", "title", content.alias("content"), F.coalesce("source", F.lit("manual_sop")).alias("source"))


def product_chunks(df: DataFrame) -> DataFrame:
    attributes = _lines(F.map_entries("attributes"), lambda e: F.concat(F.lit("- "), e["key"], F.lit("："), e["value"]))
    content = F.concat(F.lit("商品名称："), "title", F.lit("\n商品类目："), "category", F.lit("\n商品属性：\n"), attributes, F.lit("\n退换货规则："), "return_policy")
    return df.select(F.col("product_id").alias("chunk_id"), F.lit("product").alias("doc_type"), F.lit("product_info").alias("category"), "title", content.alias("content"), F.lit("manual_product").alias("source"))


def canonical(df: DataFrame, order: str) -> DataFrame:
    """Knowledge-base documents from rows with any of doc_id, id, chunk_id, doc_type, type, title, content, text,
    category, source: first full value wins, ``doc_000000`` by place where there is no id, the row as JSON
    beside.  Rows without title and content go; places count them."""
    have = lambda *names: first_full(*[F.col(n).cast("string") for n in names if n in df.columns], F.lit(None).cast("string"))
    raw = F.to_json(F.struct(*[c for c in df.columns if c != order]))
    placed = places(df, [F.col(order)], "_row")
    doc_id = F.coalesce(have("doc_id", "id"), F.format_string("doc_%06d", "_row"))
    out = placed.select(
        doc_id.alias("doc_id"), F.coalesce(have("chunk_id"), doc_id).alias("chunk_id"), F.coalesce(have("doc_type", "type"), F.lit("")).alias("doc_type"), F.coalesce(have("category"), F.lit("")).alias("category"),
        F.coalesce(have("title"), F.lit("")).alias("title"), F.coalesce(have("content", "text"), F.lit("")).alias("content"), F.coalesce(have("source"), F.lit("")).alias("source"), raw.alias("raw"),
    )
    return out.where(~(blank(F.col("title")) & blank(F.col("content"))))


def not_empty(df: DataFrame, what: str = "no valid documents") -> DataFrame:
    """``df``, or an error where nothing is left of it."""
    if df.isEmpty():
        raise ValueError(what)
    return df


def overlaid(raw: DataFrame, known: Sequence[str] = ("doc_id", "chunk_id", "doc_type", "category", "title", "content", "source")) -> DataFrame:
    """Canonical documents (with ``raw``, the row as JSON) as one JSON object each: the raw row's fields, and over
    them the canonical ones."""
    fields = F.from_json("raw", "map<string,string>")
    own = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*[F.col(c).cast("string") for c in known]))
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*known))
    return raw.select("doc_id", F.to_json(F.map_concat(F.coalesce(rest, F.create_map().cast("map<string,string>")), own)).alias("json"))


def embedding_text(title: Column, doc_type: Column, category: Column, content: Column, labels=("标题", "类型", "类别", "内容")) -> Column:
    """Labelled lines of what is there."""
    parts = [F.when(filled(c) != "", F.concat(F.lit(f"{name}："), c)) for name, c in zip(labels, (title, doc_type, category, content), strict=True)]
    return F.concat_ws("\n", *parts)


def prompt_summary(df: DataFrame, key: Column, order: str, n: int = 12, width: int = 180) -> DataFrame:
    """The first n documents as one line each (a list for a prompt)."""
    flat = F.regexp_replace(filled(F.col("content")), "\n", " ")
    cut = F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("..."))).otherwise(flat)
    line = F.concat(F.lit("- doc_id="), F.coalesce(F.nullif(key, F.lit("")), F.lit("unknown_doc")), F.lit("; doc_type="), F.coalesce("doc_type", F.lit("unknown")), F.lit("; category="), F.coalesce("category", F.lit("unknown")), F.lit("; title="), filled(F.col("title")), F.lit("; content="), cut)
    return df.orderBy(order).limit(n).select(F.col(order), line.alias("line"))


def doc_reference(text: Column) -> Column:
    """A document id as a model writes it: without ``doc_id=``, what follows a semicolon, marks and dashes."""
    out = strip(filled(text))
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)^doc_id\s*=\s*", ""), r"(?U)^doc_id\s*[:：]\s*", "")
    out = strip(F.split_part(out, F.lit(";"), F.lit(1)))
    return strip(F.regexp_replace(F.regexp_replace(out, "^`+|`+$", ""), "^-+|-+$", ""))


def picked(df: DataFrame, categories: list[str], n: int, key: str = "chunk_id", seed: int = 42) -> DataFrame:
    """Up to n documents for each of ``categories`` in shuffled order, each document once, those without a key
    left out.  A category takes its own documents (product_info also products); without any it takes from all."""
    known = df.where(~blank(F.col(key)))
    wanted = F.array(*[F.lit(c) for c in sorted(set(categories))])
    fits = F.filter(wanted, lambda c: (F.col("category") == c) | ((c == "product_info") & (F.col("doc_type") == "product")))
    own = sampled(known.withColumn("_for", F.explode(fits)), ["_for"], key, n, seed)
    served = own.select("_for").distinct()
    lone = known.sparkSession.range(1).select(F.explode(wanted).alias("_for")).join(served, "_for", "left_anti")
    spare = known.withColumn("_all", F.lit(1))
    spare = sampled(spare, ["_all"], key, n, seed).drop("_all") if lone.limit(1).count() else known.limit(0)
    return own.drop("_for").unionByName(spare).dropDuplicates([key])
