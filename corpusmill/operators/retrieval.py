"""Exact inner-product retrieval, hits at k, and what went wrong.

Queries are a stated set and go over the documents in blocks: each task multiplies its documents by the block
and hands on its k best a query, so documents are never shuffled and what meets is k rows a task and query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import blank, first_full

BLOCK = 512


def _best(queries: list[tuple], k: int, same_category: bool):
    ids = [q[0] for q in queries]
    vectors = np.array([q[1] for q in queries], np.float64)
    wanted = np.array([q[2] or "" for q in queries], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            docs = batch.column("doc_id").to_numpy()
            column = batch.column("vector")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            scores = vectors @ flat.T
            categories = batch.column("category").to_pandas().to_numpy(object) if same_category else None
            out_q, out_d, out_s = [], [], []
            for i, q in enumerate(ids):
                own, known = scores[i], docs
                at = np.arange(len(docs))
                if same_category:
                    at = np.flatnonzero(categories == wanted[i])
                    own, known = own[at], docs[at]
                if len(own) > k:
                    least = np.partition(own, len(own) - k)[len(own) - k]
                    close = np.flatnonzero(own >= least)
                    own, known = own[close], known[close]
                order = np.lexsort((known, -own))[:k]
                out_q += [q] * len(order)
                out_d.append(known[order])
                out_s.append(own[order])
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_d), pa.int64()), pa.array(np.concatenate(out_s), pa.float64())], names=["query_id", "doc_id", "score"])

    return run


def top_k(queries: DataFrame, docs: DataFrame, k: int = 5, least: float | None = None, category: str = "off") -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query, equal scores by id.

    ``queries`` has query_id, vector and category, ``docs`` doc_id, vector and category.  category "exact"
    looks only at documents of the query's category; "compat" filters the 5k best, so it can miss some.
    Scores below ``least`` are left out.
    """
    wide = 5 * k if category == "compat" else k
    found, block = None, []

    def over() -> DataFrame:
        return docs.select("doc_id", "vector", "category").mapInArrow(_best(list(block), wide, category == "exact"), "query_id long, doc_id long, score double")

    for q in queries.select("query_id", "vector", "category").toLocalIterator():
        block.append((q["query_id"], list(q["vector"]), q["category"]))
        if len(block) == BLOCK:
            found, block = over() if found is None else found.unionByName(over()), []
    if block:
        found = over() if found is None else found.unionByName(over())
    if found is None:
        return docs.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wide)
    if category == "compat":
        same = ranked.join(docs.select("doc_id", F.col("category").alias("_c")), "doc_id").join(F.broadcast(queries.select("query_id", "category")), "query_id").where(F.col("category") == F.col("_c"))  # a stated set
        ranked = same.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if least is not None:
        ranked = ranked.where(F.col("score") >= least).withColumn("rank", F.row_number().over(best))
    return ranked.select("query_id", "rank", "doc_id", "score")


def asked(df: DataFrame, only_needing: bool = True) -> DataFrame:
    """The evaluation rows that are put to retrieval, with their question in ``query`` (else ``user_query``): those
    that need it (unless all are wanted) and whose question is not blank."""
    query = first_full(*[F.col(c) for c in ("query", "user_query") if c in df.columns])
    rows = df.where(F.coalesce(F.col("need_rag"), F.lit(False))) if only_needing else df
    return rows.withColumn("query", query).where(~blank(F.col("query")))


def expected_set(docs: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(docs, F.array().cast("array<string>")), lambda x: F.trim(x) != ""))


def hit_at(expected: Column, hits: Column, k: int) -> Column:
    """Whether a document or chunk id of the first k hits is expected; nothing expected is no hit."""
    first = F.slice(hits, 1, k)
    names = F.concat(F.transform(first, lambda h: h["doc_id"].cast("string")), F.transform(first, lambda h: h["chunk_id"].cast("string")))
    return F.coalesce(F.arrays_overlap(expected, F.array_compact(names)), F.lit(False))


def badcase(expected: Column, hits: Column, category: Column) -> Column:
    top = F.get(hits, F.lit(0))
    other = (F.coalesce(top["category"], F.lit("")) != "") & (F.coalesce(category, F.lit("")) != "") & (top["category"] != category)
    return (
        F.when(F.size(expected) == 0, "missing_label")
        .when(F.coalesce(F.size(hits), F.lit(0)) == 0, "rag_no_result")
        .when(~hit_at(expected, hits, 1_000_000), "rag_wrong_doc")
        .when(other, "rag_category_mismatch")
    )


def evaluated(df: DataFrame, top: int = 5) -> DataFrame:
    """Rows (expected_docs, hits best first, category) with hits at 1, 3 and 5, top score and badcase."""
    expected = expected_set(F.col("expected_docs"))
    return df.withColumns({
        "hit_1": hit_at(expected, F.col("hits"), 1), "hit_3": hit_at(expected, F.col("hits"), min(3, top)), "hit_5": hit_at(expected, F.col("hits"), min(5, top)),
        "top1_score": F.get("hits", F.lit(0))["score"], "badcase_type": badcase(expected, F.col("hits"), F.col("category")),
    })


def summarized(df: DataFrame) -> DataFrame:
    """Recall over all (null category) and by category; means of nothing are 0."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0))
    return df.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown"))).rollup("category").agg(
        F.count("*").alias("n"), share("hit_1").alias("recall_1"), share("hit_3").alias("recall_3"), share("hit_5").alias("recall_5"),
        F.coalesce(F.avg("top1_score"), F.lit(0.0)).alias("avg_top1"), F.count("badcase_type").alias("n_badcases"),
    )


def context(hits: Column) -> Column:
    """Retrieved documents as numbered text for a prompt."""
    line = lambda h, i: F.format_string("[%d] doc_id=%s score=%.4f\n%s\n%s", i + 1, h["doc_id"], h["score"], h["title"], h["content"])
    return F.when(F.coalesce(F.size(hits), F.lit(0)) == 0, F.lit("（无）")).otherwise(F.array_join(F.transform(hits, line), "\n\n"))


def preview(hits: Column, width: int = 120) -> Column:
    """(rank, doc_id, category, score, text) of each hit, the text on one line and cut."""
    return F.transform(hits, lambda h, i: F.struct((i + 1).alias("rank"), h["doc_id"].alias("doc_id"), h["category"].alias("category"), h["score"].alias("score"), F.substring(F.regexp_replace(h["content"], "\n", " "), 1, width).alias("text")))


def rag_messages(query: Column, hits: Column, system: str) -> Column:
    """System and user message; the user's holds the hits numbered with type, category, title and content (ids
    stay out of what a model sees) and the question."""
    line = lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), F.concat_ws(" | ", h["doc_type"], h["category"], h["title"]), F.lit("\n"), h["content"])
    told = F.when(F.coalesce(F.size(hits), F.lit(0)) == 0, F.lit("-")).otherwise(F.array_join(F.transform(hits, line), "\n\n"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.concat(told, F.lit("\n\n"), query).alias("content")))


def resolved(top_k: int | None, least: float | None, category: str | None, config: dict) -> dict:
    """A call's options: 0 or no top_k is the configured one, only no threshold is, and a category counts only
    where the configuration filters by it."""
    return {"k": top_k or config.get("top_k", 5), "least": config.get("score_threshold", 0.0) if least is None else least, "category": "compat" if category and config.get("use_category_filter") else "off"}
