"""Dataset audits: issues in long form, their roll-up, thresholds and the verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import packs
from corpusmill.functions.rules import Rule, all_failures


def issues(df: DataFrame, dataset: str, key: Column, rules: Sequence[Rule], severity: str = "error") -> DataFrame:
    """(severity, dataset, issue_type, id): one row per broken rule of each row."""
    return df.select(F.lit(severity).alias("severity"), F.lit(dataset).alias("dataset"), F.explode(all_failures(rules)).alias("issue_type"), key.cast("string").alias("id"))


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """(key, n): full keys that more than one row has."""
    return df.select(key.alias("key")).where("key is not null and key <> ''").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_issues(df: DataFrame, dataset: str, key: Column, issue_type: str, severity: str = "error", with_id: bool = True) -> DataFrame:
    named = F.col("key") if with_id else F.lit(None).cast("string")
    return duplicates(df, key).select(F.lit(severity).alias("severity"), F.lit(dataset).alias("dataset"), F.lit(issue_type).alias("issue_type"), named.alias("id"))


def leaked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full values of ``key`` on both sides."""
    full = lambda df: df.select(F.col(key).cast("string").alias(key)).where(f"{key} is not null and {key} <> ''").distinct()
    return full(left).join(full(right), key, "left_semi")


def missing_docs(items: DataFrame, known: DataFrame) -> DataFrame:
    """(item, missing): expected documents (item, expected_docs) that ``known`` (doc_id) hasn't, sorted."""
    each = items.select("item", F.explode("expected_docs").alias("doc_id"))
    return each.join(known.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("item").agg(F.sort_array(F.collect_set("doc_id")).alias("missing"))


def rolled_up(found: DataFrame) -> DataFrame:
    """(section, key, n): issues in all, by severity, by dataset and by type."""
    sets = found.groupingSets([[], ["severity"], ["dataset"], ["issue_type"]], "severity", "dataset", "issue_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "severity").when(F.col("g") == 5, "dataset").otherwise("issue_type")
    return sets.select(section.alias("section"), F.coalesce("severity", "dataset", "issue_type", F.lit("all")).alias("key"), "n")


def thresholds(counts: DataFrame, minimums: dict[str, int] = packs.MINIMUMS) -> DataFrame:
    """``counts`` (name, actual) against their minimums; names that are not counted have 0."""
    least = F.explode(F.map_from_arrays(F.array(*map(F.lit, minimums)), F.array(*map(F.lit, minimums.values())))).alias("name", "least")
    want = counts.sparkSession.range(1).select(least)
    return want.join(counts, "name", "left").select("name", F.coalesce("actual", F.lit(0)).cast("long").alias("actual"), F.col("least").cast("long").alias("least"), (F.coalesce("actual", F.lit(0)) >= F.col("least")).alias("passed"))


def verdict(found: DataFrame, strict: bool = False) -> DataFrame:
    """(n_errors, n_warnings, verdict)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = found.agg(n("error").alias("n_errors"), n("warning").alias("n_warnings"))
    good = (F.col("n_errors") == 0) & ((F.col("n_warnings") == 0) | F.lit(not strict))
    return counts.withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))


def counted(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows by value; nulls are ``unknown``."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)).agg(F.count("*").alias(name))


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, text: Column, *by: str) -> DataFrame:
    n = F.length(text)
    return df.groupBy(*by).agg(F.count(text).alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 2).alias("average"))
