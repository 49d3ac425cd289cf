"""Judging generated answers, and summaries by category and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import packs
from corpusmill.functions.text import blank, filled, holds_any, normal
from corpusmill.operators.risk import answer_risk


def _plain(text: Column) -> Column:
    return normal(text, "plain")


def _list(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def phrase_hit(answer: Column, phrase: Column, soft=packs.SOFT_PHRASES) -> Column:
    """The phrase stands in the answer, or all parts of a phrase that has a loose form do."""
    plain = _plain(answer)
    out = F.contains(plain, _plain(phrase))
    for name, parts in soft.items():
        every = F.lit(True)
        for p in parts:
            every = every & plain.contains(p)
        out = out | ((phrase == name) & every)
    return out


def included(answer: Column, phrases: Column) -> Column:
    """(total, hit, rate, missing); the rate of no phrases is null."""
    asked = _list(phrases)
    missing = F.filter(asked, lambda p: ~phrase_hit(answer, p))
    total = F.size(asked)
    return F.struct(total.alias("total"), (total - F.size(missing)).alias("hit"), ((total - F.size(missing)) / F.nullif(total, F.lit(0))).alias("rate"), missing.alias("missing"))


def violated(answer: Column, phrases: Column) -> Column:
    """(total, violated, rate, violations); the rate of no phrases is 0.0; empty phrases are never violated."""
    asked = _list(phrases)
    plain = _plain(answer)
    found = F.filter(asked, lambda p: (p != "") & F.contains(plain, _plain(p)))
    total = F.size(asked)
    return F.struct(total.alias("total"), F.size(found).alias("violated"), F.coalesce(F.size(found) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("rate"), found.alias("violations"))


def transfer_type(answer: Column) -> Column:
    plain = _plain(answer)
    return F.when(~holds_any(plain, packs.HUMAN_WORDS), "none").when(holds_any(plain, packs.CONDITION_WORDS), "conditional").otherwise("direct")


def asks_for_human(answer: Column) -> Column:
    return holds_any(_plain(answer), packs.NEEDS_HUMAN_WORDS)


def judged(df: DataFrame, answer: str = "answer") -> DataFrame:
    """``df`` (an evaluation item with its answer a row) with the measures of its answer."""
    a, kind = F.col(answer), transfer_type(F.col(answer))
    inc, vio, risk = included(a, F.col("must_include")), violated(a, F.col("must_not_include")), answer_risk(a)
    expected = F.coalesce("need_human", F.lit(False))
    predicted = (kind == "direct") | ((kind == "conditional") & F.coalesce(F.col("category").isin(*packs.CONDITIONAL_COUNTS), F.lit(False)))
    return df.withColumns({
        "must_include_hit_rate": inc["rate"], "must_include_missing": inc["missing"],
        "must_not_include_violation_rate": vio["rate"], "must_not_include_violations": vio["violations"],
        "expected_need_human": expected, "predicted_need_human": predicted, "predicted_human_transfer_type": kind,
        "need_human_correct": expected == predicted, "answer_length": F.length(filled(a)), "empty_answer": blank(a),
        "post_risk_flags": risk["risk_flags"], "post_has_risk": risk["has_risk"],
    })


def badcases(df: DataFrame) -> DataFrame:
    """Judged rows with at least one reason against them, in column badcase_reasons."""
    reasons = F.array_compact(F.array(
        F.when(F.col("empty_answer"), "empty_answer"), F.when(F.size("must_include_missing") > 0, "missing_must_include"),
        F.when(F.size("must_not_include_violations") > 0, "must_not_include_violation"), F.when(~F.coalesce("need_human_correct", F.lit(True)), "need_human_wrong"), F.when(F.col("post_has_risk"), "post_risk"),
    ))
    return df.withColumn("badcase_reasons", reasons).where(F.size("badcase_reasons") > 0)


def _share(flag: str) -> Column:
    return F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("int"))


MEASURES = ("n", "must_include_avg_hit_rate", "non_violation_rate", "need_human_accuracy", "empty_answer_rate", "post_risk_rate")


def summarized(df: DataFrame, *by: str) -> DataFrame:
    """Means of judged rows over all (null in ``by``) and by each value."""
    keyed = df.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in by})
    grouped = keyed.rollup(*by) if by else keyed.groupBy()
    return grouped.agg(
        F.count("*").alias("n"), F.avg("must_include_hit_rate").alias("must_include_avg_hit_rate"), (1 - F.avg(F.coalesce("must_not_include_violation_rate", F.lit(0.0)))).alias("non_violation_rate"),
        _share("need_human_correct").alias("need_human_accuracy"), _share("empty_answer").alias("empty_answer_rate"), _share("post_has_risk").alias("post_risk_rate"),
    )


def compared(df: DataFrame, models: list[str]) -> DataFrame:
    """Category by model, every pair a row: pairs without rows have n = 0 and no means."""
    done = df.groupBy(F.coalesce("category", F.lit("unknown")).alias("category"), "model").agg(
        F.count("*").alias("n"), F.avg("must_include_hit_rate").alias("must_include_avg_hit_rate"), (1 - F.avg("must_not_include_violation_rate")).alias("non_violation_rate"), _share("need_human_correct").alias("need_human_accuracy"), _share("post_has_risk").alias("post_risk_rate")
    )
    cells = df.select(F.coalesce("category", F.lit("unknown")).alias("category")).distinct().withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return cells.join(done, ["category", "model"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
