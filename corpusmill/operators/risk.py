"""Risk flags of queries, answers and retrievals, and where they lead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import packs
from corpusmill.functions.text import all_hits

LOW_SCORE = 0.35


def _judged(flags: Column, name: str) -> Column:
    some = F.size(flags) > 0
    return F.struct(some.alias(name), F.when(some, "high").otherwise("low").alias("risk_level"), flags.alias("risk_flags"))


def query_risk(query: Column) -> Column:
    return _judged(all_hits(query, packs.QUERY_RISKS, ignore_case=False), "need_human")


def answer_risk(answer: Column) -> Column:
    return _judged(all_hits(answer, packs.ANSWER_RISKS, ignore_case=False), "has_risk")


def retrieval_risk(hits: Column, least: float = LOW_SCORE) -> Column:
    """``hits`` is an array of structs with score, best first."""
    none = F.coalesce(F.size(hits) < 1, F.lit(True))
    score = F.when(~none, F.coalesce(F.get(hits, F.lit(0))["score"].cast("double"), F.lit(0.0)))
    flags = F.when(none, F.array(F.lit("no_retrieved_docs"))).when(score < least, F.array(F.lit("low_retrieval_score"))).otherwise(F.array().cast("array<string>"))
    return F.struct((F.size(flags) == 0).alias("retrieval_reliable"), flags.alias("risk_flags"), score.alias("top1_score"))


def fallback(flags: Column) -> Column:
    out = F.lit(packs.FALLBACKS[-1][1])
    for names, text in reversed(packs.FALLBACKS[:-1]):
        out = F.when(F.arrays_overlap(F.coalesce(flags, F.array().cast("array<string>")), F.array(*map(F.lit, names))), F.lit(text)).otherwise(out)
    return out


def controlled(query: Column, answer: Column, hits: Column, least: float = LOW_SCORE, replace: bool = False) -> Column:
    """Everything at once: the three checks, all flags once and in order, and the answer to give."""
    before, found, after = query_risk(query), retrieval_risk(hits, least), answer_risk(answer)
    flags = F.array_distinct(F.concat(before["risk_flags"], found["risk_flags"], after["risk_flags"]))
    human = before["need_human"] | after["has_risk"] | ~found["retrieval_reliable"]
    given = F.when(human, fallback(flags)).otherwise(answer) if replace else answer
    return F.struct(
        given.alias("final_answer"), answer.alias("original_answer"), human.alias("need_human"), F.when(human, "high").otherwise("low").alias("risk_level"), flags.alias("risk_flags"),
        before.alias("pre_check"), found.alias("retrieval_check"), after.alias("post_check"),
    )


def routed(query: Column, answer: Column, hits: Column | None = None, least: float = LOW_SCORE, safe_mode: bool = True) -> Column:
    """(route, answer): a safe answer where the query is risky or the retrieval weak, else the model's.

    What the answer says never leads to a safe one."""
    before = query_risk(query)
    flags, off = before["risk_flags"], before["need_human"]
    if hits is not None:
        found = retrieval_risk(hits, least)
        flags, off = F.concat(flags, found["risk_flags"]), off | ~found["retrieval_reliable"]
    off = off & F.lit(safe_mode)
    return F.struct(F.when(off, "fallback").otherwise("model").alias("route"), F.when(off, fallback(flags)).otherwise(answer).alias("answer"))
