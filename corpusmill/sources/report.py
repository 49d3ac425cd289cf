"""Reports: distributions as rows, tables in Markdown, one JSON object.

A whole report is one table (section, key, side, value): sections of counts and shares, side by side where there are
sides.  ``told`` makes Markdown of it and ``as_object`` a nested object.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import role_text

REPORT = ("section", "key", "side", "value")


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(section, key, n): rows by value of each column, nulls as unknown."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("section"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("key")) for c in columns]))
    return df.select(each.alias("x")).groupBy("x.section", "x.key").agg(F.count("*").alias("n"))


def side_by_side(df: DataFrame, key: str, side: str, sides: Sequence[str]) -> DataFrame:
    """Rows by key and side, sides as columns, zeros where there are none."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)).pivot(side, list(sides)).count().na.fill(0, list(sides))


def shares(df: DataFrame, flag: str) -> DataFrame:
    """(n, n_flag, share): the share to 4 places, 0 of nothing."""
    hit = F.count_if(F.col(flag))
    return df.agg(F.count("*").alias("n"), hit.alias("n_flag"), F.bround(hit / F.greatest(F.count("*"), F.lit(1)), 4).alias("share"))


def cell(value: object) -> str:
    return "N/A" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, order: Sequence[str], most: int | None = None) -> str:
    """A small result as a Markdown table; ``most`` is for detail tables that show only their first rows."""
    rows = df.orderBy(*order)
    rows = (rows.limit(most) if most else rows).collect()
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"


def as_object(df: DataFrame) -> dict[str, dict[str, int]]:
    """(section, key, n) rows as a nested object."""
    out: dict[str, dict[str, int]] = {}
    for r in df.orderBy("section", "key").collect():
        out.setdefault(r["section"], {})[r["key"]] = r["n"]
    return out


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---- whole reports
def _entries(df: DataFrame, section: str, named: dict[str, Column]) -> DataFrame:
    """Aggregates of ``df`` as rows of one section."""
    one = df.agg(*[c.cast("double").alias(k) for k, c in named.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("value")) for k in named]))
    return one.select(rows.alias("x")).select(F.lit(section).alias("section"), "x.key", F.lit("all").alias("side"), "x.value")


def spread(df: DataFrame, columns: Sequence[str], side: str | None = None, suffix: str = "_distribution") -> DataFrame:
    """Rows by value of each column, over all and by ``side``; nulls are ``unknown``."""
    each = F.explode(F.array(*[F.struct(F.lit(f"{c}{suffix}").alias("section"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("key")) for c in columns]))
    rows = df.select(each.alias("x"), *([F.col(side).alias("side")] if side else [])).select("x.*", *(["side"] if side else []))
    if not side:
        return rows.groupBy("section", "key").agg(F.count("*").cast("double").alias("value")).select("section", "key", F.lit("all").alias("side"), "value")
    sets = rows.groupingSets([["section", "key"], ["section", "key", "side"]], "section", "key", "side").agg(F.count("*").cast("double").alias("value"))
    return sets.select("section", "key", F.coalesce("side", F.lit("all")).alias("side"), "value")


def _reasons(reasons: DataFrame | None, section: str) -> list[DataFrame]:
    """(reason, n) rows as a section."""
    return [] if reasons is None else [reasons.select(F.lit(section).alias("section"), F.col("reason").alias("key"), F.lit("all").alias("side"), F.col("n").cast("double").alias("value"))]


def _ratio(part: Column, whole: Column) -> Column:
    return F.bround(part / F.greatest(whole, F.lit(1)), 4)


def cleaning_report(judged: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Of samples (messages, category, source, seed_id, reason): counts, reasons, distributions and lengths of
    what was kept (reason ``ok``).  ``errors`` (reason, n) are what the reader met."""
    n, kept = F.count("*"), F.count_if(F.col("reason") == "ok")
    good = judged.where("reason = 'ok'")
    texts = good.select(F.length(role_text(F.col("messages"), "user")).alias("user"), F.length(role_text(F.col("messages"), "assistant")).alias("assistant"))
    lengths = {f"{c}_{name}": f for c in ("user", "assistant") for name, f in (("min", F.min(c)), ("max", F.max(c)), ("avg", F.round(F.avg(c), 2)))}
    dropped = judged.where("reason <> 'ok'").groupBy("reason").agg(F.count("*").alias("n"))
    parts = [_entries(judged, "summary", {"raw_items": n, "cleaned_items": kept, "dropped_items": n - kept, "drop_ratio": _ratio(n - kept, n)}), *_reasons(errors, "input_errors"), *_reasons(dropped, "drop_reasons")]
    return merged([*parts, spread(good, ["category", "source"]), spread(good, ["seed_id"], suffix="_retention"), _entries(texts, "length_stats", lengths)])


def split_report(rows: DataFrame, groups: DataFrame, invalid: int = 0) -> DataFrame:
    """Of ``rows`` (category, source, seed_id, split) and ``groups`` (category, n_categories, split): counts, shares,
    distributions by side, seeds on both sides and groups of several categories."""
    both, valid = F.count("*"), F.count_if(F.col("split") == "valid")
    items = _entries(rows, "summary", {"raw_items": both + invalid, "invalid_items": F.lit(invalid), "train_items": both - valid, "valid_items": valid, "actual_valid_item_ratio": _ratio(valid, both)})
    own = _entries(groups, "summary", {"total_groups": both, "train_groups": both - valid, "valid_groups": valid, "actual_valid_group_ratio": _ratio(valid, both), "group_category_conflicts": F.count_if(F.col("n_categories") > 1)})
    seeds = rows.where("seed_id is not null and seed_id <> ''").groupBy("seed_id").agg(F.count_distinct("split").alias("n"))
    leaked = _entries(seeds, "summary", {"seed_leakage_count": F.count_if(F.col("n") > 1)})
    by_group = spread(groups.select(F.col("category").alias("group_category"), "split"), ["group_category"], "split")
    return merged([items, own, leaked, spread(rows, ["category", "source"], "split"), by_group])


def preference_report(rows: DataFrame, planned: int, reasons: DataFrame | None = None) -> DataFrame:
    """Of preference pairs (category, rejected_type, source, severity, split): counts and distributions by side."""
    both, valid = F.count("*"), F.count_if(F.col("split") == "valid")
    summary = {"planned_items": F.lit(planned), "candidate_items": both, "train_items": both - valid, "valid_items": valid, "actual_valid_ratio": _ratio(valid, both)}
    return merged([_entries(rows, "summary", summary), *_reasons(reasons, "drop_reasons"), spread(rows, ["category", "rejected_type", "source", "severity"], "split")])


def evaluation_report(items: DataFrame, plan: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Of evaluation items and their plan (category, eval_type, difficulty): counts and distributions."""
    kinds = ["category", "eval_type", "difficulty"]
    tags = items.select(F.explode("risk_tags").alias("risk_tag"))
    parts = [_entries(items, "summary", {"generated_items": F.count("*")}), _entries(plan, "summary", {"planned_items": F.count("*")}), *_reasons(reasons, "drop_reasons")]
    planned = spread(plan.select(*[F.col(c).alias(f"plan_{c}") for c in kinds]), [f"plan_{c}" for c in kinds])
    return merged([*parts, spread(items, [*kinds, "need_human", "need_rag"]), spread(tags, ["risk_tag"]), planned])


def quality_report(found: DataFrame, thresholds: DataFrame, datasets: dict[str, DataFrame]) -> DataFrame:
    """Of issues, thresholds (name, actual, least, passed) and datasets (each with its distributions' columns):
    the verdict's counts, each threshold's sides, issues by type, and each dataset's distributions."""
    rolled = found.groupBy("severity", "issue_type").agg(F.count("*").cast("double").alias("value"))
    issues = rolled.select(F.lit("issues").alias("section"), F.col("issue_type").alias("key"), F.col("severity").alias("side"), "value")
    n = lambda s: F.count_if(F.col("severity") == s)
    summary = _entries(found, "summary", {"errors": n("error"), "warnings": n("warning"), "issues": F.count("*"), "passed": (n("error") == 0).cast("int")})
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).cast("int").cast("double").alias("value")) for c in ("actual", "least", "passed")]))
    limits = thresholds.select(F.lit("thresholds").alias("section"), F.col("name").alias("key"), sides.alias("x")).select("section", "key", "x.side", "x.value")
    parts = [spread(df, [c for c in df.columns if c != "id"]).withColumn("section", F.concat(F.lit(f"{name}: "), "section")) for name, df in datasets.items()]
    return merged([summary, limits, issues, *parts])


def told(report: DataFrame, title: str, sections: Sequence[str] = (), most: int | None = None) -> str:
    """A report in Markdown: named sections first and the others by name; a table a section, sides as columns,
    rows by key; ``most`` rows of a section at most."""
    rows: dict[str, dict[str, dict[str, float]]] = {}
    for r in report.collect():  # one row for each value that is told apart
        rows.setdefault(r["section"], {}).setdefault(r["key"], {})[r["side"]] = r["value"]
    out = [f"# {title}", ""]
    for name in [*[s for s in sections if s in rows], *sorted(set(rows) - set(sections))]:
        sides = sorted({side for values in rows[name].values() for side in values}, key=lambda x: (x != "all", x))
        out += [f"## {name}", "", "| key | " + " | ".join(sides) + " |", "|---|" + "---:|" * len(sides)]
        number = lambda v: "0" if v is None else f"{v:g}" if v == int(v) else f"{v:.4f}"
        out += [f"| {key} | " + " | ".join(number(values.get(side)) for side in sides) + " |" for key, values in sorted(rows[name].items())[:most]]
        out.append("")
    return "\n".join(out)
