"""Plans of what to generate: some hundred rows, made on the driver."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import packs


def shares(weights: dict[str, int], total: int) -> dict[str, int]:
    """``total`` by largest remainder, exact in integers, ties in order."""
    whole = sum(weights.values())
    out = {k: v * total // whole for k, v in weights.items()}
    rest = sorted(weights, key=lambda k: -(weights[k] * total % whole))
    for k in rest[: total - sum(out.values())]:
        out[k] += 1
    return out


def _left(names: Iterable[str], remaining: dict[str, int], every: Iterable[str]) -> list[str]:
    return [n for n in names if remaining.get(n, 0) > 0] or [n for n in every if remaining.get(n, 0) > 0] or list(every)


def _shuffled(rows: list[dict], seed: int) -> list[dict]:
    return [r for _, r in sorted(enumerate(rows), key=lambda x: hashlib.md5(f"{seed}:{x[0]}".encode()).hexdigest())]


def preference_plan(total: int, seed: int = 42) -> list[dict]:
    """category, rejected_type and severity: each category's share, of its allowed types that with most left."""
    left = shares(packs.REJECTED_TYPE_TARGETS, total)
    rows = []
    for category, n in shares(packs.PREFERENCE_CATEGORY_TARGETS, total).items():
        for _ in range(n):
            kind = max(_left(packs.ALLOWED_REJECTED.get(category, packs.REJECTED_TYPES), left, packs.REJECTED_TYPES), key=lambda t: left.get(t, 0))
            left[kind] = left.get(kind, 0) - 1
            rows.append({"category": category, "rejected_type": kind, "severity": packs.SEVERITY_OF.get(kind, "medium")})
    return _shuffled(rows, seed)


def evaluation_plan(total: int, seed: int = 42) -> list[dict]:
    """category, eval_type and difficulty: types as above; of a type's difficulties the first with any left."""
    types, levels = shares(packs.EVAL_TYPE_TARGETS, total), shares(packs.DIFFICULTY_TARGETS, total)
    rows = []
    for category, n in shares(packs.EVAL_CATEGORY_TARGETS, total).items():
        for _ in range(n):
            kind = max(_left(packs.ALLOWED_EVAL_TYPES.get(category, packs.EVAL_TYPES), types, packs.EVAL_TYPES), key=lambda t: types.get(t, 0))
            types[kind] = types.get(kind, 0) - 1
            level = _left(packs.PREFERRED_DIFFICULTY.get(kind, packs.DIFFICULTIES), levels, packs.DIFFICULTIES)[0]
            levels[level] = levels.get(level, 0) - 1
            rows.append({"category": category, "eval_type": kind, "difficulty": level})
    return _shuffled(rows, seed)


def as_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([{"plan_id": i, **r} for i, r in enumerate(rows)])


def until_full(total: int, one_round: Callable[[int, int], int], most: int = 20, rounds: int | None = None) -> int:
    """Rounds of asking for twice what is missing (``most`` at once) until ``total`` are accepted.

    ``one_round(ask, number)`` gives how many it accepted; after max(50, 5 * total) rounds it ends short."""
    have = 0
    for number in range(rounds or max(50, 5 * total)):
        if have >= total:
            break
        have += one_round(min(most, 2 * (total - have)), number)
    return min(have, total)


def asked(need: int, factor: float = 1.5, least: int = 1) -> int:
    """How many variants to ask for so that ``need`` remain."""
    return max(least, need, int(need * factor))


def refilled(need: int, ask: Callable[[int], int], rounds: int = 3, factor: float = 1.5) -> int:
    """How many of ``need`` are had after asking again for what is missing, ``rounds`` times at most; ``ask`` gives
    how many of those it was asked for were accepted."""
    have = 0
    for _ in range(rounds):
        if have >= need:
            break
        have += ask(asked(need - have, factor))
    return min(have, need)


def filled_in(template: str, values: dict[str, object]) -> str:
    """A prompt template with its ``{name}`` places filled; unknown names and other braces stay as they are."""
    return re.sub(r"\{([A-Za-z_][A-Za-z_0-9]*)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], template)


def prompts(df: DataFrame, template: str, name: str = "prompt") -> DataFrame:
    """``df`` with the template filled from its columns, row by row, in column ``name``."""
    parts = re.split(r"(\{[A-Za-z_][A-Za-z_0-9]*\})", template)
    known = {f"{{{c}}}": c for c in df.columns}
    return df.withColumn(name, F.concat(*[F.coalesce(F.col(known[p]).cast("string"), F.lit("")) if p in known else F.lit(p) for p in parts]))
