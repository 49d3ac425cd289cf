"""One list of rules, two ways to read it: the first that fails, or all that fail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OK = "ok"


@dataclass(frozen=True)
class Rule:
    """``fails`` is true where the rule is broken; or ``codes`` is an array of codes, one per breach in order."""

    code: str | None = None
    fails: Column | None = None
    codes: Column | None = None

    def first(self) -> Column:
        return F.get(self.codes, F.lit(0)) if self.codes is not None else F.when(self.fails, F.lit(self.code))

    def every(self) -> Column:
        if self.codes is not None:
            return F.coalesce(self.codes, F.array().cast("array<string>"))
        return F.when(self.fails, F.array(F.lit(self.code))).otherwise(F.array().cast("array<string>"))


def first_failure(rules: Sequence[Rule]) -> Column:
    return F.coalesce(*[r.first() for r in rules], F.lit(OK))


def all_failures(rules: Sequence[Rule]) -> Column:
    return F.concat(*[r.every() for r in rules])


def coded(code: Column) -> Rule:
    """A rule whose code is a column, null where it holds."""
    return Rule(codes=F.array_compact(F.array(code)))
