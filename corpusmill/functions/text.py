"""Text as Column expressions: white space, normal forms, patterns and phrases."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, f"(?U){SPACE}+", "")


def blank(text: Column) -> Column:
    return strip(filled(text)) == ""


def first_full(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def normal(text: Column, form: str = "full") -> Column:
    """A text for comparing: no white space, lower case; ``full`` and ``short`` also fold wide punctuation
    (``short`` leaves colon and semicolon), ``plain`` doesn't."""
    bare = F.lower(squeeze(filled(text)))
    fold = {"full": ("？！。，、：；", "?!.,,:;"), "short": ("？！。，、", "?!.,,"), "plain": ("", "")}[form]
    return F.translate(bare, *fold) if fold[0] else bare


def hits(text: Column, patterns: Iterable[str], ignore_case: bool = True) -> Column:
    """Whether any pattern is found; a null text is empty."""
    any_of = "|".join(f"(?:{p})" for p in patterns)
    return filled(text).rlike(f"(?{'iUd' if ignore_case else 'Ud'}){any_of}")


def holds_any(text: Column, phrases: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [filled(text).contains(p) for p in phrases])


def count_held(text: Column, phrases: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [filled(text).contains(p).cast("int") for p in phrases])


def first_hit(text: Column, packs: Iterable[tuple[str, tuple[str, ...]]], ignore_case: bool = True) -> Column:
    """The name of the first pack that hits, else null."""
    return F.coalesce(*[F.when(hits(text, p, ignore_case), F.lit(name)) for name, p in packs])


def all_hits(text: Column, packs: Iterable[tuple[str, tuple[str, ...]]], ignore_case: bool = True) -> Column:
    """The names of all packs that hit, in order."""
    return F.array_compact(F.array(*[F.when(hits(text, p, ignore_case), F.lit(name)) for name, p in packs]))


def role_text(messages: Column, role: str) -> Column:
    """All full messages of a role, each stripped, one a line; empty without any."""
    own = F.filter(messages, lambda m: (m["role"] == role) & ~blank(m["content"]))
    return filled(F.array_join(F.transform(own, lambda m: strip(m["content"])), "\n"))


def last_of_role(messages: Column, role: str) -> Column:
    """The last message of a role, else null."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def string_list(values: Column) -> Column:
    """The full strings of a list, stripped; null gives none."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda x: x != "")
