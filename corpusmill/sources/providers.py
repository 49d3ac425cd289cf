"""Models from outside as functions over Arrow batches, and what they answer as columns.

A provider is any picklable function from a list of inputs to a list of outputs; it is made once a worker.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import filled, strip

#: What surrounds an item of a list that a model writes (fixed values).
EDGES = " \t\r\n\"'，,"
NOT_ITEMS = ("输出", "以下", "示例", "JSON", "json")


def with_retry(call: Callable[[Any], Any], tries: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[Any], Any]:
    """``call`` tried again after pause, 2 * pause, ...; the last failure is raised."""

    def run(value: Any) -> Any:
        for attempt in range(1, tries + 1):
            try:
                return call(value)
            except Exception:
                if attempt == tries:
                    raise
                sleep(pause * attempt)

    return run


def generated(df: DataFrame, make: Callable[[], Callable[[list], list]], given: str, out: str, kind: T.DataType | str = "string") -> DataFrame:
    """``df`` with ``out``: the provider's answers to the column ``given``, batch by batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(kind) if isinstance(kind, str) else kind)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            yield batch.assign(**{out: pd.Series(list(provider(batch[given].tolist())), index=batch.index, dtype=object)})

    return df.mapInPandas(run, schema)


def embedded(df: DataFrame, make: Callable[[], Callable[[list[str]], list]], text: str, out: str = "vector", prefix: str = "", unit: bool = True) -> DataFrame:
    """``df`` with vectors of ``text``; ``prefix`` (an instruction) goes before queries, ``unit`` scales to length 1."""
    told = df.withColumn("_told", F.concat(F.lit(prefix), filled(F.col(text))))
    raw = generated(told, make, "_told", out, "array<float>").drop("_told")
    if not unit:
        return raw
    length = F.sqrt(F.aggregate(out, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return raw.withColumn("_length", length).withColumn(out, F.transform(out, lambda x: (x / F.nullif(F.col("_length"), F.lit(0.0))).cast("float"))).drop("_length")


def _unfenced(raw: Column) -> Column:
    text = strip(filled(raw))
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?iU)^```(?:json)?\s*", ""), r"(?U)\s*```$", ""))


def _listed(text: Column, kind: str) -> Column:
    return F.when(text.startswith("["), F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), kind))


def answer_list(raw: Column) -> Column:
    """The strings of a list a model wrote: as JSON, else the JSON list inside, else its lines without bullets."""
    text = _unfenced(raw)
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.btrim(F.coalesce(x, F.lit("None")), F.lit(EDGES))), lambda x: x != "")
    inner = F.regexp_extract(text, r"\[[\s\S]*\]", 0)
    bare = lambda x: F.btrim(F.regexp_replace(strip(x), r"(?U)^[\-\*\d\.\)、\s]+", ""), F.lit(EDGES))
    by_line = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), bare), lambda x: ~x.isin("", "[", "]", "{", "}", ",") & ~x.rlike("^(" + "|".join(NOT_ITEMS) + ")"))
    return F.coalesce(clean(_listed(text, "array<string>")), clean(_listed(inner, "array<string>")), F.when(text == "", F.array().cast("array<string>")).otherwise(by_line))


def answer_objects(raw: Column, kind: str) -> Column:
    """The objects of a list a model wrote (``kind`` is the struct's DDL type); none if there is no list."""
    text = _unfenced(raw)
    whole, inner = (_listed(t, "array<variant>") for t in (text, F.regexp_extract(text, r"\[[\s\S]*\]", 0)))
    found = F.filter(F.coalesce(whole, inner, F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.transform(found, lambda v: F.from_json(F.to_json(v), kind))


def answer_object(raw: Column, kind: str) -> Column:
    """The object a model wrote, or the one inside what it wrote, else null."""
    text = _unfenced(raw)
    one = lambda t: F.when(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.from_json(t, kind))
    return F.coalesce(one(text), one(F.regexp_extract(text, r"\{[\s\S]*\}", 0)))


class Retriever:
    """Whatever has retrieve, search or query, behind one name."""

    def __init__(self, source: Any):
        for name in ("retrieve", "search", "query"):
            if callable(call := getattr(source, name, None)):
                self._call = call
                break
        else:
            raise TypeError("a retriever has retrieve, search or query")

    def __call__(self, *args: Any, **options: Any) -> Any:
        return self._call(*args, **options)
