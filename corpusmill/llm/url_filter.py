"""URL filters: rules by longest match, then a Bloom filter cascade, in DataFrame operations only.

The cascade gives exact membership in a list without a join.  Level 1 is a Bloom filter of the listed keys;
level 2 one of those other keys of the corpus that pass level 1; level 3 one of the listed keys that pass
level 2, and so on until no key of the corpus is left over.  A key is judged by the first level it fails.
This is exact for every key of the universe that the cascade was built over, which is all keys there are.
While it is built, only keys that pass level 1 are ever gathered: the listed ones and few others.

A level is an array of 64-bit words, built by a grouped bit-or (never more rows than words, whatever is
listed) and read as a scalar subquery.  Keys fall into ranges by hash, as many as it takes for a level of a
range to have ``RANGE_BITS`` bits (8 MB) at most; each range has a cascade of its own.  With more ranges than one the
rows are written by range and marked range by range, so what is sent at once is bounded whatever is listed.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.
A url of any length is read whole.  Rules of equal length that fit: the later one in the list wins.  Repeated rows
are judged one by one; an empty table gives an empty table, an empty list lists nothing.  Columns named host, path,
rule, listed or verdict are replaced; all others pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.names import free_names
from corpusmill.llm.store import dropped, written

BITS_PER_KEY, HASHES, RANGE_BITS = 10, 4, 1 << 26


@dataclass(frozen=True)
class UrlRule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules (fixed values).
RULES = (
    UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """(name, action) of the longest rule that fits, else nulls."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, action = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.action)).otherwise(action)
    return name, action


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + j)), F.lit(bits)) for j in range(HASHES)]


def _filter(keys: DataFrame, level: int, n: int) -> tuple[Column, int]:
    """A scalar column with the words of a Bloom filter of the n ``keys``, and its size in bits."""
    words = max(1, -(-n * BITS_PER_KEY // 64))
    place = keys.select(F.explode(F.array(*_places(F.col("key"), level, words * 64))).alias("b"))
    set_bits = place.select(F.floor(F.col("b") / 64).alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("bits"))
    every = set_bits.unionByName(keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits")))
    packed = every.groupBy("w").agg(F.bit_or("bits").alias("bits"))
    row = written(packed.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words")), f"url-level{level}")
    return row.scalar(), words * 64


def _passes(key: Column, words: Column, level: int, bits: int) -> Column:
    tests = [F.getbit(F.get(words, F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1 for b in _places(key, level, bits)]
    return reduce(lambda a, b: a & b, tests)


class _Levels:
    """The cascade of one range of keys: ``listed`` and ``universe`` (column key)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, n: int):
        self.levels: list[tuple[Column, int]] = []
        inside, outside = listed, universe
        while n:
            level = len(self.levels) + 1
            words, bits = _filter(inside, level, n)
            self.levels.append((words, bits))
            over = outside.where(_passes(F.col("key"), words, level, bits))
            if level == 1:  # the universe holds listed keys too
                over = over.select("key", F.lit(False).alias("on")).unionByName(listed.select("key", F.lit(True).alias("on"))).groupBy("key").agg(F.max("on").alias("on")).where("not on").select("key")
            inside, outside = written(over, "url-over"), inside
            n = inside.count()

    def column(self, key: Column) -> Column:
        found = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            words, bits = self.levels[level - 1]
            found = F.when(_passes(key, words, level, bits), found).otherwise(F.lit(level % 2 == 0))
        return found


class Cascade:
    """Exact membership in ``listed`` (column key) for all keys of ``universe`` (column key)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, range_bits: int = RANGE_BITS):
        listed = written(listed.select("key").where("key is not null").distinct(), "url-listed")
        n, universe = listed.count(), universe.select("key").where("key is not null")
        self.ranges = max(1, -(-n * BITS_PER_KEY * 5 // (4 * range_bits)))  # ranges are uneven by some percent
        if self.ranges == 1:
            self.parts = [_Levels(listed, universe, n)]
            return
        own = _range(F.col("key"), self.ranges).alias("range")
        listed, universe = (written(df.select("key", own), "url-ranges", "range") for df in (listed, universe.distinct()))
        self.parts = []
        for r in range(self.ranges):
            mine, others = (df.where(F.col("range") == r).select("key") for df in (listed, universe))
            self.parts.append(_Levels(mine, others, mine.count()))

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with a boolean column ``name``: whether ``key`` is listed (a null is not)."""
        listed = lambda part: F.coalesce(part.column(F.col(f"`{key}`")), F.lit(False))
        if self.ranges == 1:
            return df.withColumn(name, listed(self.parts[0]))
        at = free_names([*df.columns, name], 1)[0]
        by_range = written(df.withColumn(at, F.coalesce(_range(F.col(f"`{key}`"), self.ranges), F.lit(0))), "url-rows", at)
        marked = [written(by_range.where(F.col(at) == r).drop(at).withColumn(name, listed(part)), "url-marked") for r, part in enumerate(self.parts)]
        dropped(by_range)
        return reduce(DataFrame.unionByName, marked)


def _range(key: Column, ranges: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key, F.lit(-1)), 16), F.lit(ranges)).cast("int")


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict; ``listed`` has the blocked sections (column key:
    host and the path's first part).  Columns of those names are replaced."""
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    made = ("host", "path", "rule", "listed", "verdict")
    action, part = free_names([*pages.columns, *made], 2)
    rows = pages.select(*[f"`{c}`" for c in pages.columns if c.lower() not in made], host.alias("host"), path.alias("path"))
    name, its_action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, action: its_action, part: section(F.col("host"), F.col("path"))})
    rows = Cascade(listed, rows.select(F.col(part).alias("key"))).mark(rows, part, "listed")
    return rows.withColumn("verdict", F.coalesce(action, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))).drop(action, part)


def section(host: Column, path: Column) -> Column:
    return F.concat(host, F.regexp_extract(path, "^/[^/]*", 0))


def campaign_sections(pages: DataFrame, url: str = "url") -> DataFrame:
    """Sections (column key) of which at least a quarter of the pages are campaign links (``utm_source=``)."""
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    rows = pages.select(section(host, path).alias("key"), F.coalesce(F.col(f"`{url}`").contains("utm_source="), F.lit(False)).cast("int").alias("hit"))
    return rows.where("key <> ''").groupBy("key").agg(F.sum("hit").alias("hits"), F.count("*").alias("n")).where("4 * hits >= n").select("key")


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule and verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, campaign_sections(pages)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH r AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, host || regexp_extract(path, '^/[^/]*') AS section FROM p),
l AS (SELECT section FROM q WHERE section <> '' GROUP BY section HAVING 4 * count(*) FILTER (contains(u, 'utm_source=')) >= count(*)),
v AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE rule WHEN 'com/' THEN 'allow' WHEN 'www.example.com/en/' THEN 'allow' WHEN 'example.com/en/' THEN 'block'
    WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block' ELSE CASE WHEN section IN (SELECT section FROM l) THEN 'block' ELSE 'allow' END END AS verdict
FROM v
"""
