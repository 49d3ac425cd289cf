"""Secret scans over a content-addressed ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text.  The ledger holds one row per blob, with or
without findings: the rule versions that have seen it and what they found.  A scan looks at each distinct blob
once, with just those rule versions that the ledger doesn't have for it, and joins findings back to all paths
that hold the blob.  A rule's new version takes the place of the old one's findings, blob by blob as it sees them.

Spans come from two native functions: the matches of a rule and the pieces between them; running sums of
their lengths are the places.  Rules match leftmost and non-overlapping, matches that are too short go.

Defined results: a null text is the empty text, which has no findings.  Repeated rows share a blob and each
get its findings; findings that start together are listed in the order of the rules.  A text is scanned whole,
however long.  An empty table leaves the ledger as it is, or gives an empty one.  Columns of the paths pass
through under any name but that of the findings' column, which is replaced.  A blob held by a third of all paths
is scanned once; joining back to its paths is a join with one row per blob, whose large side Spark may split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.names import free_names
from corpusmill.llm.store import written


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` code points or more; ``version`` changes with it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which equal starts are listed (fixed values).
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the second rule pack adds.
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
#: Necessary for any match: a blob without this is not looked at again.
QUICK = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}|-----BEGIN |eyJ|gh[pousr]_"""

FOUND = "array<struct<start:bigint,end:bigint,kind:string,version:int>>"


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _scan(blobs: DataFrame, rules: tuple[Rule, ...], quick: str | None) -> DataFrame:
    """(blob, todo, fresh) of all ``blobs``, which have blob, text and todo (names of unseen rules)."""
    text, parts = F.col("text"), []
    none = F.array().cast("array<struct<rank:int,i:int,gap:bigint,size:bigint,judged:int>>")
    for rank, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        zipped = F.arrays_zip(
            F.split(text, rule.pattern, -1).alias("p"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("g")
        )
        # x.m of the last piece is null: it has no match behind it
        own = F.lit(rank).alias("rank")
        made = F.transform(zipped, lambda x, i: F.struct(own, i.alias("i"), F.length(x["p"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("size"), F.length(x["g"]).alias("judged")))  # noqa: B023
        made = F.filter(made, lambda x: x["size"].isNotNull())
        parts.append(F.when(F.array_contains("todo", rule.name), made).otherwise(none))
    every = F.concat(*parts)
    rows = blobs.select("blob", "todo", F.explode_outer(F.when(text.rlike(quick), every).otherwise(none) if quick else every).alias("x")).select("blob", "todo", "x.*")
    before = Window.partitionBy("blob", "rank").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    good, kind, version = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("int")
    for rank, rule in enumerate(rules):
        mine = F.col("rank") == rank
        good, kind, version = good | (mine & (F.col("judged") >= rule.least)), F.when(mine, rule.kind).otherwise(kind), F.when(mine, rule.version).otherwise(version)
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "end", kind.alias("kind"), version.alias("version"))
    # a blob without matches has one row without a span, which the list leaves out
    return rows.withColumn("end", end).groupBy("blob").agg(F.first("todo").alias("todo"), F.collect_list(F.when(good, span)).alias("fresh"))


def scan(history: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES, quick: str | None = QUICK) -> DataFrame:
    """The ledger after ``history``: blob, rules (names of the rule versions that have seen it), found.

    ``ledger`` is what an earlier call gave (written and read again); pairs of blob and rule version that it
    holds are not scanned again.  ``quick`` is a pattern that any match needs; None with rules of one's own.
    """
    names = F.lit([r.name for r in rules])
    texts = history.select(blob(F.col(f"`{text}`")).alias("blob"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    if ledger is None:
        fresh = _scan(texts.dropDuplicates(["blob"]).withColumn("todo", names), rules, quick)
        return fresh.select("blob", F.col("todo").alias("rules"), F.col("fresh").cast(FOUND).alias("found"))
    todo = written(unseen(history, ledger, text, rules), "secret-todo")
    if todo.isEmpty():
        return ledger.select("blob", "rules", "found")
    fresh = _scan(texts.join(todo, "blob").dropDuplicates(["blob"]), rules, quick)
    both = ledger.select("blob", "rules", "found").join(fresh, "blob", "full")
    kinds = lambda names: F.transform(names, lambda x: F.substring_index(x, "@", 1))
    nothing = F.array().cast("array<string>")
    now = kinds(F.coalesce("todo", nothing))  # kinds whose findings are new
    return both.select(
        "blob",
        F.concat(F.filter(F.coalesce("rules", nothing), lambda x: ~F.array_contains(now, F.substring_index(x, "@", 1))), F.coalesce("todo", nothing)).alias("rules"),
        F.concat(F.filter(F.coalesce("found", F.array().cast(FOUND)), lambda x: ~F.array_contains(now, x["kind"])), F.coalesce("fresh", F.array()).cast(FOUND)).alias("found"),
    )


def unseen(history: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo): the blobs of ``history`` that some of ``rules`` have not seen, and the names of those."""
    blobs = history.select(blob(F.col(f"`{text}`")).alias("blob")).distinct()
    known = ledger.select("blob", "rules")
    todo = F.array_except(F.lit([r.name for r in rules]), F.coalesce("rules", F.array().cast("array<string>")))
    return blobs.join(known, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)


def joined_back(paths: DataFrame, ledger: DataFrame, text: str = "text", found: str = "found", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` without the text, each row with what ``rules`` found in the blob it holds: structs of start,
    rank (place of the rule), end and kind, sorted."""
    rest = [f"`{c}`" for c in paths.columns if c not in (text, found)]
    address, key, spans = free_names([*paths.columns, found], 3)
    addressed = paths.select(*rest, blob(F.col(f"`{text}`")).alias(address))
    names = F.lit([r.name for r in rules])
    place = lambda x: F.array_position(names, F.concat(x["kind"], F.lit("@"), x["version"].cast("string"))).cast("int") - 1
    own = F.filter(F.transform("found", lambda x: F.struct(x["start"].alias("start"), place(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))), lambda x: x["rank"] >= 0)
    known = ledger.where(F.size("found") > 0).select(F.col("blob").alias(key), F.array_sort(own).alias(spans))
    joined = addressed.join(known, F.col(address) == F.col(key), "left")
    return joined.select(*rest, F.coalesce(spans, F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")).alias(found))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Each document's secrets, scanned by blob.  A second scan meets the ledger and finds no pair unseen."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = scan(docs, written(scan(docs), "secret-ledger"))
    rows = joined_back(docs, ledger)
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    ranks = F.transform("found", lambda x: x["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _sql() -> str:
    one = []
    for rank, r in enumerate(RULES):
        pat = r.pattern.replace("'", "''")
        one.append(f"""SELECT r, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(g) AS g, unnest(p[1:len(m)]) AS p
  FROM (SELECT r, regexp_extract_all(t, '{pat}') AS m, regexp_extract_all(t, '{pat}', {r.group}) AS g, string_split_regex(t, '{pat}') AS p FROM d)""")
    return (
        "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), m AS (" + "\n  UNION ALL ".join(one) + "),\n"
        "s AS (SELECT r, rank, kind, least, g, length(m) AS n, sum(length(p) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS e FROM m),\n"
        "f AS (SELECT r, rank, (e - n)::BIGINT AS a, kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT AS x FROM s WHERE length(g) >= least),\n"
        "j AS (SELECT r, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,\n"
        "  string_agg(x, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(x, ',' ORDER BY a, rank) AS spans FROM f GROUP BY r)\n"
        "SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,\n"
        "  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)"
    )


OP2_SQL = _sql()
