"""Groups, leak-free stratified splits, quotas and pairings.

Where a random order is called for, rows are ordered by the MD5 of seed and key: the same on every engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import first_full
from corpusmill.store import written


def shuffled(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def group_key(seed_id: Column, item_id: Column) -> Column:
    """What must stay on one side: the seed, else the item, else the row alone."""
    return F.coalesce(F.concat(F.lit("seed::"), first_full(seed_id)), F.concat(F.lit("item::"), first_full(item_id)), F.concat(F.lit("object::"), F.monotonically_increasing_id().cast("string")))


def groups(df: DataFrame, key: str, category: str, order: str) -> DataFrame:
    """(group_key, category, size, n_categories): the commonest category of each group, the first seen of equals."""
    each = df.groupBy(F.col(key).alias("group_key"), F.coalesce(category, F.lit("unknown")).alias("c")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.min_by("c", F.struct(-F.col("n"), F.col("first")))
    return each.groupBy("group_key").agg(best.alias("category"), F.sum("n").alias("size"), F.count("*").alias("n_categories"))


def ranked(df: DataFrame, strata: Sequence[str], order: Sequence[Column], rank: str = "_rank", size: str = "_size") -> DataFrame:
    """``df`` with each row's place in its stratum (from 1) and the stratum's size; nulls are a stratum too.

    Rows are ranged over partitions by stratum and order, and each partition counts on from what those before it
    hold of a stratum, so no task sees more than its share, whatever one stratum holds."""
    by = [*[F.col(c) for c in strata], *order]
    ranged = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = ranged.groupBy(part, *strata).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each partition and stratum in it
    same = Window.partitionBy(*strata)
    before = F.sum("_n").over(same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(same).alias(size), *[F.col(c).alias(f"_its_{c}") for c in strata])
    mine = F.col("_part") == F.shiftright("_at", 33)
    for c in strata:
        mine = mine & F.col(c).eqNullSafe(F.col(f"_its_{c}"))
    placed = ranged.join(starts, mine).withColumn(rank, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return placed.select(*[f"`{c}`" for c in df.columns], rank, size)


def stratified(df: DataFrame, strata: Sequence[str], key: str, ratio: float, seed: int = 42, least: int = 1) -> DataFrame:
    """``df`` (one row per unit) with column split: of n units of a stratum round(n * ratio), half to even, but
    at least ``least`` and at most n - 1, are valid; a single one is train.  Units without a stratum are one."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio must be between 0 and 1")
    n = F.col("_size")
    quota = F.when(n == 1, 0).otherwise(F.least(F.greatest(F.bround(n * F.lit(ratio)), F.lit(least)), n - 1))
    placed = ranked(df, strata, [shuffled(seed, F.col(key)), F.col(key)])
    return placed.withColumn("split", F.when(F.col("_rank") <= quota, "valid").otherwise("train")).drop("_rank", "_size")


def split_rows(df: DataFrame, key: str, category: str, order: str, ratio: float, seed: int = 42, least: int = 1) -> DataFrame:
    """Every row of ``df`` with the side its group is on."""
    sides = stratified(groups(df, key, category, order), ["category"], "group_key", ratio, seed, least)
    return df.join(sides.select(F.col("group_key").alias(key), "split"), key)


def apportioned(targets: DataFrame, total: int) -> DataFrame:
    """``targets`` (key, weight, ord) with n: shares of ``total`` by largest remainder, ties in order."""
    whole = targets.agg(F.sum("weight").alias("_sum"))
    raw = targets.join(F.broadcast(whole)).withColumn("_raw", F.col("weight") * F.lit(total) / F.col("_sum"))  # one row
    floors = raw.withColumn("_floor", F.floor("_raw"))
    left = Window.orderBy(F.desc(F.col("_raw") - F.col("_floor")), "ord")  # targets are a list of names
    short = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    return floors.withColumn("n", (F.col("_floor") + (F.row_number().over(left) <= short).cast("long")).cast("long")).select("key", "weight", "ord", "n")


def paired(plan: DataFrame, sources: DataFrame, seed: int = 42) -> DataFrame:
    """Each plan row (category, plan_id) with a source (category, source_id): the k-th of a category with source
    k mod n of that category in shuffled order; a category without sources takes from all of them."""
    sizes = sources.groupBy("category").agg(F.count("*").alias("_n"))
    own = ranked(sources.select("category", "source_id"), ["category"], [shuffled(seed, F.col("source_id")), F.col("source_id")], "_k").select("category", "source_id", (F.col("_k") - 1).alias("_k"))
    turns = ranked(plan, ["category"], [F.col("plan_id")], "_turn").drop("_size").join(sizes, "category", "left").withColumn("_turn", F.col("_turn") - 1)
    direct = turns.where("_n is not null").withColumn("_k", F.pmod("_turn", "_n")).join(own, ["category", "_k"]).select(*plan.columns, "source_id")
    orphans = turns.where("_n is null")
    total = sources.agg(F.count("*").alias("_n"))
    every = sources.select("source_id", F.xxhash64("source_id").alias("_h"), F.pmod(F.xxhash64("source_id"), F.lit(1024)).alias("_k"))
    lone = orphans.drop("_n").join(F.broadcast(total)).where("_n > 0")  # one row
    nearest = lone.withColumn("_k", F.pmod(F.xxhash64("plan_id"), F.lit(1024))).join(every.groupBy("_k").agg(F.min_by("source_id", "_h").alias("source_id")), "_k", "left")
    any_one = sources.agg(F.min_by("source_id", shuffled(seed, F.col("source_id"))).alias("_any"))
    spare = nearest.join(F.broadcast(any_one)).select(*plan.columns, F.coalesce("source_id", "_any").alias("source_id"))  # one row
    return direct.unionByName(spare)


def sampled(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum in shuffled order."""
    same = Window.partitionBy(*strata).orderBy(shuffled(seed, F.col(key)), F.col(key))
    return df.withColumn("_rank", F.row_number().over(same)).where(F.col("_rank") <= n).drop("_rank")


def batched(df: DataFrame, order: str, size: int) -> DataFrame:
    """``df`` with the number of its batch of ``size`` rows, in order, whatever its size."""
    placed = ranked(df, [], [F.col(order)])
    return placed.withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank", "_size")


def places(df: DataFrame, order: Sequence[Column], place: str = "_place") -> DataFrame:
    """``df`` with each row's place (from 0) in ``order``, whatever its size.

    Rows are ranged over partitions by the order; each partition counts on from those before it, so no single
    task sees all rows.  Rows and counts are read from one table: ranged a second time (as when a cache is
    dropped), partitions can end elsewhere."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.select(*[f"`{c}`" for c in df.columns], (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(place))


def numbered(df: DataFrame, order: Sequence[Column], prefix: str, start: int = 1) -> DataFrame:
    """``df`` with id ``prefix_000001`` and on, in order."""
    return places(df, order).withColumn("id", F.format_string(f"{prefix}_%06d", F.col("_place") + start)).drop("_place")
