"""Ranks and samples by seeded hash; large groups are ranked in parts, never in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import sized_join


def shuffle_key(key: str, seed: int) -> Column:
    """The place of a row in a seeded shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def hash_rank(df: DataFrame, group: list[str], key: str, seed: int = 17, digits: int = 2) -> DataFrame:
    """df with rank (from 1) and size: its place in the seeded shuffle of its group, and the group's rows.

    Parts of a group, by the first hex digits of the hash, are counted by a map-side aggregate; a row's rank is the rows of
    the parts before its own and its place inside it, so no task sorts more than one part. Null groups are groups.
    """
    named = df.withColumn("h_", shuffle_key(key, seed)).withColumn("p_", F.substring("h_", 1, digits))
    named = named.withColumn("g_", F.to_json(F.struct(*[F.col(g).cast("string").alias(f"c{i}") for i, g in enumerate(group)])) if group else F.lit(""))
    parts = named.groupBy("g_", "p_").agg(F.count("*").alias("n_"))
    ordered = Window.partitionBy("g_").orderBy("p_")
    ahead = parts.withColumn("ahead_", F.sum("n_").over(ordered) - F.col("n_")).withColumn("size", F.sum("n_").over(Window.partitionBy("g_"))).drop("n_")
    inside = Window.partitionBy("g_", "p_").orderBy("h_", key)
    out = named.join(ahead, ["g_", "p_"]).withColumn("rank", F.row_number().over(inside) + F.col("ahead_"))
    return out.drop("h_", "p_", "g_", "ahead_")


def stratified(df: DataFrame, group: list[str], key: str, n: int, seed: int = 17) -> DataFrame:
    """A sample of at most n rows of each group without replacement; the size is the feature."""
    return hash_rank(df, group, key, seed).where(F.col("rank") <= n).drop("rank", "size")


def held_part(df: DataFrame, group: list[str], key: str, part: float = 0.3, seed: int = 17, least: int = 4) -> DataFrame:
    """df with split: of each group the first max(1, part of its rows) in the seeded shuffle are test, the rest development.

    Raises if a group has fewer than `least` rows.
    """
    ranked = hash_rank(df, group, key, seed)
    if not ranked.where(F.col("size") < least).isEmpty():
        raise ValueError(f"a group has fewer than {least} rows")
    test = F.greatest(F.lit(1), F.floor(F.col("size") * part))
    return ranked.withColumn("split", F.when(F.col("rank") <= test, "test").otherwise("development")).drop("rank", "size")


def with_replacement(df: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """(slot, columns of df): n draws with replacement; slot i takes the row at place hash(seed, i) modulo the rows."""
    ranked = hash_rank(df, [], key, seed)
    total = df.count()
    slots = df.sparkSession.range(n).select(F.col("id").alias("slot"))
    place = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}/"), F.col("slot").cast("string")), 256), 1, 15), 16, 10).cast("bigint"), F.lit(max(total, 1))) + 1
    return slots.withColumn("rank", place).join(ranked, "rank").drop("rank", "size")


def disjoint(df: DataFrame, order: str, keys: list[str], scratch) -> DataFrame:
    """Rows a greedy scan in the order of `order` (unique) takes, if it takes a row unless one of its keys was taken before.

    In each round every row that is first among the remaining rows of all its keys is taken, and rows that share a key with
    one are dropped: what comes out is the scan's choice, in about as many rounds as the logarithm of the rows. Values of all
    keys are in one space; null keys bind nothing.
    """
    left, taken = scratch.save(df, "left"), None
    while not left.isEmpty():
        held = left.select(order, F.explode(F.array(*keys)).alias("k_")).where("k_ is not null").distinct()
        held = scratch.save(held, "held")
        first = held.groupBy("k_").agg(F.min(order).alias("first_"))
        later = held.join(first, "k_").where(F.col(order) > F.col("first_")).select(order).distinct()
        now = left.join(later, order, "left_anti")
        taken = scratch.save(now if taken is None else taken.unionByName(now), "taken")
        used = scratch.save(taken.select(F.explode(F.array(*keys)).alias("k_")).where("k_ is not null").distinct(), "used")
        blocked = sized_join(held, used, ["k_"], "left_semi").select(order).distinct()
        left = scratch.save(left.join(taken.select(order), order, "left_anti").join(blocked, order, "left_anti"), "left")
    return taken if taken is not None else df.limit(0)
