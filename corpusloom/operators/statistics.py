"""Bootstrap uncertainty, paired and crossed comparisons, gates, distributions, sparse projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import METRICS
from corpusloom.runtime import Scratch, sized_join

#: Groups whose means every task of a bootstrap holds.
GROUPS = 2_000_000
# fixed values: multipliers of the draws' hash
A, B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def drawn(repeat: np.ndarray | int, slots: int, n: int, seed: int) -> np.ndarray:
    """Places in range(n) for slots 0 to slots - 1 of a repeat: a hash of repeat, slot and seed modulo n."""
    x = (np.uint64(seed) << np.uint64(48)) + (np.uint64(repeat) << np.uint64(32)) + np.arange(slots, dtype=np.uint64)
    h = x * np.uint64(A)
    h = (h ^ h >> np.uint64(32)) * np.uint64(B)
    return ((h ^ h >> np.uint64(29)) % np.uint64(n)).astype(np.int64)


Slice = tuple[str, str]


def _intervals(means: dict[Slice, np.ndarray], names: list[str], spark, repeats: int, seed: int) -> DataFrame:
    """(slice, value, metric, low, high) from repeats over the groups of each slice (rows of means: groups, metrics), crossed
    with runs if there is a third axis. Repeats of all slices are spread over tasks together."""
    keys = sorted(means)

    def resample(frames):
        for f in frames:
            rows = []
            for i in f["id"]:
                (s, v), r = keys[i // repeats], i % repeats
                x = means[s, v]
                mean = x[drawn(r, len(x), len(x), seed)].mean(axis=0)
                if x.ndim == 3:
                    mean = mean[:, drawn(r, x.shape[2], x.shape[2], seed + 1)].mean(axis=1)
                rows += [(s, v, int(r), m, float(y)) for m, y in zip(names, mean)]
            yield pd.DataFrame(rows, columns=["slice", "value", "r", "metric", "x"])

    draws = spark.range(repeats * len(keys)).mapInPandas(resample, "slice string, value string, r bigint, metric string, x double")
    order = Window.partitionBy("slice", "value", "metric").orderBy("x", "r")
    at = draws.withColumn("i", F.row_number().over(order))
    pick = lambda f: F.max(F.when(F.col("i") == int(f * repeats) + 1, F.col("x")))
    return at.groupBy("slice", "value", "metric").agg(pick(0.025).alias("low"), pick(0.975).alias("high"))


def _means(rows: DataFrame, by: tuple[str, ...] = (), most: int = 1000) -> dict[Slice, tuple[list, np.ndarray]]:
    """Of all rows, and of each value of the columns `by` that is not null, the groups and their means."""
    slices = [F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value"))] + [F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in by]
    long = rows.select("group_id", *METRICS, F.explode(F.array(*slices)).alias("s")).where("s.value is not null")
    per = long.groupBy("s.slice", "s.value", "group_id").agg(*[F.avg(m).alias(m) for m in METRICS]).limit(GROUPS + 1).toPandas()
    if len(per) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    if not len(per):
        raise ValueError("no queries")
    out = {}
    for key, part in per.groupby(["slice", "value"], sort=True):
        part = part.sort_values("group_id", na_position="first")
        out[key] = part["group_id"].tolist(), part[list(METRICS)].to_numpy(float)
    if len(out) > most + 1:
        raise ValueError(f"more than {most} values of {', '.join(by)}")
    return out


def _summaries(rows: DataFrame, by: tuple[str, ...], repeats: int, seed: int, most: int = 1000) -> DataFrame:
    """(slice, value, metric, groups, mean, low, high) in one pass over the rows and one over all draws."""
    if repeats < 40:
        raise ValueError("at least 40 repeats")
    means = {k: x for k, (_, x) in _means(rows, by, most).items()}
    spark = rows.sparkSession
    middle = [(s, v, m, len(x), float(y)) for (s, v), x in means.items() for m, y in zip(METRICS, x.mean(axis=0))]
    middle = spark.createDataFrame(middle, "slice string, value string, metric string, groups bigint, mean double")
    return middle.join(_intervals(means, list(METRICS), spark, repeats, seed), ["slice", "value", "metric"])


def summarize(rows: DataFrame, repeats: int = 2000, seed: int = 17) -> DataFrame:
    """(metric, groups, mean, low, high): mean over groups of equal weight, and its 95% bootstrap percentiles.

    Groups are resampled whole. The group means, at most GROUPS, travel to the tasks; raises beyond that and below 40 repeats.
    """
    return _summaries(rows, (), repeats, seed).drop("slice", "value")


def differences(reference: DataFrame, candidate: DataFrame, strict: bool = True) -> DataFrame:
    """(query_id, group_id, bucket, domain, metrics): candidate minus reference of each query.

    strict raises unless both hold the same queries once, in the same groups, with finite metrics.
    """
    a = reference.select("query_id", F.col("group_id").alias("g_"), *[F.col(m).alias(f"{m}_") for m in METRICS], F.lit(1).alias("l_"))
    both = candidate.withColumn("r_", F.lit(1)).join(a, "query_id", "full_outer")
    if strict:
        finite = F.lit(True)
        for m in METRICS:
            finite = finite & ~F.isnan(m) & ~F.isnan(f"{m}_") & (F.abs(F.col(m) - F.col(f"{m}_")) < float("inf"))
        good = F.coalesce(F.col("l_").isNotNull() & F.col("r_").isNotNull() & (F.col("g_") == F.col("group_id")) & finite, F.lit(False))
        found = both.agg(F.count_if(~good).alias("bad"), F.count("*").alias("n"), F.countDistinct("query_id").alias("ids")).first()
        if found.bad or found.n != found.ids:
            raise ValueError("both sides need the same queries once, in the same groups, with finite metrics")
    both = both.where("l_ is not null and r_ is not null")
    return both.select("query_id", "group_id", "bucket", "domain", *[(F.col(m) - F.col(f"{m}_")).alias(m) for m in METRICS])


def compare(reference: DataFrame, candidate: DataFrame, by: tuple[str, ...] = ("bucket", "domain"), repeats: int = 2000, seed: int = 17, most: int = 1000) -> DataFrame:
    """(slice, value, metric, groups, mean, low, high) of the paired difference over all queries and in each value of `by`.

    All slices are resampled in one job. Raises for more than `most` values in all.
    """
    return _summaries(differences(reference, candidate), by, repeats, seed, most)


def crossed(reference: DataFrame, candidate: DataFrame, repeats: int = 2000, seed: int = 17) -> DataFrame:
    """(metric, groups, runs, mean, low, high): paired differences with groups and runs resampled independently.

    Both tables hold a column run; every run must have the same queries in the same groups.
    """
    runs = sorted(r[0] for r in reference.select("run").distinct().collect())
    if not runs or runs != sorted(r[0] for r in candidate.select("run").distinct().collect()) or repeats < 40:
        raise ValueError("both sides need the same runs, and 40 repeats at least")
    layers, groups = [], None
    for r in runs:
        names, means = _means(differences(reference.where(F.col("run") == r), candidate.where(F.col("run") == r)))["all", "all"]
        if groups is not None and names != groups:
            raise ValueError("groups differ across runs")
        groups = names
        layers.append(means)
    means = np.stack(layers, axis=2)
    spark = reference.sparkSession
    middle = means.mean(axis=(0, 2))
    rows = spark.createDataFrame([(m, len(groups), len(runs), float(x)) for m, x in zip(METRICS, middle)], "metric string, groups bigint, runs bigint, mean double")
    return rows.join(_intervals({("all", "all"): means}, list(METRICS), spark, repeats, seed).drop("slice", "value"), "metric")


def gates(comparisons: DataFrame, rules: dict[str, float]) -> DataFrame:
    """comparisons (arm, budget, mean, low, english, latency, memory) with a column for each gate, and passes for all of them.

    rules: minimum_gain, interval_above, english_regression, latency, memory; above_unchanged adds a gate on a column
    unchanged.
    """
    named = {
        "gain": F.col("mean") >= rules["minimum_gain"],
        "interval": F.col("low") > rules["interval_above"],
        "english_ok": F.col("english") >= -rules["english_regression"],
        "latency_ok": F.col("latency") <= rules["latency"],
        "memory_ok": F.col("memory") <= rules["memory"],
    }
    if "above_unchanged" in rules:
        named["gain_over_unchanged"] = F.col("unchanged") > rules["above_unchanged"]
    out = comparisons.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in named.items()})
    passes = F.lit(True)
    for k in named:
        passes = passes & F.col(k)
    return out.withColumn("passes", passes)


def decide(gated: DataFrame, budgets: int, first: str) -> DataFrame:
    """One row (arm): of the arms that pass in all budgets the one of highest mean in the budget `first`, else 'unchanged'."""
    good = gated.groupBy("arm").agg(F.every("passes").alias("ok"), F.countDistinct("budget").alias("n"), F.max(F.when(F.col("budget") == first, F.col("mean"))).alias("mean"))
    best = good.where((F.col("ok")) & (F.col("n") == budgets)).agg(F.max(F.struct("mean", "arm")).alias("x"))
    return best.select(F.coalesce("x.arm", F.lit("unchanged")).alias("arm"))


def distribution(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """(group, n, p50, p95, p99): interpolated median and nearest-rank tails of positive finite values; raises for others."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.col(value) <= 0) | (F.col(value) == float("inf"))
    if df.isEmpty() or not df.where(bad).isEmpty():
        raise ValueError("samples must be positive and finite")
    tail = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return df.groupBy(*(group or [])).agg(F.count("*").alias("n"), F.median(value).alias("p50"), tail(0.95).alias("p95"), tail(0.99).alias("p99"))


def throughput(df: DataFrame, seconds: str, size: str, texts: str) -> DataFrame:
    """df with mb_per_second, texts_per_second and us_per_text of measured work; raises unless all times are positive and finite."""
    bad = F.col(seconds).isNull() | ~(F.col(seconds) > 0) | (F.col(seconds) == float("inf"))
    if not df.where(bad).isEmpty():
        raise ValueError("times must be positive and finite")
    return df.withColumns({"mb_per_second": F.col(size) / 1e6 / F.col(seconds), "texts_per_second": F.col(texts) / F.col(seconds), "us_per_text": F.col(seconds) * 1e6 / F.col(texts)})


def sparsemax(df: DataFrame, row: str, column: str, score: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, column, weight): each row's scores projected on the simplex; weights of 0 are kept.

    The threshold follows from the cumulative sum of the falling scores.
    """
    order = Window.partitionBy(row).orderBy(F.desc(score), column)
    at = df.withColumn("i_", F.row_number().over(order)).withColumn("s_", F.sum(score).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("in_", 1 + F.col("i_") * F.col(score) > F.col("s_"))
    every = Window.partitionBy(row)
    last = F.max(F.when(F.col("in_"), F.struct("i_", "s_"))).over(every)
    at = at.withColumn("t_", (last["s_"] - 1) / last["i_"])
    return at.select(row, column, *keep, F.greatest(F.col(score) - F.col("t_"), F.lit(0.0)).alias("weight"))


def ppmi(df: DataFrame, ids: str, window: int = 2, columns: int = 512) -> DataFrame:
    """(id, col, value): positive pointwise mutual information of ids with their neighbours, hashed to columns; zeros left out."""
    from corpusloom.functions.tokenizer import token_hash

    pairs = None
    for k in range(1, window + 1):
        long = df.where(F.size(ids) > k)
        zipped = F.explode(F.arrays_zip(F.slice(ids, 1, F.size(ids) - k).alias("a"), F.slice(ids, k + 1, F.size(ids)).alias("b"))).alias("p")
        one = long.select(zipped).select(F.explode(F.array(F.struct(F.col("p.a").alias("id"), F.col("p.b").alias("n")), F.struct(F.col("p.b").alias("id"), F.col("p.a").alias("n")))).alias("p")).select("p.id", "p.n")
        pairs = one if pairs is None else pairs.unionByName(one)
    counts = pairs.select("id", token_hash("n", columns).alias("col")).groupBy("id", "col").agg(F.count("*").alias("c"))
    rows, cols = counts.groupBy("id").agg(F.sum("c").alias("r")), counts.groupBy("col").agg(F.sum("c").alias("k"))
    total = counts.agg(F.sum("c").alias("t"))
    value = F.log(F.greatest(F.col("c") * F.col("t") / F.greatest(F.col("r") * F.col("k"), F.lit(1)), F.lit(1.0)))
    # at most `columns` column sums and one total are broadcast
    out = counts.join(rows, "id").join(F.broadcast(cols), "col").crossJoin(F.broadcast(total)).select("id", "col", value.alias("value"))
    return out.where("value > 0")


def anchored(contexts: DataFrame, anchors: DataFrame, vectors: DataFrame, first: int = 260) -> DataFrame:
    """(id, vector, support): vectors of new ids as sparse weighted means of those of anchors.

    contexts: (id, col, value) as ppmi() gives them, one vector of unit length for each id once scaled. anchors: (id, old), ids
    that stand for an id of the old vocabulary; vectors: (old, vector). An anchor takes its old vector. Every other id from
    `first` on with contexts takes the mean of the anchors' old vectors, weighted by the sparsemax of its cosines with the
    anchors' contexts; support is how many weigh more than 0. Anchors without contexts are no candidates. Anchors are a part of
    a vocabulary: their contexts and vectors are sent to the tasks if they fit, joined by column otherwise.
    """
    scratch = Scratch(contexts.sparkSession, "anchored")
    size = contexts.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
    unit = scratch.save(contexts.join(size.where("size > 0"), "id").select("id", "col", (F.col("value") / F.col("size")).alias("x")), "unit")
    own = scratch.save(anchors.select("id", "old").join(unit.select("id").distinct(), "id", "left_semi"), "own")
    if own.isEmpty():
        raise ValueError("no anchor has a context")
    known = scratch.save(unit.join(own, "id").select(F.col("id").alias("anchor"), "old", "col", F.col("x").alias("y")), "known")
    asked = unit.where(F.col("id") >= first).join(anchors.select("id"), "id", "left_anti")
    scores = sized_join(asked, known, ["col"]).groupBy("id", "anchor", "old").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    scores = scratch.save(scores, "scores")
    total = own.count()
    # where the scores sum to less than 1 the threshold is negative, and each anchor, met or not, gains the rest in equal parts
    sums = asked.select("id").distinct().join(scores.groupBy("id").agg(F.sum("score").alias("c")), "id", "left").select("id", F.coalesce("c", F.lit(0.0)).alias("c"))
    sums = scratch.save(sums, "sums")
    rest = sums.where("c < 1").select("id", ((1 - F.col("c")) / total).alias("rest"))
    few = scores.join(rest.select("id"), "id", "left_semi").select("id", "anchor", "old", F.col("score").alias("weight"))
    many = sparsemax(scores.join(rest.select("id"), "id", "left_anti"), "id", "anchor", "score", keep=("old",)).where("weight > 0")
    old = own.join(vectors.select("old", "vector"), "old").select("id", "old", F.posexplode("vector").alias("i", "v"))
    long = few.unionByName(many).join(vectors.select("old", "vector"), "old").select("id", "anchor", F.posexplode(F.transform("vector", lambda v: v * F.col("weight"))).alias("i", "v"))
    whole = old.groupBy("i").agg(F.sum("v").alias("s"))  # one row for each place of a vector
    more = rest.join(F.broadcast(whole)).select("id", F.lit(None).cast(long.schema["anchor"].dataType).alias("anchor"), "i", (F.col("rest") * F.col("s")).alias("v"))
    mixed = long.unionByName(more).groupBy("id", "i").agg(F.sum("v").alias("v"), F.countDistinct("anchor").alias("n"))
    mixed = mixed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p.v).alias("vector"), F.max("n").alias("n"))
    mixed = mixed.join(rest, "id", "left").select("id", "vector", F.when(F.col("rest").isNull(), F.col("n")).otherwise(total).alias("support"))
    given = anchors.join(vectors, "old").select("id", F.col("vector").cast("array<double>").alias("vector"), F.lit(1).cast("bigint").alias("support"))
    return given.unionByName(mixed.select("id", "vector", "support"))


def l2(vector: str) -> Column:
    """A vector scaled to unit length; one of no length stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, vector): the unit-length mean of each group's vectors, place by place."""
    long = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return long.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("v")).select(group, l2("v").alias("vector"))
