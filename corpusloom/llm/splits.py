"""Splits that keep related records together.

Records are tied by a shared group, or by a shared source that names a single work. Minimum labels spread over the bipartite
graph of records and these entities: an entity takes the smallest key of its records, a record the smallest label of its
entities. Labels that meet in a record are then contracted, the larger hooked to the smallest it meets, with a shortcut over
two hops, until no two labels meet; the rounds grow with the logarithm of the longest chain. Whole sets are assigned to
splits afterwards: the largest one by one where they suit best, the others dealt out along an order that brings like sets
together, and then sets of one label are moved from splits that have too much of it to splits that lack it.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.runtime import Scratch, pick, sized_join

#: Blanks, control characters and format characters that do not count in names.
BLANKS = r"[\s\p{Z}\p{Cc}\p{Cf}]+"
#: Sets above this part of all rows are placed one by one; there are at most 1 / LARGE of them.
LARGE = 1 / 2000
#: Labels told apart when the largest sets are placed, the commonest; the balancing afterwards tells all labels apart.
LABELS = 1_000
#: Small sets are ordered in parts of about so many.
PART = 100_000


def plain(c: str) -> Column:
    """A name without blanks and letter case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, BLANKS, "")), F.lit(""))


def tied(df: DataFrame, key: str, group: str, source: str, *further: str) -> DataFrame:
    """(k, g, s, further columns): s is null unless the source names a single work, which has text on both sides of a colon."""
    s = plain("s")
    rows = pick(df, k=key, g=group, s=source, **{c: c for c in further})
    return rows.select("k", plain("g").alias("g"), F.when(s.rlike("^[^:]+:.+"), s).alias("s"), *further)


def related_sets(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, s, root) for the distinct pairs of classes (g, s, low), in which low is the smallest key; root names the set."""
    pairs = classes.groupBy("g", "s").agg(F.min("low").alias("low"))
    pairs = scratch.save(pairs, "pairs")
    by = {c: scratch.save(pairs.where(f"{c} is not null").groupBy(c).agg(F.min("low").alias(f"l{c}")), f"by_{c}") for c in "gs"}
    for c in "gs":
        pairs = sized_join(pairs, by[c], [c], "left")
    pairs = scratch.save(pairs.select("g", "s", "low", "lg", "ls"), "labelled")
    roots = graph.roots(pairs.where("g is not null and s is not null").select(F.col("lg").alias("u"), F.col("ls").alias("v")), scratch)
    named = pairs.select("g", "s", F.coalesce(F.least("lg", "ls"), "low").alias("label"))
    return scratch.save(sized_join(named, roots, ["label"], "left").select("g", "s", F.coalesce("root", "label").alias("root")), "sets")


def _pair_key() -> Column:
    """One key for a pair of group and source, either of which can be null; names hold no control characters."""
    return F.concat(F.coalesce("g", F.lit("")), F.lit("\x01"), F.coalesce("s", F.lit("")))


def contradictory(df: DataFrame, key: str, group: str, source: str, split: str) -> DataFrame:
    """(key): every record whose related set holds two or more different splits.

    Letter case and blanks in the three names do not count; a null or blank split is unset, a null or blank group ties nothing;
    a record tied to nothing is its own set and never contradictory. Keys must be unique and not null. An empty table gives
    no rows; repeated entities, extra columns and ties are harmless.
    """
    scratch = Scratch(df.sparkSession, "contradictory")
    rows = tied(pick(df, k=key, g=group, s=source, p=split), "k", "g", "s", "p").withColumn("p", plain("p")).where("g is not null or s is not null")
    classes = scratch.save(rows.groupBy("g", "s", "p").agg(F.min("k").alias("low")), "classes")
    sets = related_sets(classes, scratch)
    e = _pair_key().alias("e")
    splits = sized_join(classes.where("p is not null").select(e, "p"), sets.select(e, "root"), ["e"])
    bad = splits.groupBy("root").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("root")
    bad = scratch.save(sized_join(sets.select(e, "root"), scratch.save(bad, "bad"), ["root"], "left_semi").select("e"), "entities")
    return sized_join(rows.select("k", e), bad, ["e"], "left_semi").select(F.col("k").alias(key))


def _flows(shares: dict[str, float]):
    """A function of the rows (label, split, n) of one label: how many rows are to move from split to split, as parts
    (label, split, to, low, high) of the movable rows of the split they are in."""

    def flows(group: pd.DataFrame) -> pd.DataFrame:
        have = dict(zip(group["split"], group["n"]))
        total = sum(have.values())
        over = {s: have.get(s, 0) - part * total for s, part in shares.items()}
        out = []
        for s in shares:
            at = 0
            for t in shares:
                n = int(round(min(over[s], -over[t])))
                if n > 0:
                    out.append((group["label"].iloc[0], s, t, at, at + n))
                    at, over[s], over[t] = at + n, over[s] - n, over[t] + n
        return pd.DataFrame(out, columns=["label", "split", "to", "low", "high"])

    return flows


def _placed(per: DataFrame, wanted: dict[str, int], shares: dict[str, float], large: DataFrame) -> tuple[dict, dict]:
    """The split of each large set, and what each split still misses of each label; per: (root, x, n), large: (root, rows)."""
    missing = {(s, x): part * n for s, part in shares.items() for x, n in wanted.items()}
    parts: dict = {}
    for r in per.join(F.broadcast(large), "root").collect():  # at most 1 / LARGE sets of LABELS labels
        parts.setdefault((-r.rows, r.root), []).append((r.x, r.n))
    placed = {}
    for (_, root), have in sorted(parts.items()):
        # the squared misses per label, as parts of what each split wants, after placing the set there
        def cost(s: str) -> tuple[float, str]:
            return sum(((missing[s, x] - n) ** 2 - missing[s, x] ** 2) / (shares[s] * max(wanted[x], 1)) for x, n in have), s

        s = min(map(cost, shares))[1]
        placed[root] = s
        for x, n in have:
            missing[s, x] -= n
    return placed, missing


def _dealt(small: DataFrame, number: int, scratch: Scratch) -> DataFrame:
    """small (x, order columns, part, rows, h, root) with at: where the middle of each set lies among the rows of its x, in the
    order of the order columns, the part and the hash. Parts are counted first, so that no task orders more than one."""
    by = ["x", "one", "low", "high", "part"]
    sums = small.groupBy(*by).agg(F.sum("rows").alias("n"))
    ahead = sums.withColumn("ahead", F.sum("n").over(Window.partitionBy("x").orderBy(*by[1:])) - F.col("n")).drop("n")
    inside = Window.partitionBy(*by).orderBy("h", "root")
    small = sized_join(small, scratch.save(ahead, "ahead"), by)
    return small.withColumn("at", F.col("ahead") + F.sum("rows").over(inside) - F.col("rows") / 2)


def assign_splits(df: DataFrame, key: str, group: str, source: str, label: str, shares: dict[str, float] | None = None, seed: int = 17) -> DataFrame:
    """(key, set_id, split): every record with the split of its whole related set.

    shares: split -> positive part, default train 0.96, validation 0.02, test 0.02. Sets above LARGE of all rows go, largest
    first, to the split whose missing rows by label they suit best. The rest are ordered by their commonest label, whether they
    have others and which, and a seeded hash, and dealt out along this order in the proportions still missing. Then, label by
    label, sets that hold nothing else move from splits with too many of its rows to those with too few, so that what remains
    of the deviation is less than a set, or due to large or mixed sets that no others make up for; see deviation(). Existing
    splits are not read. Nulls as in contradictory(); a null label is a label of its own. Equal input gives equal output on any
    partitioning.
    """
    shares = shares or {"train": 0.96, "validation": 0.02, "test": 0.02}
    total_share = sum(shares.values())
    shares = {k: v / total_share for k, v in shares.items()}
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "splits")
    rows = tied(pick(df, k=key, g=group, s=source, label=label), "k", "g", "s", "label").withColumn("label", F.coalesce(F.lower(F.trim("label")), F.lit("")))
    e = _pair_key()
    rows = rows.withColumn("e", F.when(F.col("g").isNull() & F.col("s").isNull(), F.concat(F.lit("\x02"), F.col("k").cast("string"))).otherwise(e))
    classes = scratch.save(rows.groupBy("e", "g", "s", "label").agg(F.min("k").alias("low"), F.count("*").alias("n")), "classes")
    sets = related_sets(classes.where("g is not null or s is not null"), scratch)
    known = scratch.save(sets.select(e.alias("e"), "root"), "known")
    counts = sized_join(classes, known, ["e"], "left").withColumn("root", F.coalesce("root", "low"))
    counts = scratch.save(counts.groupBy("root", "label").agg(F.sum("n").alias("n")), "counts")
    by_label = counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS - 1).collect()
    total = counts.agg(F.sum("n")).first()[0] or 0
    named = scratch.save(spark.createDataFrame([(r.label, r.label) for r in by_label], "label string, x string"), "named")
    stratum = F.coalesce("x", F.lit("\x01other"))
    wanted = {r.label: r.n for r in by_label} | {"\x01other": total - sum(r.n for r in by_label)}
    per = sized_join(counts, named, ["label"], "left").groupBy("root", stratum.alias("x")).agg(F.sum("n").alias("n"))
    main = counts.groupBy("root").agg(F.sum("n").alias("rows"), F.max_by("label", F.struct("n", "label")).alias("x"), F.count("*").alias("labels"), F.min("label").alias("low"), F.max("label").alias("high"))
    whole = scratch.save(main.withColumn("h", F.xxhash64(F.lit(seed), F.col("root"))), "whole")
    placed, missing = _placed(per, wanted, shares, whole.where(F.col("rows") > LARGE * total).select("root", "rows"))

    number = max(1, -(-whole.count() // PART))
    small = whole.where(F.col("rows") <= LARGE * total).withColumn("part", F.pmod(F.shiftright("h", 20), F.lit(number))).withColumn("one", F.col("labels") == 1)
    # of every stratum the cuts between splits, from what is still missing there
    cuts = []
    for x in wanted:
        room = {s: max(missing[s, x], 0.0) for s in shares}
        at, all_ = 0.0, sum(room.values())
        for s in shares:
            at += room[s] / all_ if all_ else shares[s]
            cuts.append((x, s, at))
    names = list(shares)
    bounds = {x: [c for y, _, c in cuts if y == x] for x in wanted}
    cuts = scratch.save(spark.createDataFrame([(x, b) for x, b in bounds.items()], "x string, cuts array<double>"), "cuts")
    dealt = sized_join(_dealt(small, number, scratch), cuts, ["x"], "left")
    dealt = dealt.withColumn("cuts", F.coalesce("cuts", F.lit(bounds["\x01other"])))
    # one turn of the wheel for each row that the smallest split is due, beginning where a hash of the label says
    turn = F.col("at") * min(shares.values()) + F.pmod(F.xxhash64(F.lit(seed), "x"), F.lit(1000)) / 1000.0
    spot = turn - F.floor(turn)
    choice = reduce(lambda rest, i: F.when(spot < F.col("cuts")[i], names[i]).otherwise(rest), reversed(range(len(names) - 1)), F.lit(names[-1]))
    first = dealt.select("root", choice.alias("split"), "rows", F.when(F.col("one"), F.col("x")).alias("only"), "h", "part")
    if placed:
        large = spark.createDataFrame([(r, s) for r, s in placed.items()], f"root {first.schema['root'].dataType.simpleString()}, split string")
        first = first.unionByName(large, allowMissingColumns=True)
    first = scratch.save(first, "first")

    have = counts.join(first.select("root", "split"), "root").groupBy("label", "split").agg(F.sum("n").alias("n"))
    moves = scratch.save(have.groupBy("label").applyInPandas(_flows(shares), "label string, split string, to string, low bigint, high bigint"), "moves")
    movable = first.where("only is not null").withColumnRenamed("only", "label")
    movable = sized_join(movable, scratch.save(moves.groupBy("label", "split").agg(F.max("high").alias("most")), "most"), ["label", "split"])
    sums = movable.groupBy("label", "split", "part").agg(F.sum("rows").alias("n"))
    ahead = sums.withColumn("ahead", F.sum("n").over(Window.partitionBy("label", "split").orderBy("part")) - F.col("n")).drop("n")
    # only parts that some move reaches are ordered
    movable = sized_join(movable, scratch.save(ahead, "ahead_moves"), ["label", "split", "part"]).where("ahead < most")
    movable = movable.withColumn("end", F.col("ahead") + F.sum("rows").over(Window.partitionBy("label", "split", "part").orderBy("rows", "h", "root")))
    moved = sized_join(movable, moves, ["label", "split"]).where((F.col("end") <= F.col("high")) & (F.col("end") - F.col("rows") >= F.col("low"))).select("root", "to")
    chosen = scratch.save(first.select("root", "split").join(moved, "root", "left").select("root", F.coalesce("to", "split").alias("split")), "chosen")

    found = scratch.save(sized_join(known, chosen, ["root"]).select("e", "root", "split"), "found")
    alone = chosen.select(F.concat(F.lit("\x02"), F.col("root").cast("string")).alias("e"), F.col("root"), "split")
    lone, bound = rows.where("g is null and s is null"), rows.where("g is not null or s is not null")
    out = sized_join(bound.select("k", "e"), found, ["e"]).unionByName(lone.select("k", "e").join(alone, "e"))
    return out.select(F.col("k").alias(key), F.col("root").alias("set_id"), "split")


def deviation(df: DataFrame, key: str, label: str, assigned: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(label, split, records, wanted, deviation): how far each split's records of each label are from its share of them."""
    shares = shares or {"train": 0.96, "validation": 0.02, "test": 0.02}
    whole = sum(shares.values())
    rows = pick(df, k=key, label=label).select("k", F.coalesce(F.lower(F.trim("label")), F.lit("")).alias("label"))
    counts = rows.join(assigned.select(F.col(key).alias("k"), "split"), "k").groupBy("label", "split").agg(F.count("*").alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("have"))  # a few splits
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(x / whole).alias("part")) for s, x in shares.items()]))
    out = totals.select("label", "all", "have", parts.alias("p")).select("label", "p.split", F.coalesce(F.col("have")[F.col("p.split")], F.lit(0)).alias("records"), (F.col("all") * F.col("p.part")).alias("wanted"))
    return out.withColumn("deviation", F.col("records") - F.col("wanted"))
