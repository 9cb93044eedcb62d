"""Consensus of several annotators: a mean-field variational confusion model.

Each item has a latent grade; each annotator a confusion matrix. Class proportions and matrix rows have Dirichlet priors. A
round is one pass of group-bys: expected counts per annotator and grade, digamma of these, then the posterior of every item.
The state between rounds is one row per annotator and grade, written to the shared folder.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import Scratch, fits_broadcast, pick

#: Pseudo-counts: of a matrix row on its own grade and elsewhere, and of each class.
RIGHT, WRONG, CLASS = 2.0, 0.7, 1.0
#: Part of the votes whose change of class ends the fit, and rounds after which it ends with a warning.
CHANGE, ROUNDS = 1e-4, 200
#: Votes of one item above which its sums are not made in one task.
HOT = 100_000
#: Names under which the original grade and the class proportions take part.
ORIGINAL, CLASSES = "\x01original", "\x02classes"


def _digamma(x: str) -> str:
    """SQL of digamma(): one string is parsed at once, where columns would be put together call by call."""
    back = " + ".join(f"1 / ({x} + {i})" for i in range(6))
    y = f"({x} + 6)"
    z = f"(1 / ({y} * {y}))"
    return f"(ln{y} - 0.5D / {y} - {z} * (1 / 12D - {z} * (1 / 120D - {z} * (1 / 252D - {z} / 240D))) - ({back}))"


def digamma(x: Column) -> Column:
    """The asymptotic series at x + 6, carried back by recurrence; exact to 1e-9 for x > 0."""
    y = x + 6
    back = reduce(lambda a, b: a + b, [1 / (x + i) for i in range(6)])
    z = 1 / (y * y)
    return F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240))) - back


def trigamma(x: Column) -> Column:
    y = x + 6
    back = reduce(lambda a, b: a + b, [1 / ((x + i) * (x + i)) for i in range(6)])
    z = 1 / (y * y)
    return 1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30))) + back


def latest_grades(df: DataFrame, item: list[str], annotator: str, grade: str, at: str, original: str | None = None) -> DataFrame:
    """(item columns, annotator, grade): of each annotator's grades of an item the latest; the highest if several are as late.

    A null latest grade is unresolved and left out, as are rows without annotator. With original, the first grade of each item
    joins as annotator ORIGINAL, the least one if it is given differently in several rows.
    """
    df = pick(df, **{i: i for i in item}, annotator=annotator, grade_=grade, at_=at, **({"original_": original} if original else {}))
    last = df.where("annotator is not null").groupBy(*item, "annotator").agg(F.max(F.struct("at_", "grade_")).alias("last"))
    out = last.select(*item, F.col("annotator").cast("string").alias("annotator"), F.col("last.grade_").alias("grade"))
    if original:
        first = df.groupBy(*item).agg(F.min("original_").alias("grade"))
        out = out.unionByName(first.select(*item, F.lit(ORIGINAL).alias("annotator"), "grade"))
    return out.where("grade is not null")


def agreement(votes: DataFrame, item: list[str], grades: list[int]) -> DataFrame:
    """(items, votes, alpha): Krippendorff's nominal alpha over items of two votes or more; null if there is one grade only.

    votes: (item columns, annotator, grade), no repeats. It is a matter of counts; no model is fitted.
    """
    n = [f"n{j}" for j in range(len(grades))]
    counts = [F.sum((F.col("grade") == g).cast("long")).alias(c) for g, c in zip(grades, n)]
    per = votes.where(F.col("grade").isin(grades)).groupBy(*item).agg(*counts, F.count("*").alias("m")).where("m > 1")
    apart = reduce(lambda x, y: x + y, [F.col(c) * (F.col("m") - F.col(c)) for c in n]) / (F.col("m") - 1)
    total = per.agg(F.count("*").alias("items"), F.sum("m").alias("votes"), F.sum(apart).alias("seen"), *[F.sum(c).alias(c) for c in n])
    chance = reduce(lambda x, y: x + y, [F.col(c) * (F.col("votes") - F.col(c)) for c in n]) / (F.col("votes") - 1)
    return total.select("items", F.coalesce("votes", F.lit(0)).alias("votes"), F.when(chance > 0, 1 - F.col("seen") / chance).alias("alpha"))


class Consensus:
    """The fitted model; items, annotators and agreement() read it. votes: (item columns, annotator, grade), no repeats.

    Class proportions take part as one more annotator, CLASSES, with a vote on every item, so that a round is one pass: the
    weights of each vote summed by item, posteriors from these, and their sums by annotator and grade. rounds and moved say how
    many rounds were gone through and which part of the votes changed its class in the last one; converged, whether it was less
    than CHANGE.
    """

    def __init__(self, votes: DataFrame, item: list[str], grades: list[int], scratch: Scratch, hot: int = HOT, rounds: int = ROUNDS):
        self.item, self.grades, self.scratch = item, grades, scratch
        self.q, k = [f"q{j}" for j in range(len(grades))], len(grades)
        votes = votes.where(F.col("grade").isin(grades)).select(*item, "annotator", F.col("grade").cast("int").alias("grade"))
        self.votes = scratch.save(votes, "votes")
        most = self.votes.groupBy(*item).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        whole = self.votes.unionByName(self.votes.select(*item).distinct().select(*item, F.lit(CLASSES).alias("annotator"), F.lit(-1).alias("grade")))
        # kept partitioned by item, rounds move votes no more, and lost blocks are read again; with an item too large for one
        # task, sums by item are made map-side and joined back, its rows split by AQE
        self.hot = most > hot
        if not self.hot:
            whole = whole.repartition(*item).sortWithinPartitions(*item).persist(StorageLevel.MEMORY_AND_DISK)
        own = F.when(F.col("annotator") == CLASSES, 0.0)
        ones = [own.otherwise((F.col("grade") == g).cast("double")).alias(f"l{j}") for j, g in enumerate(grades)]
        summed = self._summed(whole.select(*item, "annotator", "grade", *ones))
        all_ = reduce(lambda x, y: x + y, [F.col(f"s{j}") for j in range(k)])
        level = scratch.save(self._level(summed.select(*item, "annotator", "grade", *[(F.col(f"s{j}") / all_).alias(c) for j, c in enumerate(self.q)]), None), "level")
        small = fits_broadcast(level)
        self.rounds, self.moved, self.converged = 0, 1.0, most == 0
        while self.rounds < rounds and not self.converged:
            posterior = self._posterior(whole, level, small)
            level = scratch.save(self._level(posterior, level, small), "level")
            found = level.where(F.col("annotator") != CLASSES).agg(F.sum("moved").alias("moved"), F.sum("n").alias("n")).first()
            self.rounds += 1
            self.moved = found.moved / found.n / 2
            self.converged = self.moved < CHANGE
        posterior = self._posterior(whole, level, small).where(F.col("annotator") == CLASSES).select(*item, *self.q)
        self.posterior = scratch.save(posterior, "posterior")
        whole.unpersist()
        if not self.converged:
            warnings.warn(f"after {rounds} rounds {self.moved:.2g} of the votes still change their class", stacklevel=2)

    def _summed(self, rows: DataFrame) -> DataFrame:
        """rows with s0, s1, ...: the sums of l0, l1, ... over each item."""
        k = len(self.grades)
        if not self.hot:
            every = Window.partitionBy(*self.item)
            return rows.select("*", *[F.sum(f"l{j}").over(every).alias(f"s{j}") for j in range(k)])
        return rows.join(rows.groupBy(*self.item).agg(*[F.sum(f"l{j}").alias(f"s{j}") for j in range(k)]), self.item)

    def _posterior(self, whole: DataFrame, level: DataFrame, small: bool) -> DataFrame:
        """Every vote with the posterior of its item."""
        k, names = len(self.grades), ["annotator", "grade", *[f"l{j}" for j in range(len(self.grades))]]
        known = F.broadcast(level.select(*names)) if small else level.select(*names)
        summed = self._summed(whole.join(known, ["annotator", "grade"]))
        top = F.greatest(*[F.col(f"s{j}") for j in range(k)]) if k > 1 else F.col("s0")
        weights = [F.exp(F.col(f"s{j}") - top) for j in range(k)]
        total = reduce(lambda a, b: a + b, weights)
        return summed.select(*self.item, "annotator", "grade", *[(w / total).alias(c) for w, c in zip(weights, self.q)])

    def _level(self, posterior: DataFrame, before: DataFrame | None, small: bool = True) -> DataFrame:
        """(annotator, grade, l, m, n, moved): the weight of such a vote for each class, the mass it follows from, and by how
        much this differs from that of the round before."""
        k = len(self.grades)
        mass = posterior.groupBy("annotator", "grade").agg(*[F.sum(c).alias(f"m{j}") for j, c in enumerate(self.q)], F.count("*").alias("n"))
        mass = mass.selectExpr("*", *[f"sum(m{j}) over (partition by annotator) as t{j}" for j in range(k)])
        logs = []
        for j, g in enumerate(self.grades):
            prior = f"(m{j} + if(grade = {g}, {RIGHT}D, {WRONG}D))"
            of = f"{_digamma(prior)} - {_digamma(f'(t{j} + {RIGHT + (k - 1) * WRONG}D)')}"
            logs.append(f"if(annotator = '{CLASSES}', {_digamma(f'(m{j} + {CLASS}D)')}, {of}) as l{j}")
        level = mass.selectExpr("annotator", "grade", *logs, *[f"m{j}" for j in range(k)], "n")
        if before is None:
            return level.withColumn("moved", F.lit(1.0))
        old = before.select("annotator", "grade", *[F.col(f"m{j}").alias(f"o{j}") for j in range(k)])
        moved = reduce(lambda a, b: a + b, [F.abs(F.col(f"m{j}") - F.col(f"o{j}")) for j in range(k)])
        return level.join(F.broadcast(old) if small else old, ["annotator", "grade"]).select(*level.columns, moved.alias("moved"))

    def items(self) -> DataFrame:
        """(item columns, grade, probability, votes, agreement): the likeliest grade, of equally likely ones the least.

        agreement: part of the pairs of votes that agree; null for a single vote.
        """
        counts = [F.sum((F.col("grade") == g).cast("long")).alias(f"n{j}") for j, g in enumerate(self.grades)]
        seen = self.votes.groupBy(*self.item).agg(*counts, F.count("*").alias("votes"))
        pairs = reduce(lambda a, b: a + b, [F.col(f"n{j}") * (F.col(f"n{j}") - 1) for j in range(len(self.grades))])
        best = F.greatest(*self.q) if len(self.q) > 1 else F.col(self.q[0])
        grade = F.coalesce(*[F.when(F.col(c) == best, F.lit(g)) for g, c in zip(self.grades, self.q)])
        out = self.posterior.join(seen, self.item)
        agreement = F.when(F.col("votes") > 1, pairs / (F.col("votes") * (F.col("votes") - 1)))
        return out.select(*self.item, grade.alias("grade"), best.alias("probability"), "votes", agreement.alias("agreement"))

    def annotators(self) -> DataFrame:
        """(annotator, items, wrong, reliability, low, high): expected number of wrong grades, and the probability of a right
        one with its 95% interval on the logit scale, from the posterior counts and the prior."""
        right = reduce(lambda rest, x: F.when(F.col("grade") == x[0], F.col(x[1])).otherwise(rest), zip(self.grades, self.q), F.lit(0.0))
        sums = self.votes.join(self.posterior, self.item).groupBy("annotator").agg(F.count("*").alias("items"), F.sum(right).alias("right"))
        a, b = F.col("right") + RIGHT, F.col("items") - F.col("right") + (len(self.q) - 1) * WRONG
        middle, wide = digamma(a) - digamma(b), 1.96 * F.sqrt(trigamma(a) + trigamma(b))
        logistic = lambda x: 1 / (1 + F.exp(-x))
        return sums.select("annotator", "items", (F.col("items") - F.col("right")).alias("wrong"), (a / (a + b)).alias("reliability"), logistic(middle - wide).alias("low"), logistic(middle + wide).alias("high"))

    def agreement(self) -> DataFrame:
        """agreement() of the votes."""
        return agreement(self.votes, self.item, self.grades)


def fit(df: DataFrame, item: list[str], annotator: str, grade: str, at: str, original: str | None = None, grades: tuple[int, ...] = (0, 1, 2)) -> Consensus:
    """The model over the latest grades of df; see latest_grades() for nulls, ties and repeats. Grades outside grades are left out."""
    scratch = Scratch(df.sparkSession, "consensus")
    return Consensus(latest_grades(df, item, annotator, grade, at, original), item, list(grades), scratch)
