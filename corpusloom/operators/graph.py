"""Connected components and minimum spanning forests by rounds of hooking and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import Scratch, sized_join

#: Edges, counted before, that one task finishes instead of some more rounds of small jobs; every number gives the same roots.
FEW = 5_000


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _propagated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Minimum labels of a bounded number of edges, spread along edges and to the labels that meet, with shortcuts."""
    edges = pd.concat(list(frames) or [pd.DataFrame({"u": [], "v": []})])
    ids, place = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
    u, v = place[: len(edges)], place[len(edges) :]
    label, before = np.arange(len(ids)), None
    while before is None or (label != before).any():
        before, a, b = label, label[u], label[v]
        label = label.copy()
        for to, x in ((u, b), (v, a), (a, b), (b, a)):
            np.minimum.at(label, to, x)
        label = label[label]
    moved = label != np.arange(len(ids))
    yield pd.DataFrame({"label": ids[moved], "root": ids[label[moved]]})


def roots(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """(label, root): of every label of the edges (u, v) the smallest it is linked to; roots themselves are left out.

    In each round a label hooks to the smallest it meets, looks one hop further, and the edges are rewritten; their number
    falls geometrically. Once at most `few` are left, one task goes through the remaining rounds. Every round's tables are
    written to the shared folder.
    """
    edges, out = scratch.save(_ordered(edges), "edges"), None
    kind = edges.schema["u"].dataType.simpleString()
    while not edges.isEmpty():
        if finish := edges.limit(few + 1).count() <= few:
            hook = scratch.save(edges.coalesce(1).mapInPandas(_propagated, f"label {kind}, root {kind}").select(F.col("label").alias("u"), F.col("root").alias("m")), "jump")
        else:
            hook = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m")), "hook")
            over = hook.select(F.col("u").alias("m"), F.col("m").alias("far"))
            hook = scratch.save(sized_join(hook, over, ["m"], "left").select("u", F.coalesce("far", "m").alias("m")), "jump")
            for end in ("u", "v"):
                edges = sized_join(edges, hook.select(F.col("u").alias(end), "m"), [end], "left").withColumn(end, F.coalesce("m", end)).drop("m")
        new = hook.select(F.col("u").alias("label"), F.col("m").alias("root"))
        if out is not None:
            moved = sized_join(out, hook.withColumnRenamed("u", "root"), ["root"], "left")
            new = new.unionByName(moved.select("label", F.coalesce("m", "root").alias("root")))
            # a label two hops away can hook again later; both its entries end at the smallest label of the component
            new = new.groupBy("label").agg(F.min("root").alias("root"))
        out = scratch.save(new, "roots")
        if finish:
            break
        edges = scratch.save(_ordered(edges), "edges")
    return out if out is not None else edges.select(F.col("u").alias("label"), F.col("v").alias("root"))


def spanning_forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges (u, v, weight columns) of the minimum spanning forest; all columns after u and v order them and must be unique.

    Boruvka's rounds: every component picks its least outgoing edge, picked edges are contracted, at least halving the number
    of components that still have one.
    """
    weight = [c for c in edges.columns if c not in ("u", "v")]
    live = scratch.save(edges.where("u <> v").select(F.struct("u", "v", *weight).alias("e"), F.col("u").alias("a"), F.col("v").alias("b"), F.struct(*weight).alias("w")), "live")
    picked = None
    while not live.isEmpty():
        both = live.select("a", "b", "w", "e").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "e"))
        best = both.groupBy("a").agg(F.min(F.struct("w", "e", "b")).alias("x")).select("a", "x.e", "x.b")
        best = scratch.save(best, "best")
        chosen = best.select("e").distinct()
        picked = scratch.save(chosen if picked is None else picked.unionByName(chosen), "picked")
        to = roots(best.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
        to = scratch.save(to, "to")
        for end in ("a", "b"):
            live = sized_join(live, to.withColumnRenamed("label", end), [end], "left").withColumn(end, F.coalesce("root", end)).drop("root")
        live = scratch.save(live.where("a <> b"), "live")
    return picked.select("e.*") if picked is not None else edges.limit(0)
