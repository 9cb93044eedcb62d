"""Mixing sources to target weights by pivotal dependent rounding.

The mix is as large as the target shares and caps allow. Every record of a source is due the same number of uses, which is
whole and fractional; the fractions are rounded so that the source's tokens stay exact: of two fractional records one gains
and the other loses mass of equal size in tokens, at random and fairly, until one of them is whole. Records meet in buckets
of bounded size, the one left over in each meets those of other buckets, and so on up a reduction tree to one per source.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import Scratch, need, pick

#: Where the vocabularies of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
#: Records of a bucket, and left-over records that meet in the next level.
BUCKET, FAN = 4_000, 256
#: Sources of a mixture; more are refused, as the mixture is held by the driver.
SOURCES = 100_000
WORDS = 500_000
EDGE = 1e-9


def public_counts(df: DataFrame, text: str, path: str, out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of text under a byte-level BPE of ranks (a .tiktoken file); null text has 0.

    Text is cut before single blanks, where no token reaches over; what lies between is counted once per worker.
    """
    need(df, text)
    df = df.drop(out)
    names, state = df.columns, {}

    def run(batches):
        import tiktoken

        if "encoding" not in state:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            # fixed value: the pattern by which byte-level BPE of this kind parts text
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            state["encoding"] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        count = state["encoding"].encode_ordinary
        known: dict[str, int] = {}
        for b in batches:
            made = []
            for t in b.column(names.index(text)).to_pylist():
                if not t:
                    made.append(0)
                    continue
                if "  " in t or any(c in t for c in "\t\r\x0b\x0c\x85\xa0") or t[-1] == " " or " \n" in t or "\n " in t:
                    made.append(len(count(t)))
                    continue
                n = 0
                for i, w in enumerate(t.split(" ")):
                    w = f" {w}" if i else w
                    c = known.get(w)
                    if c is None:
                        if len(known) >= WORDS:
                            known.clear()
                        c = known[w] = len(count(w))
                    n += c
                made.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.int64())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, {out} bigint")


def pivot(keys: list, sizes: np.ndarray, parts: np.ndarray, seed: str) -> tuple[np.ndarray, int]:
    """Round the fractions one after the other; returns them, and the place of the one still fractional, -1 if there is none.

    The sum of sizes times fractions stays as it was, and every fraction keeps its expectation. The order is that of the keys,
    the draws follow from the seed, so a task that is run again comes to the same.
    """
    parts = parts.astype(float).copy()
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big"))
    draws, open_ = rng.random(len(parts)), -1
    for turn, i in enumerate(sorted(range(len(keys)), key=keys.__getitem__)):
        if not EDGE < parts[i] < 1 - EDGE:
            parts[i] = round(parts[i])
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b = open_, i
        up = min(sizes[a] * (1 - parts[a]), sizes[b] * parts[b])
        down = min(sizes[a] * parts[a], sizes[b] * (1 - parts[b]))
        move = up if draws[turn] * (up + down) < down else -down
        parts[a] += move / sizes[a]
        parts[b] -= move / sizes[b]
        fractional = [k for k in (a, b) if EDGE < parts[k] < 1 - EDGE]
        for k in (a, b):
            if k not in fractional:
                parts[k] = round(parts[k])
        open_ = fractional[0] if fractional else -1
    return parts, open_


def _settle(seed: str):
    def settle(group: pd.DataFrame) -> pd.DataFrame:
        name = f"{seed}/{group['source'].iloc[0]}/{group['bucket'].iloc[0]}"
        group = group.reset_index(drop=True)
        group["p"], left = pivot(group["k"].tolist(), group["n"].to_numpy(float), group["p"].to_numpy(), name)
        group["open"] = group.index == left
        return group

    return settle


def mix(df: DataFrame, key: str, source: str, tokens: str, mixture: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """(key, source, n_tokens, uses): every record of the mixture's sources with how often the mix uses it, 0 included.

    mixture: (source, target_share, max_repeats). total: tokens of the mix, at most what caps and shares allow, which is the
    default; shares are scaled to sum to 1. A source of the mixture without any tokens makes the shares unreachable; it is
    left out, and the others keep their proportions. Records of no or another source, and of no token, are not used. Keys must
    be unique. uses never exceeds max_repeats.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mixing")
    mixture = pick(mixture, source="source", target_share="target_share", max_repeats="max_repeats")
    wanted = mixture.where("source is not null and target_share > 0 and max_repeats > 0").limit(SOURCES + 1).collect()
    if len(wanted) > SOURCES or len({r.source for r in wanted}) < len(wanted):
        raise ValueError("too many sources, or one given twice")
    rows = pick(df, k=key, source=source, n=tokens).withColumn("n", F.col("n").cast("bigint"))
    # the mixture is at most SOURCES rows, so it may be broadcast
    rows = rows.join(F.broadcast(mixture.where("target_share > 0 and max_repeats > 0").select("source").distinct()), "source", "left_semi")
    rows = scratch.save(rows, "rows")
    have = {r.source: r for r in rows.where("n > 0").groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("records")).collect()}
    wanted = [r for r in wanted if r.source in have]
    whole = sum(r.target_share for r in wanted) or 1.0
    most = min((r.max_repeats * have[r.source].n * whole / r.target_share for r in wanted), default=0.0)
    size = most if total is None else min(total, most)
    rates = [(r.source, size * r.target_share / whole / have[r.source].n, r.max_repeats, 1 + have[r.source].records // BUCKET) for r in wanted]
    plan = spark.createDataFrame(rates, "source string, rate double, cap int, buckets bigint")
    due = rows.join(F.broadcast(plan), "source", "left").withColumn("sure", F.when(F.col("n") > 0, F.least(F.floor(F.col("rate") + EDGE), "cap")).otherwise(0))
    due = due.withColumn("p", F.when((F.col("n") > 0) & (F.col("sure") < F.col("cap")), F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0))).otherwise(0.0))
    due = due.withColumn("sure", F.coalesce("sure", F.lit(0)))
    kind = rows.schema["k"].dataType.simpleString()
    level = due.where(f"p > {EDGE}").select("k", "source", "n", "p", F.pmod(F.xxhash64(F.lit(seed), "k"), "buckets").alias("bucket"))
    done, turn = [], 0
    while True:
        made = level.groupBy("source", "bucket").applyInPandas(_settle(f"{seed}/{turn}"), f"k {kind}, source string, n bigint, p double, bucket bigint, open boolean")
        made = scratch.save(made, f"level{turn}")
        done.append(made.where("not open").select("k", "p"))
        left = made.where("open").select("k", "source", "n", "p", F.floor(F.col("bucket") / FAN).alias("bucket"))
        if left.groupBy("source").count().where("count > 1").isEmpty():
            break
        level, turn = left, turn + 1
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "k"), F.lit(1 << 30)) / float(1 << 30)
    done.append(left.select("k", (draw < F.col("p")).cast("double").alias("p")))
    settled = done[0]
    for d in done[1:]:
        settled = settled.unionByName(d)
    out = due.join(settled.withColumnRenamed("p", "more"), "k", "left")
    uses = F.col("sure") + F.coalesce("more", F.lit(0.0))
    return out.select(F.col("k").alias(key), F.col("source").alias(source), F.col("n").alias("n_tokens"), uses.cast("bigint").alias("uses"))


def reached(mixed: DataFrame, source: str, mixture: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, n_tokens, records, max_uses) of each source of the mixture; 0 where it gave nothing."""
    used = mixed.groupBy(F.col(source).alias("source")).agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.sum((F.col("uses") > 0).cast("long")).alias("records"), F.max("uses").alias("max_uses"))
    out = mixture.join(used, "source", "left").fillna(0, ["n_tokens", "records", "max_uses"])
    whole = out.agg(F.sum("n_tokens").alias("whole"))  # one row
    out = out.crossJoin(F.broadcast(whole))
    return out.select("source", "target_share", F.when(F.col("whole") > 0, F.col("n_tokens") / F.col("whole")).otherwise(0.0).alias("reached_share"), "n_tokens", "records", "max_uses")
