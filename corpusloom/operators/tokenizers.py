"""Training tokenizers on word weights, and measuring them."""

from __future__ import annotations

import hashlib
import json
import math
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import lattice as L
from corpusloom.functions import text as T
from corpusloom.functions import tokenizer as K
from corpusloom.runtime import Scratch, need

#: Distinct words that BPE training holds in the driver.
WORDS = 3_000_000
#: Pairs looked at in a round of BPE training, and the total below which a pair is only rounding.
ROUND, RESIDUE = 128, 1e-12
#: Part of the largest total below which two totals are equal.
GRAIN = 1e-12


def training_input(counts: DataFrame) -> DataFrame:
    """counts (word, weight), checked: words in normal form without blanks, weights positive and finite, at least one."""
    need(counts, "word", "weight")
    wrong = (F.col("word") == "") | F.col("word").isNull() | F.col("word").contains(" ") | (T.normalize("word") != F.col("word"))
    wrong = wrong | ~(F.col("weight") > 0) | F.col("weight").isNull() | (F.col("weight") == float("inf"))
    found = counts.agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong")).first()
    if found.wrong:
        raise ValueError("words must be non-empty, in normal form and without blanks, weights positive and finite")
    if not found.n:
        raise ValueError("there are no words")
    return counts.select("word", F.col("weight").cast("double").alias("weight"))


def seed_counts(counts: DataFrame, longest: int) -> DataFrame:
    """(piece, weight): every substring of up to `longest` characters, by the weight of the words it occurs in."""
    starts = counts.select("word", "weight", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    ends = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("i") + 1)))
    return starts.select("word", "weight", "i", ends.alias("n")).groupBy(F.expr("substring(word, i, n)").alias("piece")).agg(F.sum("weight").alias("weight"))


def pair_totals(counts: DataFrame) -> DataFrame:
    """(a, b, weight): adjacent characters, overlapping ones counted, by the weight of their words."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i")
    pairs = counts.where("length(word) > 1").select("word", "weight", at)
    return pairs.groupBy(F.expr("substring(word, i, 1)").alias("a"), F.expr("substring(word, i + 1, 1)").alias("b")).agg(F.sum("weight").alias("weight"))


def _expected(words: DataFrame, pieces: list[tuple[str, float]]) -> tuple[list[float], float]:
    """Expected uses of each piece over all segmentations of the words, without fallback, and the negative log-likelihood."""
    texts, scores = [t for t, _ in pieces], [s for _, s in pieces]

    def run(batches):
        lattice, uses, loss = L.Lattice(texts, scores), np.zeros(len(texts)), 0.0
        for b in batches:
            some, weights = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            for n, places in L.by_length(some):
                # words that the pieces cannot make are left to the fallback, which training does not see
                more, lost = lattice.expected(L.code_points([some[i] for i in places], n), weights[places])
                uses, loss = uses + more, loss + lost
        k = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1).astype(np.int32)), pa.array(np.append(uses[k], loss))], ["k", "x"])

    out, loss = [0.0] * len(pieces), 0.0
    for r in words.mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():  # one row per piece at most
        if r.k < 0:
            loss = r.x
        else:
            out[r.k] = r.x
    return out, loss


def train_unigram(counts: DataFrame, vocab: int, seed_size: int, longest: int, iterations: int = 2) -> K.Model:
    """Seed substrings, then expectation-maximisation and pruning by a fifth at a time down to the vocabulary.

    All characters stay. The words are read by Spark in every iteration; the driver holds the pieces, at most seed_size.
    Orders are: characters first, then weight, then text.
    """
    if vocab <= K.PIECES or seed_size < vocab or longest < 1 or iterations < 1:
        raise ValueError("vocabulary, seeds, length and iterations do not fit together")
    scratch = Scratch(counts.sparkSession, "unigram")
    words = scratch.save(training_input(counts).repartition(counts.sparkSession.sparkContext.defaultParallelism, "word"), "words")
    seeds = scratch.save(seed_counts(words, longest), "seeds")
    chars = {r.c for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()}
    target, found = vocab - K.PIECES, seeds.count()
    if found < target:
        raise ValueError(f"the words have {found} substrings, too few for a vocabulary of {vocab}")
    if len(chars) > target:
        raise ValueError(f"{len(chars)} characters do not fit in the vocabulary")
    single = F.length("piece") == 1
    first = seeds.orderBy(F.desc(single), F.desc("weight"), "piece").limit(seed_size - K.PIECES).collect()
    pieces = sorted((r.piece, r.weight) for r in first)

    def scaled(values: list[tuple[str, float]]) -> list[tuple[str, float]]:
        whole = sum(max(x, 1e-12) for _, x in values)
        return [(t, math.log(max(x, 1e-12) / whole)) for t, x in values]

    pieces = scaled(pieces)
    while True:
        for _ in range(iterations):
            uses, _ = _expected(words, pieces)
            pieces = scaled([(t, x) for (t, _), x in zip(pieces, uses)])
        if len(pieces) <= target:
            scratch.drop("words", "seeds")
            return K.Model("unigram", pieces)
        kept = sorted(((t, x) for (t, _), x in zip(pieces, uses)), key=lambda p: (p[0] not in chars, -p[1], p[0]))
        pieces = scaled(sorted(kept[: max(target, int(0.8 * len(pieces)))]))


class _Pairs:
    """Totals of adjacent pairs in arrays that grow, with the words that may hold each; closed pairs keep the total -1."""

    def __init__(self) -> None:
        self.slot: dict[tuple[int, int], int] = {}
        self.names: list[tuple[int, int]] = []
        self.total = np.zeros(1024)
        self.holders: list[array] = []  # four bytes a word; some are there twice, or hold the pair no more

    def add(self, pair: tuple[int, int], x: float) -> int:
        k = self.slot.get(pair)
        if k is None:
            k = self.slot[pair] = len(self.names)
            self.names.append(pair)
            self.holders.append(array("I"))
            if k >= len(self.total):
                self.total = np.concatenate([self.total, np.zeros(len(self.total))])
        if self.total[k] >= 0:
            self.total[k] = max(self.total[k] + x, 0.0)
        return k

    def close(self, k: int) -> None:
        self.total[k] = -1.0

    def heaviest(self, n: int) -> list[int]:
        """Slots of the n heaviest open pairs, and of all that weigh as much as the last; equal ones by their symbols.

        Totals are compared in steps of GRAIN of the largest, so that sums made in another order are equal.
        """
        total = self.total[: len(self.names)]
        top = float(total.max(initial=0.0))
        if top <= RESIDUE:
            return []
        steps = np.where(total > RESIDUE, np.rint(total / (top * GRAIN)), -1.0)
        edge = np.partition(steps, -n)[-n] if len(steps) > n else 0.0
        found = np.flatnonzero(steps >= max(edge, 0.0)).tolist()
        return sorted(found, key=lambda k: (-steps[k], self.names[k]))


class NoPairLeft(ValueError):
    """The words give fewer merges than a vocabulary needs; model is what they give."""

    def __init__(self, message: str, model: K.Model):
        super().__init__(message)
        self.model = model


def train_bpe(counts: DataFrame, vocab: int, longest: int) -> K.Model:
    """Merge the heaviest pair of neighbours until the vocabulary is full; ties go to the earlier made left, then right, piece.

    Spark checks and sums the words and totals their pairs of characters. The driver holds the distinct words, at most WORDS,
    four bytes a symbol and as many for each pair of a word,
    and in each round merges the heaviest pairs together as far as no two of them share a symbol: until a pair that touches a
    merged one comes up, no total that matters can have changed, and a pair that a merge makes weighs no more than one that
    touches. Raises NoPairLeft, with the model made so far, if no pair is left before the vocabulary is full.
    """
    if vocab <= K.PIECES or longest < 1:
        raise ValueError("vocabulary and length do not fit together")
    scratch = Scratch(counts.sparkSession, "bpe")
    checked = scratch.save(training_input(counts).groupBy("word").agg(F.sum("weight").alias("weight")), "words")
    if checked.count() > WORDS:
        raise ValueError(f"more than {WORDS} distinct words")
    rows = checked.toArrow().sort_by("word")  # by bytes, as Spark would
    weight, size = rows["weight"].to_numpy().tolist(), pc.utf8_length(rows["word"]).to_numpy().astype(np.int32)
    begin = np.append(0, np.cumsum(size.astype(np.int64)))
    flat = np.concatenate([np.frombuffer("".join(c.to_pylist()).encode("utf-32-le"), np.int32) for b in rows["word"].chunks for c in (b[i : i + 100_000] for i in range(0, len(b), 100_000))])
    del rows
    chars = np.unique(flat)
    flat = np.searchsorted(chars, flat).astype(np.int32)  # symbols of all words, one after the other; merges shorten a word in its place
    texts = [chr(c) for c in chars.tolist()]
    if len(texts) + K.PIECES > vocab:
        raise ValueError(f"{len(texts)} characters do not fit in the vocabulary")
    place = {t: k for k, t in enumerate(texts)}
    pairs = _Pairs()
    for r in pair_totals(checked).collect():  # pairs of characters
        pairs.add((place[r.a], place[r.b]), r.weight)
    scratch.drop("words")
    for w in range(len(size)):
        symbols = flat[begin[w] : begin[w + 1]].tolist()
        for p in zip(symbols, symbols[1:]):
            pairs.holders[pairs.slot[p]].append(w)
    merges: list[tuple[int, int, int]] = []
    while len(texts) + K.PIECES < vocab:
        to, used, dull = {}, set(), 0
        for k in pairs.heaviest(ROUND):
            a, b = pairs.names[k]
            if a in used or b in used or len(texts) + K.PIECES == vocab:
                break
            pairs.close(k)
            if len(made := texts[a] + texts[b]) > longest:
                dull += 1
                continue
            known = made in place
            if not known:
                place[made] = len(texts)
                texts.append(made)
            to[a, b] = place[made]
            merges.append((a, b, place[made]))
            used |= {a, b}
            if known:  # what this piece already touches may now weigh more
                break
        if not to and not dull:
            raise NoPairLeft(f"no pair is left to merge at {len(texts) + K.PIECES} of {vocab}", K.Model("bpe", [(t, 0.0) for t in texts], merges))
        for w in np.unique(np.concatenate([np.array(pairs.holders[pairs.slot[p]], np.uint32) for p in to] or [np.zeros(0, np.uint32)])).tolist():
            old, new, i = flat[begin[w] : begin[w] + size[w]].tolist(), [], 0
            while i < len(old):
                made = to.get((old[i], old[i + 1])) if i + 1 < len(old) else None
                new.append(old[i] if made is None else made)
                i += 1 if made is None else 2
            if len(new) == len(old):
                continue
            flat[begin[w] : begin[w] + len(new)], size[w] = new, len(new)
            was = set(zip(old, old[1:]))
            for p in zip(old, old[1:]):
                pairs.add(p, -weight[w])
            for p in zip(new, new[1:]):
                k = pairs.add(p, weight[w])
                if p not in was:
                    pairs.holders[k].append(w)
        for p in to:
            pairs.holders[pairs.slot[p]] = array("I")
    return K.Model("bpe", [(t, 0.0) for t in texts], merges)


def floor_percentile(df: DataFrame, group: list[str], value: str, count: str, parts: dict[str, int]) -> DataFrame:
    """Of each group, for each p the value at place (n - 1) * p // 100 of the sorted values, from (group, value, count) rows.

    Counted values take the place of sorted lists, so a group's size does not matter, only its number of distinct values.
    """
    order = Window.partitionBy(*group).orderBy(value) if group else Window.partitionBy(F.lit(0)).orderBy(value)
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    at = df.withColumn("upto_", F.sum(count).over(order)).withColumn("all_", F.sum(count).over(every))
    pick = [F.min(F.when(F.col("upto_") > F.floor((F.col("all_") - 1) * p / 100), F.col(value))).alias(name) for name, p in parts.items()]
    return at.groupBy(*group).agg(*pick)


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value with at least a part p of the values up to it."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


#: What metrics() sums over the texts of a bucket.
SUMS = ("examples", "tokens", "base_tokens", "words", "bytes", "characters", "space_tokens", "fallback_tokens", "truncated", "wrong")


def _measures(model: K.Model, most: int, special: int):
    """A function of batches (bucket, normalised text): sums by bucket and number of ids (kind 0), ids used in it (kind 1)."""

    def run(batches):
        for b in batches:
            ids = K.encode_batch(model, b.column(1))
            wrong = pc.invert(pc.equal(K.decode_batch(model, ids), b.column(1)))
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            n = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            count = lambda mask: np.bincount(row[mask], minlength=len(n))
            fused, space = count(flat >= K.PIECES + len(model.pieces)), count(flat == K.SPACE)
            blank, fallback = space + fused, count((flat >= K.BYTES) & (flat < K.PIECES) & (flat != K.SPACE))
            if model.space_fusion:  # a fused byte is a byte of the fallback as well
                under = np.array(model.space_fusion)
                at = flat[flat >= K.PIECES + len(model.pieces)] - K.PIECES - len(model.pieces)
                fallback = fallback + np.bincount(row[flat >= K.PIECES + len(model.pieces)][under[at] < K.PIECES], minlength=len(n))
            length = lambda f: f(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            size = length(pc.utf8_length)
            words = np.where(size > 0, length(lambda t: pc.count_substring(t, " ")) + 1, 0)
            names = b.column(0).dictionary_encode(null_encoding="encode")
            code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            values = (np.ones(len(n), np.int64), n, n + fused, words, length(pc.binary_length), size, blank, fallback, n + special > most, wrong.to_numpy(zero_copy_only=False))
            keys, place = np.unique(code << 32 | n, return_inverse=True)
            sums = [np.bincount(place, v, len(keys)).astype(np.int64) for v in values]
            seen = np.unique(code[row] << 32 | flat)
            every = np.concatenate([keys, seen])
            kind = np.repeat(np.array([0, 1], np.int32), [len(keys), len(seen)])
            columns = [pa.array(kind), names.dictionary.take(pa.array(every >> 32)), pa.array((every & 0xFFFFFFFF).astype(np.int64))]
            columns += [pa.array(np.concatenate([x, np.zeros(len(seen), np.int64)])) for x in sums]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "v", *SUMS])

    return run


def metrics(df: DataFrame, bucket: str, text: str, model: K.Model, most: int = 510, special: int = 2) -> DataFrame:
    """Of each bucket: examples, tokens, words, bytes, characters, blanks, fallbacks, truncated, used ids, rates, percentiles.

    One pass over the texts sums by bucket and length and notes the ids used; all else follows from that table, which has at
    most a row for each bucket and length or id. Raises if any text does not come back from its ids. Null texts are left out,
    a null bucket is a bucket.
    """
    need(df, bucket, text)
    rows = df.where(F.col(text).isNotNull()).select(F.col(bucket).cast("string").alias("bucket"), T.normalize(text).alias("t"))
    made = rows.mapInArrow(_measures(model, most, special), "kind int, bucket string, v bigint, " + ", ".join(f"{c} bigint" for c in SUMS))
    scratch = Scratch(df.sparkSession, "metrics")
    made = scratch.save(made.groupBy("kind", "bucket", "v").agg(*[F.sum(c).alias(c) for c in SUMS]), "sums")
    if not made.where("wrong > 0").isEmpty():
        raise ValueError("a text does not come back from its ids")
    sums = made.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in SUMS if c != "wrong"], F.sum("kind").alias("used_ids"))
    sizes = floor_percentile(made.where("kind = 0"), ["bucket"], "v", "examples", {"p50": 50, "p95": 95, "p99": 99})
    out = sums.join(sizes.withColumnRenamed("bucket", "bucket_"), F.col("bucket").eqNullSafe(F.col("bucket_")), "left").drop("bucket_")
    solid = F.col("base_tokens") - F.col("space_tokens")
    return out.withColumns(
        {
            "fertility": solid / F.col("words"),
            "tokens_per_word": F.col("tokens") / F.col("words"),
            "truncation_rate": F.col("truncated") / F.col("examples"),
            "fallback_rate": F.col("fallback_tokens") / F.greatest(solid, F.lit(1)),
            "utilization": F.col("used_ids") / model.vocab_size,
        }
    )


def train_report(path: str, model: K.Model, counts: DataFrame, parameters: dict, mixture: dict[str, float] | None, seconds: float) -> dict:
    """Write a model and a side-car of its training beside it (path and path.json): parameters, mixture, a hash of the word
    counts that does not depend on their order, and of the model, sizes, seconds. Refuses to overwrite; returns the side-car.
    """
    one = F.conv(F.substring(F.sha2(F.concat_ws("\x01", "word", F.round("weight", 6).cast("string")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    words = counts.agg(F.count("*").alias("n"), F.sum(one).cast("string").alias("h")).first()
    for p in (path, f"{path}.json"):
        if Path(p).exists():
            raise FileExistsError(p)
    model.save(path)
    made = {
        "algorithm": model.algorithm, "vocab_size": model.vocab_size, "pieces": len(model.pieces), "merges": len(model.merges), "normalization": model.normalization,
        "parameters": parameters, "mixture": mixture, "words": words.n, "counts_hash": words.h, "model_sha256": hashlib.sha256(Path(path).read_bytes()).hexdigest(), "seconds": seconds,
    }
    Path(f"{path}.json").write_text(json.dumps(made, ensure_ascii=False, indent=2), "utf-8")
    return made


def word_frequency(df: DataFrame, text: str, most_bytes: int = 1024) -> DataFrame:
    """(word, n): occurrences of words of at most so many bytes."""
    words = df.select(F.explode(T.words(T.normalize(text))).alias("word"))
    return words.where(F.octet_length("word") <= most_bytes).groupBy("word").agg(F.count("*").alias("n"))


def frequent_words(df: DataFrame, text: str, model: K.Model, n: int) -> list[str]:
    """The n commonest words that are no pieces, for a model's cache; equally common ones by text. n is the feature."""
    pieces = df.sparkSession.createDataFrame([(t,) for t, _ in model.pieces] or [("",)], "word string")
    counted = word_frequency(df, text).join(F.broadcast(pieces), "word", "left_anti")  # the driver holds the pieces already
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(n).collect()]


def quality(df: DataFrame, text: str, model: K.Model, most: int = 510) -> DataFrame:
    """One row: texts, their part that comes back from its ids, unknown ids, the part above `most` ids, nearest-rank p95."""

    def run(batches):
        for b in batches:
            ids = K.encode_batch(model, b.column(0))
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            n = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            unknown = np.bincount(np.repeat(np.arange(len(n)), n)[flat == K.UNK], minlength=len(n))
            yield pa.RecordBatch.from_arrays([pc.equal(K.decode_batch(model, ids), b.column(0)), pa.array(n.astype(np.int64)), pa.array(unknown.astype(np.int64))], ["same", "n", "unknown"])

    rows = df.where(F.col(text).isNotNull()).select(T.normalize(text).alias("t")).mapInArrow(run, "same boolean, n bigint, unknown bigint")
    over = (F.col("n") > most).cast("double")
    return rows.agg(F.count("*").alias("texts"), F.avg(F.col("same").cast("double")).alias("round_trip"), F.sum("unknown").alias("unknown"), F.avg(over).alias("over"), nearest_rank("n", 0.95).alias("p95"))


def after_space(df: DataFrame, ids: str) -> DataFrame:
    """(id, n): how often each id follows a blank."""
    pairs = F.arrays_zip(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))).alias("a"), F.slice(ids, 2, F.greatest(F.size(ids), F.lit(1))).alias("b"))
    return df.select(F.explode(pairs).alias("p")).where(F.col("p.a") == K.SPACE).groupBy(F.col("p.b").alias("id")).agg(F.count("*").alias("n"))


def fuse_spaces(model: K.Model, following: DataFrame, most: int) -> K.Model:
    """A model with the `most` ids that follow blanks oftenest fused to them; equally often, the lesser id first."""
    rows = following.where(F.col("id") != K.SPACE).orderBy(F.desc("n"), "id").limit(most).collect()
    return K.Model(model.algorithm, model.pieces, model.merges, [r.id for r in rows], model.cache_words, 2)


def fingerprint(df: DataFrame, key: str, ids: str) -> DataFrame:
    """(rows, fingerprint): a hash of all id lists that does not depend on how they are spread; per-row hashes are summed."""
    one = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.concat_ws(",", F.col(ids).cast("array<string>"))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(one.alias("h")).agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("fingerprint"))
