"""Held-out passages in a corpus: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are parted by blanks; letter case, punctuation and words without letter or digit do not count, and canonically
equivalent characters are the same. Both sides become 64-bit word hashes by table lookups. For alignments every run of SEED
words of a test item is a seed, however rare or common: each pair that shares one is aligned word by word over whole texts, so
copies edited every SEED + 1 words or less often are scored. For leaks, which share a whole window of WINDOW words, the rarest
run of each window by occurrences in the whole corpus is enough: no such document can be missed, and common phrases seldom
propose one; a window with a run that the corpus lacks is nowhere whole and proposes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm import codepoints as cp
from corpusloom.runtime import Scratch, pick

SEED, WINDOW = 5, 10
#: Items are searched for in blocks of this many words, so that what is sent to the executors is bounded; each block is a
#: further pass over the corpus.
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
# fixed values: odd multipliers of public mixing functions
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind, hidden = cp.categories(), cp.invisible()
    blank = np.fromiter((chr(c).isspace() for c in range(cp.TOP)), bool, cp.TOP)
    solid = np.isin(kind, np.frombuffer(b"LD", np.uint8)) & ~hidden
    counts = solid | ((kind == ord("M")) & ~hidden)
    folded = np.arange(cp.TOP, dtype=np.int32)
    for c in np.flatnonzero(kind == ord("L")).tolist():
        low = cp.fold(chr(c))
        if len(low) == 1 and ord(low) < cp.TOP:
            folded[c] = ord(low)
    weight = _mix((folded.astype(np.uint64) + np.uint64(1)) * _STEP)
    return blank, solid, counts, folded, weight


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 2 * len(_powers)), np.uint64(0x5851F42D4C957F2D))
        factors[0] = 1
        _powers = np.cumprod(factors, dtype=np.uint64)
    return _powers


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words that count, and the offset of each row among them; nulls have none."""
    cps, offsets = cp.decode(column)
    cps, offsets = cp.expand(cps, offsets, cp.decomposed())
    cps = cp.reorder(cps, offsets)
    blank, solid, counts, _, weight = _tables()
    c = cp.clip(cps)
    new = blank[c]
    row = cp.rows_of(offsets)
    word = np.cumsum(new) + row  # grows by one at each blank and at each row
    keep = counts[c]
    c, word, row = c[keep], word[keep], row[keep]
    if not len(c):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    place = np.arange(len(c)) - np.repeat(start, np.diff(np.append(start, len(c))))
    total = np.add.reduceat(weight[c] * _power(int(place.max()) + 1)[place], start)
    full = np.logical_or.reduceat(solid[c], start)
    per = np.bincount(row[start][full], minlength=len(offsets) - 1)
    return _mix(total[full]), np.concatenate([[0], np.cumsum(per)])


def runs(words: np.ndarray, offsets: np.ndarray, n: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside rows, and the place of the first word of each."""
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x2545F4914F6CDD1D) + words[j : len(words) - n + 1 + j]
    row = cp.rows_of(offsets)
    at = np.flatnonzero(row[: len(h)] == row[n - 1 :])
    return _mix(h)[at].view(np.int64), at


#: Cells of the matrices that are computed at once.
CELLS = 50_000
FIELDS = ("score", "run", "matches", "a_from", "a_to", "b_from", "b_to")
#: Bits of a cell below its score: places of the left and of the right side. Longer texts are refused.
LEFT, RIGHT = 19, 22
_LOW = LEFT + RIGHT


def _in_blocks(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Places of pairs that are computed together: of like sizes, at most CELLS in a row, none with an empty side."""
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right)]).reshape(-1, 2)
    order = np.lexsort((sizes[:, 0], sizes[:, 1]))
    order, at = order[(sizes[order] > 0).all(axis=1)], 0
    while at < len(order):
        # sizes of the right sides rise, so the last pair of a block is its widest
        width = sizes[order[at : at + CELLS], 1]
        n = max(1, int(np.searchsorted(np.arange(1, len(width) + 1) * (width + 1), CELLS, "right")))
        yield order[at : at + n]
        at += n


def align_many(left: list[np.ndarray], right: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Best local alignments of pairs of arrays of words, and their longest common runs, as arrays of FIELDS.

    Pairs of like sizes are computed together, row by row: all of their right sides at once, the gap there being a running
    maximum. A cell is one number, the score above the place where its alignment began, so the greater of two cells is the
    better one, of equal ones that which began later; memory grows with the right side alone. A second pass over the aligned
    parts counts their matches in the same way.
    """
    out = {f: np.zeros(len(left), np.int64) for f in FIELDS}
    if any(len(a) >> LEFT for a in left) or any(len(b) >> RIGHT for b in right):
        raise ValueError(f"an item of {1 << LEFT} words, or a text of {1 << RIGHT}")
    for some in _in_blocks(left, right):
        made = _block([left[i] for i in some], [right[i] for i in some])
        for f, x in made.items():
            out[f][some] = x
    a = [x[i:j] for x, i, j in zip(left, out["a_from"], out["a_to"])]
    b = [x[i:j] for x, i, j in zip(right, out["b_from"], out["b_to"])]
    for some in _in_blocks(a, b):
        out["matches"][some] = _matches([a[i] for i in some], [b[i] for i in some])
    return out


def _numbered(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as numbers of words, in rows filled up to one width by two numbers that match nothing."""
    sides = []
    for rows, fill in ((left, -1), (right, -2)):
        sizes = np.array([len(r) for r in rows])
        there = np.arange(sizes.max()) < sizes[:, None]
        sides.append((np.full(there.shape, fill, np.int32), there))
    (a, in_a), (b, in_b) = sides
    words = np.concatenate(left + right)
    number = np.unique(words, return_inverse=True)[1].astype(np.int32)
    split = int(in_a.sum())
    a[in_a], b[in_b] = number[:split], number[split:]
    return a, b


def _block(left: list[np.ndarray], right: list[np.ndarray]) -> dict[str, np.ndarray]:
    a, b = _numbered(left, right)
    rows, m = b.shape
    place = np.arange(m + 1, dtype=np.int64)
    slope = (place * -GAP) << _LOW
    match, other, gap = np.int64(MATCH << _LOW), np.int64(MISMATCH * (1 << _LOW)), np.int64(GAP * (1 << _LOW))
    h, run = np.tile(place, (rows, 1)), np.zeros((rows, m + 1), np.int32)
    best, a_to, b_to, longest = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int32)
    # filled-up rows and columns match nothing: whatever is computed there is below what it came from
    for i in range(a.shape[1]):
        same = b == a[:, i : i + 1]
        t = h + gap
        np.maximum(t[:, 1:], h[:, :-1] + np.where(same, match, other), out=t[:, 1:])
        # an alignment that begins behind this row
        np.maximum(t, place + (i + 1 << RIGHT), out=t)
        t += slope
        np.maximum.accumulate(t, axis=1, out=t)
        t -= slope
        h = t
        follow = np.zeros_like(run)
        np.add(run[:, :-1], 1, out=follow[:, 1:], where=same)
        run = follow
        np.maximum(longest, run.max(axis=1), out=longest)
        top = h.max(axis=1)
        for k in np.flatnonzero(top >> _LOW > best >> _LOW):
            best[k], a_to[k], b_to[k] = top[k], i + 1, h[k].argmax()
    score = best >> _LOW
    began = np.where(score > 0, best & ((1 << _LOW) - 1), 0)
    return dict(score=score, run=longest, a_from=began >> RIGHT, a_to=a_to, b_from=began & ((1 << RIGHT) - 1), b_to=b_to)


def _matches(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Most matches of an alignment of best score from the first words of both sides to the last ones."""
    a, b = _numbered(left, right)
    rows, m = b.shape
    n, width = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    slope = (np.arange(m + 1, dtype=np.int64) * -GAP) << _LOW
    match, other, gap = np.int64((MATCH << _LOW) + 1), np.int64(MISMATCH * (1 << _LOW)), np.int64(GAP * (1 << _LOW))
    h, out = np.tile(-slope, (rows, 1)), np.zeros(rows, np.int64)
    for i in range(a.shape[1]):
        t = h + gap
        np.maximum(t[:, 1:], h[:, :-1] + np.where(b == a[:, i : i + 1], match, other), out=t[:, 1:])
        t += slope
        h = np.maximum.accumulate(t, axis=1) - slope
        last = np.flatnonzero(n == i + 1)
        out[last] = h[last, width[last]] & ((1 << _LOW) - 1)
    return out


def align(a: np.ndarray, b: np.ndarray) -> dict:
    """The fields of align_many() of one pair."""
    return {f: int(x[0]) for f, x in align_many([a], [b]).items()}


def _seeds(grams: np.ndarray, at: np.ndarray, row: np.ndarray, docs: DataFrame) -> np.ndarray:
    """Of all runs those that are the rarest of a window and occur, by their hashes; equally rare: the first in the window."""
    held = np.unique(grams)

    def count(batches):
        for b in batches:
            found, _ = runs(*word_hashes(b.column(0)))
            found = found[np.isin(found, held)]
            g, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], ["g", "n"])

    often = docs.select("t").mapInArrow(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    number = dict(zip(often["g"].to_pylist(), often["n"].to_pylist()))  # at most the grams of the block
    by_item: dict[int, list[int]] = {}
    for g, place in zip(grams.tolist(), at.tolist()):
        by_item.setdefault(int(row[place]), []).append(g)
    seeds = set()
    for gs in by_item.values():
        width = min(WINDOW - SEED + 1, len(gs))
        seeds |= {min(gs[j : j + width], key=lambda g: number.get(g, 0)) for j in range(len(gs) - width + 1)}
    return np.array(sorted(g for g in seeds if number.get(g)), np.int64)


def _aligned(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, whole: bool) -> DataFrame:
    """The rows of alignments; whole: pairs that share no whole window may be left out."""
    spark = corpus.sparkSession
    scratch = Scratch(spark, "leakage")
    docs = pick(corpus, k=key, t=text).where("t is not null")
    kind = docs.schema["k"].dataType.simpleString()
    wanted = pick(items, i=item, t=item_text).where("t is not null")
    ikind = wanted.schema["i"].dataType.simpleString()
    blocks = 1 + int(wanted.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0) // BLOCK_WORDS
    schema = f"i {ikind}, k {kind}, score int, run int, matches int, item_from int, item_to int, doc_from int, doc_to int, words int"
    itype, ktype = to_arrow_type(wanted.schema["i"].dataType), to_arrow_type(docs.schema["k"].dataType)
    names = ["i", "k", "score", "run", "matches", "item_from", "item_to", "doc_from", "doc_to", "words"]
    out = []
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).toArrow()
        ids, (words, offsets) = part.column(0).to_pylist(), word_hashes(part.column(1).combine_chunks())
        grams, at = runs(words, offsets)
        row = cp.rows_of(offsets)
        order = np.argsort(grams, kind="stable")
        seeds, holder = grams[order], row[at][order]
        if whole:
            kept = np.isin(seeds, _seeds(grams, at, row, docs))
            seeds, holder = seeds[kept], holder[kept]

        def pairs(batches, seeds=seeds, holder=holder, ids=ids, words=words, offsets=offsets):
            named = pa.array(ids, itype)
            for b in batches:
                w, o = word_hashes(b.column(1))
                g, place = runs(w, o)
                first = np.searchsorted(seeds, g)
                n = np.searchsorted(seeds, g, "right") - first
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                near = np.unique(np.repeat(cp.rows_of(o)[place], n) * len(ids) + holder[at])
                for low in range(0, len(near), 20_000):
                    r, i = np.divmod(near[low : low + 20_000], len(ids))
                    x = align_many([words[offsets[k] : offsets[k + 1]] for k in i], [w[o[k] : o[k + 1]] for k in r])
                    columns = [named.take(pa.array(i)), b.column(0).take(pa.array(r)).cast(ktype), *[pa.array(x[f].astype(np.int32)) for f in FIELDS], pa.array(np.diff(offsets)[i].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names)

        out.append(scratch.save(docs.mapInArrow(pairs, schema), f"block{block}"))
    made = out[0]
    for x in out[1:]:
        made = made.unionByName(x)
    return made.select(F.col("i").alias(item), F.col("k").alias(key), *made.columns[2:])


#: Part of the best score of a whole item from which a pair without a shared window is taken for an edited copy.
EDITED = 0.5


def alignments(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(item, key, score, run, matches, item_from, item_to, doc_from, doc_to, kind) for every pair that shares a run of SEED words.

    run: longest common run of words; score: of the best local alignment; places count words that count. kind: passage, if a
    window of WINDOW words is shared; else edited, if the score is at least EDITED of what the whole item would score; else
    phrase. Items of fewer than SEED words have no pairs. Null and empty texts give nothing. Keys are taken as they are:
    repeated rows give repeated results.
    """
    made = _aligned(corpus, key, text, items, item, item_text, False)
    kind = F.when(F.col("run") >= WINDOW, "passage").when(F.col("score") >= EDITED * MATCH * F.col("words"), "edited").otherwise("phrase")
    return made.withColumn("kind", kind).drop("words")


def leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(item, key): aligned pairs that share at least WINDOW consecutive words; repeated rows come out once."""
    made = _aligned(corpus, key, text, items, item, item_text, True)
    return made.where(F.col("run") >= WINDOW).select(item, key).distinct()
