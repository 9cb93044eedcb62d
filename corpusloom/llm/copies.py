"""Duplicates hidden by formatting: progressive partition refinement.

Two texts are copies if they have the same letters, combining marks and digits in the same order; letter case, blanks,
punctuation, symbols and invisible characters do not count, and canonically equivalent characters are the same. Texts made
of named fields are copies if the same names hold copies, in any order and notation (JSON, ``name: value``, ``name=value``).
A JSON object of texts may have any names; in the other notations, which prose can look like, names must be known ones.

Stage 1 gives every text two cheap invariants of this relation, its stripped length and a hash of its letter histogram,
from numpy tables without per-row string calls. Only these are shuffled, folded to counts. Classes of one member are done.
The others are put into a Bloom filter of bounded size. Stage 2 reads the texts again and makes the costly key (parsing,
decomposition, ordered letters) only for those the filter lets through, members of larger classes but for a few that it
mistakes, which have no copy and so form no class. Texts themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import codepoints as cp
from corpusloom.runtime import Scratch, pick, sized_join

#: Names that fields of records have.
FIELD_NAMES = ("bn", "bl", "en", "title", "body", "note")


def field_patterns(names: tuple[str, ...]) -> tuple[str, re.Pattern]:
    """A pattern for texts that begin with a field, and one for every place where a field begins."""
    name = "|".join(map(re.escape, names))
    begins = rf"^[\s\x{{feff}}\x{{200b}}]*(?:\{{\s*\"|\{{?\s*[\"']?(?i:{name})[\"']?\s*[:=])"
    return begins, re.compile(rf"(?i)(?:^[\s﻿​]*|[{{,;|\n])\s*[\"']?({name})[\"']?\s*[:=]")


def fields(text: str, names: tuple[str, ...], starts: re.Pattern) -> list[tuple[str, str]] | None:
    """Names in lower case and values, in their order; None if the text does not begin with a field."""
    if text.lstrip("﻿​ \t\r\n").startswith("{"):
        try:
            made = json.loads(text.strip("﻿​ \t\r\n"), object_pairs_hook=list)
            if made and isinstance(made, list) and all(isinstance(x, tuple) and isinstance(x[1], str) for x in made):
                return [(k.strip().lower(), v) for k, v in made]
        except (ValueError, TypeError, AttributeError):
            pass
    found = list(starts.finditer(text))
    if not found or text[: found[0].start()].strip("﻿​ {"):
        return None
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(m[1].lower(), text[m.end() : end]) for m, end in zip(found, ends)]


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: how many signs that count it holds, and the sum of their random weights."""
    kind, hidden = cp.categories(), cp.invisible()
    counts = ((kind == ord("L")) | (kind == ord("M")) | (kind == ord("D"))) & ~hidden
    # odd multiples spread by a 64-bit finaliser stand in for random weights
    h = np.arange(cp.TOP, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    size, weight = np.zeros(cp.TOP, np.int64), np.zeros(cp.TOP, np.uint64)
    size[counts], weight[counts] = 1, h[counts]
    starts, flat = cp.decomposed()
    folded = np.arange(cp.TOP)
    for c in np.flatnonzero(kind == ord("L")).tolist():
        low = cp.fold(chr(c))
        if len(low) == 1 and ord(low) < cp.TOP:
            folded[c] = ord(low)
    flat = folded[flat]
    total = lambda v: np.add.reduceat(v[flat], np.minimum(starts[:-1], len(flat) - 1))
    return total(size), total(weight)


def invariants(column: pa.Array, names: tuple[str, ...] = FIELD_NAMES) -> tuple[np.ndarray, np.ndarray]:
    """Stripped length and histogram hash of each text; of texts made of fields, over names and values."""
    begins, starts = field_patterns(names)
    some = pc.fill_null(pc.match_substring_regex(column, begins), False)
    if pc.any(some).as_py():
        made = []
        for text in column.filter(some).to_pylist():
            parts = fields(text, names, starts)
            made.append(text if parts is None else "\n".join(f"{k}\n{v}" for k, v in parts))
        column = pc.replace_with_mask(column, some, pa.array(made, column.type))
    cps, offsets = cp.decode(column)
    size, weight = _tables()
    c = cp.clip(cps)
    return cp.per_row(size[c], offsets), cp.per_row(weight[c], offsets).view(np.int64)


_SIGNS = re.compile(r"[\W_]+")


def _letters(text: str) -> str:
    out = unicodedata.normalize("NFD", text)
    # what \w leaves: letters, digits and other numbers; marks are not in \w for most scripts, so they are tested one by one
    if out.isascii():
        return _SIGNS.sub("", out).lower()
    kind, hidden = _kinds()
    return unicodedata.normalize("NFD", "".join([cp.fold(c) for c in out if kind[min(ord(c), cp.TOP - 1)] and not hidden[min(ord(c), cp.TOP - 1)]]))


@lru_cache
def _kinds() -> tuple[list[bool], list[bool]]:
    kind = cp.categories()
    return np.isin(kind, np.frombuffer(b"LMD", np.uint8)).tolist(), cp.invisible().tolist()


def exact_key(text: str, names: tuple[str, ...] = FIELD_NAMES) -> str:
    """The ordered letters, marks and digits; of texts made of fields, the sorted names with those of their values."""
    parts = fields(text, names, field_patterns(names)[1])
    if parts is None:
        return _letters(text)
    return "\x02" + "\x01".join(sorted(f"{k}\x03{_letters(v)}" for k, v in parts))


#: Bits of the largest filter (16 MB), bits for each class, hashes.
FILTER, ROOM, HASHES = 1 << 27, 16, 4


def _mixed(n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One number for both invariants of each text."""
    x = h.view(np.uint64) ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def bloom(hashes: DataFrame, c: str, bits: int) -> np.ndarray:
    """A Bloom filter, as 64-bit words, of a column of well-mixed numbers; bits is a power of two. Made by an aggregate with at
    most bits / 64 rows, which is what the driver gets."""
    low, high = F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(c, 32)
    places = F.explode(F.array(*[(low + i * high).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]))
    words = hashes.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint64)


def may_hold(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which numbers the filter may hold; never False for one it was made of."""
    x, found = x.view(np.uint64), np.ones(len(x), bool)
    low, high, mask = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32), np.uint64(len(words) * 64 - 1)
    for i in range(HASHES):
        p = low + np.uint64(i) * high & mask
        found &= (words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def copy_classes(df: DataFrame, key: str, text: str, scratch: Scratch, names: tuple[str, ...] = FIELD_NAMES, most: int = FILTER) -> DataFrame:
    """(key, class): one row for each text that has a letter or digit and may have a copy; class is the 16-byte key.

    Every text with a copy is there. Null, empty and signless texts are left out; repeated rows count as copies. Other columns
    are not read, so clashing names in them do no harm. An empty table gives no rows.
    """
    rows = pick(df, k=key, t=text).where("t is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def cheap(batches):
        for b in batches:
            n, h = invariants(b.column(0), names)
            g, c = np.unique(_mixed(n, h)[n > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], ["g", "c"])

    # hot classes are folded before the shuffle, in each batch and by the aggregate
    several = rows.select("t").mapInArrow(cheap, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c")).where("c > 1").select("g")
    several = scratch.save(several, "several")
    bits = 1 << max(10, min(most.bit_length() - 1, (several.count() * ROOM).bit_length()))
    held = bloom(several, "g", bits)
    sent = df.sparkSession.sparkContext.broadcast(held)  # at most FILTER bits

    def costly(batches):
        for b in batches:
            n, h = invariants(b.column(1), names)
            some = pa.array((n > 0) & may_hold(sent.value, _mixed(n, h)))
            b = b.filter(some)
            made = [hashlib.md5(exact_key(t, names).encode("utf-8", "surrogatepass")).digest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["k", "class"])

    return rows.mapInArrow(costly, f"k {kind}, class binary")


def copies(df: DataFrame, key: str, text: str, scratch: Scratch, names: tuple[str, ...] = FIELD_NAMES) -> tuple[DataFrame, DataFrame]:
    """(class, first, copies) of each class of two or more, and (key, class) of its members."""
    members = scratch.save(copy_classes(df, key, text, scratch, names), "members")
    classes = members.groupBy("class").agg(F.min("k").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return scratch.save(classes, "classes"), members


def copy_pairs(df: DataFrame, key: str, text: str, names: tuple[str, ...] = FIELD_NAMES) -> DataFrame:
    """(rid_a, rid_b): the smallest key of each set of copies with each further key of it."""
    scratch = Scratch(df.sparkSession, "copies")
    classes, members = copies(df, key, text, scratch, names)
    pairs = sized_join(members, classes.select("class", "first"), ["class"])
    return pairs.where("k <> first").select(F.col("first").alias("rid_a"), F.col("k").alias("rid_b"))


def collapse(df: DataFrame, key: str, text: str, names: tuple[str, ...] = FIELD_NAMES) -> DataFrame:
    """(key, copies): one row per content, the smallest key of its class and the number of rows that hold it.

    Texts without letter and digit, nulls among them, are each their own content with one copy.
    """
    scratch = Scratch(df.sparkSession, "collapse")
    classes, members = copies(df, key, text, scratch, names)
    further = sized_join(members, classes.select("class", "first"), ["class"]).where("k <> first").select("k")
    counted = classes.select(F.col("first").alias("k"), "copies")
    kept = pick(df, k=key).join(further, "k", "left_anti").join(counted, "k", "left")
    return kept.select(F.col("k").alias(key), F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"))
