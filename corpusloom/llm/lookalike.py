"""One consistent form for texts that look the same.

Arrow text becomes numpy code points. A table lookup expands each code point to its look: widths to the plain letter,
blanks of any kind to the space, look-alike letters of other scripts to the Latin one, everything canonically decomposed,
invisible characters to nothing. Marks are put in order and composed again vectorially. Letter case, punctuation, and the
number and place of blanks, tabs and line breaks stay; so does a joiner beside a hasanta.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import codepoints as cp
from corpusloom.runtime import Scratch, pick, sized_join

# fixed values: letters that look like a Latin one, each followed by it
CYRILLIC = "аaеeоoрpсcуyхxіiјjѕsһhԁdԛqԝwүyѵvӏlАAВBЕEКKМMНHОOРPСCТTУYХXІIЈJЅSԌGԚQԜWҮYѴVӀIҺHԀD"
GREEK = "οoαaνvρpιiυuκkγyσoΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXϲcϳjϹC"
OTHER = "ɑaɡgıiոnօoսuցgհhԼLՕOՍUքfꓮAꓐBꓚCꓓDꓰEꓝFꓖGꓧHꓲIꓙJꓗKꓡLꓟMꓠNꓳOꓑPꓣRꓢSꓔTꓴUꓦVꓪWꓫXꓬYꓜZ"
#: A Bengali vowel also written with two signs that show the same, though they are not canonically equivalent.
LONG_A = ("অ", "া", "আ")
JOINERS, HASANTA = (0x200C, 0x200D), (0x09CD, 0x094D, 0x0A4D, 0x0ACD, 0x0B4D, 0x0BCD, 0x0C4D, 0x0CCD, 0x0D4D)


@lru_cache
def look_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = CYRILLIC + GREEK + OTHER
    alike = dict(zip(pairs[::2], pairs[1::2]))
    hidden = cp.invisible()

    def rule(c: int) -> str | None:
        x = chr(c)
        if hidden[c]:
            return None if c in JOINERS else ""
        if unicodedata.category(x) == "Zs":
            return " "
        kind, _, of = unicodedata.decomposition(x).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            x = chr(int(of, 16))
        made = "".join(alike.get(y, y) for y in unicodedata.normalize("NFD", x))
        return made if made != chr(c) else None

    return cp.expansion(rule)


def look(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The consistent form of each text, null for null, and whether it has a letter."""
    cps, offsets = cp.decode(column)
    cps, offsets = cp.expand(cps, offsets, look_table())
    joiner = np.isin(cps, JOINERS)
    if joiner.any():
        # beside is meant without regard to other joiners and across no row's end
        row = cp.rows_of(offsets)
        solid = np.flatnonzero(~joiner)
        strong = np.isin(cps, HASANTA)
        after = np.searchsorted(solid, np.flatnonzero(joiner))
        j = np.flatnonzero(joiner)
        left, right = solid[np.maximum(after - 1, 0)] if len(solid) else j, solid[np.minimum(after, len(solid) - 1)] if len(solid) else j
        beside = (strong[left] & (row[left] == row[j]) & (left < j)) | (strong[right] & (row[right] == row[j]) & (right > j))
        mask = np.ones(len(cps), bool)
        mask[j[~beside]] = False
        cps, offsets = cp.keep(cps, offsets, mask)
    cps = cp.reorder(cps, offsets)
    letters = cp.per_row((cp.categories()[cp.clip(cps)] == ord("L")).astype(np.int64), offsets) > 0
    cps, offsets = cp.compose(cps, offsets)
    short, sign, long = map(ord, LONG_A)
    two = np.flatnonzero((cps[:-1] == short) & (cps[1:] == sign))
    two = two[~np.isin(two + 1, offsets)]
    if len(two):
        cps = cps.copy()
        cps[two] = long
        mask = np.ones(len(cps), bool)
        mask[two + 1] = False
        cps, offsets = cp.keep(cps, offsets, mask)
    null = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    return cp.encode(cps, offsets, null), letters


#: Scripts that have letters like Latin ones: first and last code point.
SCRIPTS = ((0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0xA4D0, 0xA4FF))
#: Distance of the stand-ins of letters that are kept, in a plane of private use that no table touches.
ASIDE = 0xF0000


@lru_cache
def _script_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point its script (0: none of these, 1: Latin, from 2 on SCRIPTS), whether it looks like a Latin letter, and
    whether it is a blank."""
    letter = cp.categories() == ord("L")
    script = np.zeros(cp.TOP, np.int8)
    script[:0x250][letter[:0x250]] = 1
    for i, (a, z) in enumerate(SCRIPTS, 2):
        script[a : z + 1][letter[a : z + 1]] = i
    alike = np.zeros(cp.TOP, bool)
    alike[[ord(c) for c in (CYRILLIC + GREEK + OTHER)[::2]]] = True
    blank = np.fromiter((chr(c).isspace() for c in range(cp.TOP)), bool, cp.TOP)
    return script, alike, blank


def form(column: pa.Array) -> pa.Array:
    """The consistent form of texts as they are to be read: like look(), but letters of a script of its own stay.

    A letter that looks like a Latin one stays where its text has a letter of its script that looks like none, and its word
    no Latin letter: a word in Cyrillic or Greek keeps its letters, a foreign letter slipped into a Latin word does not. Equal
    looks can have different forms; comparisons go by look().
    """
    made, _ = look(column)
    cps, offsets = cp.decode(column)
    cps, offsets = cp.expand(cps, offsets, cp.decomposed())
    script, alike, blank = _script_tables()
    c = cp.clip(cps)
    of, row = np.where(cps < cp.TOP, script[c], 0), cp.rows_of(offsets)
    if not (of > 1).any():
        return made
    own = np.zeros((len(offsets) - 1, len(SCRIPTS) + 2), bool)
    sure = (of > 1) & ~alike[c]
    own[row[sure], of[sure]] = True
    word = np.cumsum(blank[c]) + row
    latin = np.bincount(word[of == 1], minlength=int(word.max()) + 1 if len(word) else 1) > 0
    kept = (of > 1) & alike[c] & own[row, of] & ~latin[word]
    if not kept.any():
        return made
    null = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    aside, _ = look(cp.encode(np.where(kept, cps + ASIDE, cps).astype(np.int32), offsets, null))
    cps, offsets = cp.decode(aside)
    cps = np.where(cps >= ASIDE, cps - ASIDE, cps).astype(np.int32)
    return cp.encode(*cp.compose(cps, offsets), null)


def consistent(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key columns, text, look, form, has_letter) of every row: null text gives null look and form, an empty or invisible one
    empty ones. look is the key by which texts compare, form what a text is to be stored as; see form().

    Repeated rows stay; other columns are not read. Works on whole texts of any length.
    """
    rows = pick(df, **{k: k for k in key}, text=text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for b in batches:
            t = b.column(b.num_columns - 1)
            made, letters = look(t)
            yield pa.RecordBatch.from_arrays([*b.columns, made, form(t), pa.array(letters)], [*b.schema.names, "look", "form", "has_letter"])

    return rows.mapInArrow(run, f"{schema}, look string, form string, has_letter boolean")


def _looks(df: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """(f, k, look, raw): 16-byte digests of the look and the characters of every text with a letter."""
    rows = pick(df, f=field, k=key, t=text).where("t is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for b in batches:
            made, letters = look(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made.cast(pa.string()), b.column(2)], ["f", "k", "look", "raw"]).filter(pa.array(letters))

    made = rows.mapInArrow(run, f"f string, k {kind}, look string, raw string")
    return made.select("f", "k", F.unhex(F.md5("look")).alias("look"), F.unhex(F.md5("raw")).alias("raw"))


def look_classes(df: DataFrame, field: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Classes (field_name, class, first_key, spellings, texts) of texts of one field that look the same in two or more
    spellings, and their members (field_name, key, class, spelling).

    class and spelling are digests of look and characters; texts counts rows. One row for each class and for each member,
    however many copies a spelling has. Texts without letters, nulls among them, are in no class; repeated rows are members
    each; an empty table gives none.
    """
    members = _mixed(df, field, key, text, Scratch(df.sparkSession, "lookalike"))
    spelled = members.groupBy("field_name", "class", "spelling").agg(F.count("*").alias("n"), F.min("key").alias("k"))
    classes = spelled.groupBy("field_name", "class").agg(F.min("k").alias("first_key"), F.count("*").alias("spellings"), F.sum("n").alias("texts"))
    return classes, members


def _mixed(df: DataFrame, field: str, key: str, text: str, scratch: Scratch) -> DataFrame:
    """The members of look_classes(); texts of a look in one spelling are folded away before anything else is shuffled."""
    made = scratch.save(_looks(df, field, key, text), "looks")
    mixed = made.groupBy("f", "look").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("f", "look")
    members = sized_join(made, scratch.save(mixed, "mixed"), ["f", "look"], "left_semi")
    return scratch.save(members.select(F.col("f").alias("field_name"), F.col("k").alias("key"), F.col("look").alias("class"), F.col("raw").alias("spelling")), "members")


def same_look_pairs(df: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """(field_name, key_a, key_b), key_a < key_b: rows of one field whose texts look the same but differ in characters.

    All such pairs, made from look_classes(): only members of classes with two spellings or more are joined, and spelling with
    other spelling; groups of one text, however large, never meet themselves. A class of many copies in several spellings has
    as many pairs as it has; look_classes() tells the same in one row for each text.
    """
    members = _mixed(df, field, key, text, Scratch(df.sparkSession, "pairs"))
    a, b = (members.select("field_name", "class", F.col("key").alias(f"key_{x}"), F.col("spelling").alias(f"raw_{x}")) for x in "ab")
    pairs = a.join(b, ["field_name", "class"]).where("raw_a <> raw_b and key_a < key_b")
    return pairs.select("field_name", "key_a", "key_b")
