"""Text functions as columns: normal form, canonical key, hashes, features. All but two stay in the JVM."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# fixed values: blanks of Unicode, patterns for text that is not to be kept, the salt of splits, what is no part of a key
BLANK = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"
PRIVATE = r"(?i)([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}|(?:\+?880|\b0)1[3-9][0-9]{8}\b|(?:api[_-]?key|password|secret)\s*[:=]\s*\S+)"
SPLIT_SALT = "bn-corpus-v1:"
NOT_KEY = r"[^\p{L}\p{M}\p{N}]"


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Canonical composition, by Arrow batch; rows of ASCII only are passed on.

    Arrow's own kernel is of no use: asked for this form, the one at hand (pyarrow 23) leaves letters decomposed.
    """
    wide = pc.invert(pc.fill_null(pc.string_is_ascii(text), True))
    if not pc.any(wide).as_py():
        return text
    made = pa.array([unicodedata.normalize("NFC", t) for t in text.filter(wide).to_pylist()], text.type)
    return made if len(made) == len(text) else pc.replace_with_mask(text, wide, made)


def normalize(c: str | Column) -> Column:
    """Valid UTF-8, composed, blanks collapsed and trimmed; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(nfc(c), BLANK, " "))


def key(normal: str | Column) -> Column:
    """Letters, marks and numbers of a normalised text in lower case: equal for copies that differ in form only."""
    normal = F.col(normal) if isinstance(normal, str) else normal
    return F.lower(F.regexp_replace(normal, NOT_KEY, ""))


def words(normal: str | Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    normal = F.col(normal) if isinstance(normal, str) else normal
    return F.filter(F.split(normal, " "), lambda w: w != "")


def terms(text: str | Column) -> Column:
    """Search terms: lower case, everything but letters, marks and numbers parts them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.regexp_replace(F.lower(nfc(text)), r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda w: w != "")


def acceptable(normal: str, k: str) -> Column:
    """12 to 2000 characters, nothing private, nothing lost in decoding, and a key; false for null."""
    n = F.col(normal)
    ok = F.length(n).between(12, 2000) & ~n.contains("�") & (F.col(k) != "") & ~n.rlike(PRIVATE)
    return F.coalesce(ok, F.lit(False))


def hash_byte_sample(c: str, parts: int = 5) -> Column:
    """One part in `parts` by the first byte of the SHA-256 of an id."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 2), 16, 10).cast("int") % parts == 0


def hash_split(group: str | Column) -> Column:
    """2% test, 2% validation, the rest train, by the hash of a group's name."""
    group = F.col(group) if isinstance(group, str) else group
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(SPLIT_SALT), group), 256), 1, 16), 16, 10).cast("decimal(20,0)") % 100
    return F.when(number < 2, "test").when(number < 4, "validation").otherwise("train")


def group_id(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(c, 256), 1, 32))


def script_features(c: str) -> dict[str, Column]:
    """Which scripts and digits a text holds; mixed: both Bengali and Latin."""
    x = F.col(c)
    bengali, latin = x.rlike(r"\p{IsBengali}"), x.rlike(r"\p{IsLatin}")
    return {"has_bengali": bengali, "has_latin": latin, "has_digit": x.rlike(r"\p{Nd}"), "mixed": bengali & latin}


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def shingles(w: str | Column, n: int) -> Column:
    """Distinct runs of n words; none if there are fewer."""
    w = F.col(w) if isinstance(w, str) else w
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.concat_ws(" ", F.slice(w, i, n)))
    return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def run_hashes(w: str | Column, n: int) -> Column:
    """Distinct 64-bit hashes of the runs of n words, in place of their texts; none if there are fewer."""
    w = F.col(w) if isinstance(w, str) else w
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))
    return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


_bits: dict[str, np.ndarray] = {}


@F.arrow_udf(LongType())
def simhash64(text: pa.Array) -> pa.Array:
    """64-bit SimHash of a normalised text's lower-case words, with repeats; null below 12 words.

    A bit is set if at least as many words have it as not. Word hashes are kept by the worker.
    """
    out = []
    for t in text.to_pylist():
        ws = t.lower().split() if t is not None else ()
        if len(ws) < 12:
            out.append(None)
            continue
        rows = []
        for w in ws:
            b = _bits.get(w)
            if b is None:
                if len(_bits) > 200_000:
                    _bits.clear()
                first = np.frombuffer(hashlib.sha256(w.encode()).digest()[:8], np.uint8)
                b = _bits[w] = np.unpackbits(first, bitorder="little").astype(np.int16)
            rows.append(b)
        up = 2 * np.sum(rows, axis=0) >= len(rows)
        out.append(int(np.packbits(up, bitorder="little").view(np.int64)[0]))
    return pa.array(out, pa.int64())
