"""Tokenizer models, Unigram and BPE, as immutable objects and as columns."""

from __future__ import annotations

import json
import math
import random
import re
import unicodedata
from functools import cached_property
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from corpusloom.functions import lattice as L

# fixed values of the id space: four reserved ids, then 256 bytes, then pieces, then fused pairs of a blank and an id
PAD, UNK, BOS, EOS, BYTES, PIECES = 0, 1, 2, 3, 4, 260
SPACE = BYTES + 32
FALLBACK = -30.0
NORMALIZATION = "nfc-whitespace-v1"
#: Words a worker remembers.
MEMO = 200_000
_BLANKS = re.compile(r"[\t\n\x0b\f\r\x85   -     　 ]+")


def normalize(text: str) -> str:
    """Valid, composed, blanks collapsed and trimmed."""
    text = text.encode("utf-8", "replace").decode("utf-8")
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    # blanks of this project: str.split() takes four control characters for blanks, which are not
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return _BLANKS.sub(" ", text).strip(" ")
    return " ".join(text.split())


class Model:
    """

    pieces: (text, score). merges: (left, right, result) as places in pieces, in rank order. space_fusion: ids which, after a
    blank, are one id together with it. cache_words: words whose segmentation is made at once, as is that of the
    pieces. Used as a context manager, a model is closed at the end and refuses to work from then on.
    """

    def __init__(self, algorithm: str, pieces: list[tuple[str, float]], merges=(), space_fusion=(), cache_words=(), version: int = 1, normalization: str = NORMALIZATION):
        if version not in (1, 2) or algorithm not in ("unigram", "bpe") or normalization != NORMALIZATION:
            raise ValueError("unsupported model")
        if (space_fusion or cache_words) and version != 2:
            raise ValueError("fusion and cached words need version 2")
        if space_fusion and algorithm != "bpe":
            raise ValueError("fusion needs a BPE model")
        seen = set()
        for text, score in pieces:
            if not text or text in seen or not math.isfinite(score) or score > 0 or " " in text or "�" in text and normalize(text) != text:
                raise ValueError(f"invalid piece {text!r}")
            seen.add(text)
        for w in cache_words:
            if not w or " " in w or normalize(w) != w or len(w.encode()) > 1024:
                raise ValueError(f"invalid cached word {w!r}")
        self.version, self.algorithm, self.normalization = version, algorithm, normalization
        self.pieces, self.merges = [(t, float(s)) for t, s in pieces], [tuple(m) for m in merges]
        self.cache_words, self.space_fusion = list(cache_words), list(space_fusion)
        base = PIECES + len(pieces)
        if len(set(space_fusion)) < len(space_fusion) or any(not BYTES <= i < base or i == SPACE for i in space_fusion):
            raise ValueError("invalid fusion")
        self.fused = {i: base + k for k, i in enumerate(space_fusion)}
        self.index = {t: k for k, (t, _) in enumerate(self.pieces)}
        self.longest = max((len(t) for t, _ in self.pieces), default=0)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        if algorithm == "bpe":
            self._check_merges()
        elif merges:
            raise ValueError("merges need a BPE model")
        self.memo: dict[str, list[int]] = {}
        self.closed = False
        known = [t for t, _ in self.pieces] + self.cache_words
        self.learn(known)
        for w in known[:MEMO]:
            self.word(w)

    def __getstate__(self) -> dict:
        """Without the lattice, which each worker makes for itself."""
        return {k: v for k, v in self.__dict__.items() if k != "lattice"}

    def _check_merges(self) -> None:
        made = {k for k, (t, _) in enumerate(self.pieces) if len(t) == 1}
        for r, (a, b, to) in enumerate(self.merges):
            if not {a, b} <= made or not 0 <= to < len(self.pieces) or self.pieces[a][0] + self.pieces[b][0] != self.pieces[to][0] or (a, b) in self.rank:
                raise ValueError(f"invalid merge {r}")
            self.rank[a, b] = (r, to)
            made.add(to)
        if len(made) < len(self.pieces):
            raise ValueError("unreachable piece")

    def close(self) -> None:
        """Forget the words; the model encodes and decodes no more."""
        self.closed = True
        self.memo.clear()

    def __enter__(self) -> Model:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _open(self) -> None:
        if self.closed:
            raise ValueError("the model is closed")

    @property
    def vocab_size(self) -> int:
        return PIECES + len(self.pieces) + len(self.space_fusion)

    def save(self, path: str) -> None:
        """One JSON object; pieces and merges are objects with named members, empty lists are left out."""
        made = {"version": self.version, "algorithm": self.algorithm, "normalization": self.normalization}
        made["pieces"] = [{"text": t, "score": s} for t, s in self.pieces]
        made["merges"] = [dict(zip(("left", "right", "result"), m)) for m in self.merges]
        made |= {"cache_words": self.cache_words, "space_fusion": self.space_fusion}
        Path(path).write_text(json.dumps({k: v for k, v in made.items() if v != []}, ensure_ascii=False), "utf-8")

    @classmethod
    def load(cls, path: str) -> Model:
        m = json.loads(Path(path).read_text("utf-8"))
        pieces = [(p["text"], p.get("score", 0.0)) for p in m["pieces"]]
        merges = [tuple(x.get(k, 0) for k in ("left", "right", "result")) for x in m.get("merges") or ()]
        return cls(m["algorithm"], pieces, merges, m.get("space_fusion") or (), m.get("cache_words") or (), m["version"], m["normalization"])

    def word(self, word: str) -> list[int]:
        ids = self.memo.get(word)
        if ids is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            ids = self.memo[word] = self._likeliest(word) if self.algorithm == "unigram" else self._merged(word)
        return ids

    def learn(self, words: list[str]) -> None:
        """Segment the words that are not remembered, all together."""
        new = sorted({w for w in words if w and w not in self.memo})
        if self.algorithm != "unigram" or len(new) < 32:
            return
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        for n, places in L.by_length(new):
            if n > L.LONG:
                continue
            some = [new[i] for i in places]
            starts, pieces = self.lattice.likeliest(L.code_points(some, n), FALLBACK)
            for w, start, piece in zip(some, starts.T.tolist(), pieces.T.tolist()):
                ids, j = [], n
                while j:
                    i, k = start[j], piece[j]
                    ids += [PIECES + k] if k >= 0 else [BYTES + b for b in reversed(w[i:j].encode())]
                    j = i
                ids.reverse()
                self.memo[w] = ids

    @cached_property
    def lattice(self) -> L.Lattice:
        return L.Lattice([t for t, _ in self.pieces], [s for _, s in self.pieces])

    def _likeliest(self, word: str) -> list[int]:
        n = len(word)
        best, step = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for i, c in enumerate(word):
            raw = c.encode()
            if best[i] + FALLBACK * len(raw) > best[i + 1]:
                best[i + 1], step[i + 1] = best[i] + FALLBACK * len(raw), (i, [BYTES + b for b in raw])
            for j in range(i + 1, min(n, i + self.longest) + 1):
                k = self.index.get(word[i:j])
                if k is not None and best[i] + self.pieces[k][1] > best[j]:
                    best[j], step[j] = best[i] + self.pieces[k][1], (i, [PIECES + k])
        parts = []
        while n:
            n, ids = step[n]
            parts.append(ids)
        return [i for ids in reversed(parts) for i in ids]

    def _merged(self, word: str) -> list[int]:
        # places of pieces; bytes of characters without one below zero, so that they never merge
        ids: list[int] = []
        for c in word:
            k = self.index.get(c)
            ids += [k] if k is not None else [-1 - b for b in c.encode()]
        while len(ids) > 1:
            best = min((self.rank[p] + p for p in set(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            _, to, a, b = best
            out, i = [], 0
            while i < len(ids):
                if ids[i] == a and i + 1 < len(ids) and ids[i + 1] == b:
                    out.append(to)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return [PIECES + i if i >= 0 else BYTES - 1 - i for i in ids]

    def encode(self, text: str) -> list[int]:
        if not isinstance(text, str):
            raise TypeError("text must be a string")
        self._open()
        return self._join([self.word(w) for w in normalize(text).split(" ") if w])

    def after_blank(self, ids: list[int]) -> list[int]:
        """A word's ids where a blank goes before it, which is an id of its own or fused to the first."""
        return [self.fused[ids[0]], *ids[1:]] if ids[0] in self.fused else [SPACE, *ids]

    def _join(self, words: list[list[int]]) -> list[int]:
        out: list[int] = []
        for k, ids in enumerate(words):
            out += self.after_blank(ids) if k else ids
        return out

    def bytes_of_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts, bytes): where the bytes of each id begin; the four reserved ids have none."""
        each = [b""] * BYTES + [bytes([b]) for b in range(256)] + [t.encode() for t, _ in self.pieces]
        each += [b" " + each[i] for i in self.space_fusion]
        return np.concatenate([[0], np.cumsum([len(b) for b in each], dtype=np.int64)]), np.frombuffer(b"".join(each), np.uint8)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        if isinstance(texts, str):
            raise TypeError("a batch is a sequence of strings")
        return [self.encode(t) for t in texts]

    def expand(self, ids: list[int]) -> list[int]:
        """Fused ids as the blank and the id they stand for."""
        base, out = PIECES + len(self.pieces), []
        for i in ids:
            if isinstance(i, bool) or not isinstance(i, int):
                raise TypeError("ids must be integers")
            if not 0 < i + 1 <= self.vocab_size or i < BYTES:
                raise ValueError(f"invalid id {i}")
            out += [SPACE, self.space_fusion[i - base]] if i >= base else [i]
        return out

    def decode(self, ids: list[int]) -> str:
        self._open()
        raw = b"".join(bytes([i - BYTES]) if i < PIECES else self.pieces[i - PIECES][0].encode() for i in self.expand(ids))
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError as e:
            raise ValueError("ids do not make valid text") from e

    def sample(self, text: str, alpha: float, rng: random.Random) -> list[int]:
        """A segmentation drawn from the posterior, flattened or sharpened by the power alpha; Unigram only."""
        if self.algorithm != "unigram" or not alpha > 0:
            raise ValueError("sampling needs a Unigram model and a positive alpha")
        return self._join([self._drawn(w, alpha, rng) for w in normalize(text).split(" ") if w])

    def _options(self, word: str, i: int) -> list[tuple[int, float, list[int]]]:
        raw = word[i].encode()
        out = [(i + 1, FALLBACK * len(raw), [BYTES + b for b in raw])]
        for j in range(i + 1, min(len(word), i + self.longest) + 1):
            k = self.index.get(word[i:j])
            if k is not None:
                out.append((j, self.pieces[k][1], [PIECES + k]))
        return out

    def _drawn(self, word: str, alpha: float, rng: random.Random) -> list[int]:
        n = len(word)
        beyond = [-math.inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            logs = [alpha * s + beyond[j] for j, s, _ in self._options(word, i)]
            top = max(logs)
            beyond[i] = top + math.log(sum(math.exp(x - top) for x in logs))
        out, i = [], 0
        while i < n:
            options = self._options(word, i)
            weights = [math.exp(alpha * s + beyond[j] - beyond[i]) for j, s, _ in options]
            i, _, ids = rng.choices(options, weights)[0]
            out += ids
        return out


def from_pieces(pieces: DataFrame, most: int = 2_000_000) -> Model:
    """A Unigram model from a table (piece_id, piece, score); refuses tables that workers cannot hold."""
    rows = pieces.select("piece_id", "piece", "score").orderBy("piece_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pieces")
    return Model("unigram", [(r.piece, r.score) for r in rows])


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, place of each word among them, number of words of each row) of a batch; null rows have none.

    Words are parted at blanks and not yet composed: blanks take part in no composition, so words can be composed one by one.
    """
    if pc.any(pc.match_substring_regex(text, "[\\x1c-\\x1f]")).as_py():
        # these four control characters part words in Arrow, not here; they are rare
        lists = pa.array([None if t is None else [w for w in _BLANKS.split(t) if w] for t in text.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(text)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    places = flat.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(flat.dictionary, "").to_numpy(zero_copy_only=False)
    if empty.any():  # texts that begin or end with blanks
        keep = ~empty[places]
        row = np.repeat(np.arange(len(sizes)), sizes)[keep]
        places, sizes = places[keep], np.bincount(row, minlength=len(sizes))
    return flat.dictionary, places, sizes


def gathered(starts: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The concatenation of values[starts[r]:starts[r + 1]] for r in rows."""
    sizes = np.diff(starts)[rows]
    ends = np.cumsum(sizes)
    return values[np.repeat(starts[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def encode_batch(model: Model, text: pa.Array) -> pa.Array:
    """Ids of the texts of a batch: each distinct word is looked up once, then numpy gathers ids for all its places."""
    words, places, sizes = split_words(text)
    composed = [w if w.isascii() else unicodedata.normalize("NFC", w) for w in words.to_pylist()]
    model.learn(composed)
    plain, spaced = [], []
    for w in composed:
        ids = model.word(w) if w else []
        plain.append(ids)
        spaced.append(model.after_blank(ids) if ids else [])
    every = plain + spaced
    starts = np.concatenate([[0], np.cumsum([len(i) for i in every], dtype=np.int64)])
    values = np.fromiter(chain.from_iterable(every), np.int32, starts[-1])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    first = np.zeros(len(places), bool)
    first[offsets[:-1][sizes > 0]] = True
    rows = np.where(first, places, places + len(plain))
    length = np.concatenate([[0], np.cumsum(np.diff(starts)[rows])])
    return _lists(length[offsets], gathered(starts, values, rows), text)


def _lists(offsets: np.ndarray, values: np.ndarray, like: pa.Array) -> pa.Array:
    """A list array with the nulls of another array."""
    ends = pa.array(offsets.astype(np.int32))
    if like.null_count:
        return pa.ListArray.from_arrays(ends, pa.array(values), mask=like.is_null())
    return pa.ListArray.from_arrays(ends, pa.array(values))


def encoder(model: Model) -> Column:
    """A function of a text column giving its ids; null for null. The model travels with the task, words are remembered."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(text: pa.Array) -> pa.Array:
        return encode_batch(model, text)

    return encode


def decode_batch(model: Model, ids: pa.Array) -> pa.Array:
    """Texts of the id lists of a batch: the bytes of all ids are gathered at once. Raises as Model.decode does."""
    starts, raw = model.bytes_of_ids()
    flat = ids.flatten()
    if flat.null_count:
        raise TypeError("ids must be integers")
    flat = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and not (BYTES <= flat.min() and flat.max() < model.vocab_size):
        raise ValueError(f"invalid id {int(flat.min() if flat.min() < BYTES else flat.max())}")
    out = gathered(starts, raw, flat)
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    length = np.concatenate([[0], np.cumsum(np.diff(starts)[flat])])
    offsets = length[np.concatenate([[0], np.cumsum(sizes)])]
    made = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    try:
        made.validate(full=True)
    except pa.ArrowInvalid as e:
        raise ValueError("ids do not make valid text") from e
    made = made.cast(pa.string())
    return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), made) if ids.null_count else made


def decoder(model: Model) -> Column:
    """A function of an id column giving the text; raises for ids that make no text."""

    @F.arrow_udf(StringType())
    def decode(ids: pa.Array) -> pa.Array:
        return decode_batch(model, ids)

    return decode


def sampler(model: Model, alpha: float, seed: int) -> Column:
    """A function of a text and a key column drawing ids; the same key and seed draw the same."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def draw(text: pa.Array, key: pa.Array) -> pa.Array:
        made = [None if t is None else model.sample(t, alpha, random.Random(f"{seed}/{k}")) for t, k in zip(text.to_pylist(), key.to_pylist())]
        return pa.array(made, pa.list_(pa.int32()))

    return draw


def expanded(ids: str, model: Model) -> Column:
    """Fused ids undone in the JVM."""
    base = PIECES + len(model.pieces)
    if not model.space_fusion:
        return F.col(ids)
    under = F.array(*map(F.lit, model.space_fusion))
    return F.flatten(F.transform(ids, lambda i: F.when(i >= base, F.array(F.lit(SPACE), F.get(under, i - base))).otherwise(F.array(i))))


def truncated(ids: str, most: int) -> Column:
    """Ids cut to `most` with their start and end marks."""
    return F.concat(F.array(F.lit(BOS)), F.slice(ids, 1, most - 2), F.array(F.lit(EOS)))


def attention_mask(ids: str) -> Column:
    """1 where padded ids have a token, 0 where they are filled up."""
    return F.transform(ids, lambda i: (i != PAD).cast("int"))


def padded(ids: str, width: str | int) -> Column:
    """Ids filled up to a width on the right."""
    width = F.col(width) if isinstance(width, str) else F.lit(width)
    return F.concat(F.col(ids), F.array_repeat(F.lit(PAD), F.greatest(width - F.size(ids), F.lit(0))))


def token_hash(c: str, columns: int = 512) -> Column:
    # fixed value: the multiplier of the hash
    return (F.col(c).cast("bigint") * 2654435761).bitwiseAND(F.lit(4294967295)) % columns
