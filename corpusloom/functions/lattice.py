"""All segmentations of many words at once: numpy over words of equal length, pieces found by hash and then compared."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd multiplier
#: Longer words are rare and are left to scalar code, as are sums over more than so many places at once.
LONG, PLACES = 64, 400_000


def code_points(words: list[str], n: int) -> np.ndarray:
    """(words, n) code points of words of n characters."""
    return np.array(words, f"U{n}").view(np.uint32).reshape(len(words), n)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of words of this length), in blocks of bounded size."""
    groups: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for n, places in sorted(groups.items()):
        step = max(1, PLACES // max(n, 1))
        for k in range(0, len(places), step):
            yield n, np.array(places[k : k + step])


def _grow(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (h ^ h >> np.uint64(29)) * _STEP + codes.astype(np.uint64) + np.uint64(1)


class Lattice:
    """Pieces with scores, which any substring can be looked up in. Pieces are told apart by text, so none comes twice."""

    def __init__(self, texts: list[str], scores: list[float]):
        self.scores = np.append(np.array(scores, float), -np.inf)  # the last one is that of no piece
        groups: dict[int, list[int]] = defaultdict(list)
        for k, t in enumerate(texts):
            groups[len(t)].append(k)
        self.longest = max(groups, default=0)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, places in groups.items():
            codes = code_points([texts[k] for k in places], n)
            h = np.zeros(len(places), np.uint64)
            for j in range(n):
                h = _grow(h, codes[:, j])
            order = np.argsort(h, kind="stable")
            if (h[order][1:] == h[order][:-1]).any():
                raise ValueError("two pieces have one hash")
            self.tables[n] = h[order], np.array(places, np.int32)[order], codes[order]

    def arcs(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """Of each length the piece that begins at each place, as (places, words); -1 where there is none."""
        words, n = codes.shape
        out, h = {}, np.zeros((words, n), np.uint64)
        for size in range(1, min(n, self.longest) + 1):
            h = _grow(h[:, : n - size + 1], codes[:, size - 1 :])
            if size not in self.tables:
                continue
            hashes, places, texts = self.tables[size]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            row, col = np.nonzero(hashes[at] == h)
            found = np.full((words, n - size + 1), -1, np.int32)
            same = np.ones(len(row), bool)
            for j in range(size):
                same &= codes[row, col + j] == texts[at[row, col], j]
            row, col = row[same], col[same]
            found[row, col] = places[at[row, col]]
            out[size] = np.ascontiguousarray(found.T)
        return out

    def likeliest(self, codes: np.ndarray, fallback: float) -> tuple[np.ndarray, np.ndarray]:
        """(from, piece) for each end of a part, as (places + 1, words): the last part of the likeliest way there.

        A character can also stand for its bytes, each at the fallback's score; its piece is -1. Of equally likely ways the
        one with the longest last part is taken, and bytes before a piece of one character.
        """
        words, n = codes.shape
        arcs = self.arcs(codes)
        size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        best = np.zeros((n + 1, words))
        start, piece = np.zeros((n + 1, words), np.int32), np.full((n + 1, words), -1, np.int32)
        for j in range(1, n + 1):
            top = np.full(words, -np.inf)
            ways = [(k, arcs[k][j - k]) for k in range(min(j, self.longest), 1, -1) if k in arcs]
            ways.append((1, None))
            if 1 in arcs:
                ways.append((1, arcs[1][j - 1]))
            for k, found in ways:
                if found is None:
                    found = np.full(words, -1, np.int32)
                    score = best[j - k] + fallback * size[:, j - 1]
                else:
                    score = best[j - k] + self.scores[found]
                better = score > top
                top = np.where(better, score, top)
                start[j] = np.where(better, j - k, start[j])
                piece[j] = np.where(better, found, piece[j])
            best[j] = top
        return start, piece

    def expected(self, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected uses of each piece over all segmentations, without fallback, and the negative log-likelihood.

        Words that the pieces cannot make are left out.
        """
        words, n = codes.shape
        arcs = self.arcs(codes)
        ahead, behind = np.full((n + 1, words), -np.inf), np.full((n + 1, words), -np.inf)
        ahead[0], behind[n] = 0.0, 0.0
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(1, n + 1):
                ahead[j] = _total([ahead[j - k] + self.scores[found[j - k]] for k, found in arcs.items() if k <= j], words)
            for i in range(n - 1, -1, -1):
                behind[i] = _total([behind[i + k] + self.scores[found[i]] for k, found in arcs.items() if i + k <= n], words)
        whole = ahead[n]
        made = whole > -np.inf
        uses = np.zeros(len(self.scores) - 1)
        for k, found in arcs.items():
            place, word = np.nonzero((found >= 0) & made)
            log = ahead[place, word] + self.scores[found[place, word]] + behind[place + k, word] - whole[word]
            uses += np.bincount(found[place, word], weights[word] * np.exp(log), len(uses))
        return uses, float(-(weights[made] * whole[made]).sum())


def _total(logs: list[np.ndarray], words: int) -> np.ndarray:
    """The logarithm of the sum of exponentials; minus infinity where there is nothing."""
    if not logs:
        return np.full(words, -np.inf)
    every = np.stack(logs)
    top = every.max(axis=0)
    return np.where(top > -np.inf, top + np.log(np.exp(every - np.where(top > -np.inf, top, 0.0)).sum(axis=0)), -np.inf)
