"""Garbled text from wrong character encodings, found and restored by expectation-maximisation.

A stretch is a run of characters that, put back into bytes by some single-byte encoding, makes whole UTF-8 sequences, or
letters of one script under another single-byte encoding. Whether it was garbled is latent: clean text writes the stretch
itself, garbled text writes what it decodes to (or what that decodes to, for chains of two steps). Both are weighed by one
table of how often characters occur in clean text, and by how often each chain occurs in the source and field. Tables and
weights are re-estimated from all stretches of the corpus together, so that a short stretch, weak evidence by itself, borrows
from the others. Each record is then repaired by posterior.
"""

from __future__ import annotations

import math
import re
import unicodedata
import warnings
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import codepoints as cp
from corpusloom.runtime import Scratch, pick, sized_join

#: Single-byte encodings tried, in order of preference for stretches that several of them restore alike.
ENCODINGS = ("cp1252", "latin-1", "cp1251", "cp1256", "mac_roman", "cp437", "cp850", "cp1250", "cp1253", "cp1254", "cp866", "koi8_r")
#: Steps of a chain: text garbled this often by encodings of the list is restored.
STEPS = 2
LOST = "�"
#: Rounds of EM end once less than this part of the restored characters changes, or after so many with a warning.
CHANGE, ROUNDS = 1e-3, 30
#: Letters that a stretch read from one single-byte encoding into another has at least: nothing but letters speaks for it.
LETTERS = 4
#: Pseudo-counts of a character not seen in clean text, and of a chain and of no chain in a source.
UNSEEN, CHAIN, CLEAN = 1e-3, 0.5, 50.0
#: Pseudo-count of a chain between single-byte encodings.
LEGACY = 0.02
#: A restored character that is nowhere outside stretches shares this part of its block of 128; if none of the block is, its
#: log-level is NOWHERE: accidents decode to scripts that the corpus does not have.
BLOCK, NOWHERE = 0.05, -60.0


@lru_cache
def to_byte(encoding: str) -> dict[str, int]:
    """Characters of the bytes from 128 on; bytes without one stand for the control character of the same number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        if b not in out.values():
            out.setdefault(chr(b), b)
    return out


@lru_cache
def pattern(encoding: str) -> re.Pattern:
    """Whole UTF-8 sequences in the encoding's characters; a lost byte may be any further byte of a sequence."""
    chars = to_byte(encoding)
    some = lambda low, high: "[" + "".join(re.escape(c) for c, b in chars.items() if low <= b < high) + "]"
    more = some(0x80, 0xC0)[:-1] + LOST + "]"
    if encoding == "latin-1":
        more = more[:-1] + "]"
    lead = (some(0xC2, 0xE0), some(0xE0, 0xF0), some(0xF0, 0xF5))
    return re.compile(f"(?:{lead[0]}{more}|{lead[1]}{more}{{2}}|{lead[2]}{more}{{3}})+")


@lru_cache
def _suspect() -> str:
    """A pattern for any lead character followed by a further one, over all encodings, or LETTERS letters in a row; for a quick
    look at each text."""
    lead, more = set(), {LOST}
    for e in ENCODINGS:
        for c, b in to_byte(e).items():
            (lead if b >= 0xC2 else more).add(c)
    text = lambda s: "[" + "".join(rf"\x{{{ord(c):x}}}" for c in sorted(s)) + "]"
    letters = {c for e in ENCODINGS for c in to_byte(e) if _script(c)}
    return f"{text(lead)}{text(more)}|{text(letters)}{{{LETTERS}}}"


def undo(stretch: str, encoding: str) -> str | None:
    """What the stretch decodes to; lost bytes become the one lost mark per character; None if it is not UTF-8."""
    chars = to_byte(encoding)
    if LOST in stretch:
        out, i = [], 0
        while i < len(stretch):
            b = chars[stretch[i]]
            n = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            part = stretch[i : i + n]
            made = LOST if LOST in part else undo(part, encoding)
            if made is None:
                return None
            out.append(made)
            i += n
        return "".join(out)
    try:
        return bytes(map(chars.__getitem__, stretch)).decode("utf-8")
    except UnicodeDecodeError:
        return None


@lru_cache
def chains() -> tuple[str, ...]:
    """Names of all chains, the empty one first: one step, two steps (inner>outer), single-byte to single-byte (read=written)."""
    two = [f"{f}>{e}" for e in ENCODINGS for f in ENCODINGS]
    return ("", *ENCODINGS, *two, *[f"{e}={f}" for e in ENCODINGS for f in ENCODINGS if e != f])


@lru_cache
def _from_byte(encoding: str) -> dict[int, str]:
    return {b: c for c, b in to_byte(encoding).items()}


@lru_cache(maxsize=10_000)
def _script(c: str) -> str:
    """The script of a letter, by the first word of its name; empty for all else."""
    return unicodedata.name(c, "").partition(" ")[0] if unicodedata.category(c)[0] == "L" else ""


@lru_cache
def _letters() -> re.Pattern:
    """LETTERS letters in a row that bytes from 128 on have in any of the encodings."""
    every = {c for e in ENCODINGS for c in to_byte(e) if _script(c)}
    return re.compile("[" + "".join(map(re.escape, sorted(every))) + f"]{{{LETTERS},}}")


def legacy(text: str) -> list[tuple[int, int, str, str]]:
    """Readings of runs of letters as written in one single-byte encoding and read in another, which turn them into letters of
    one script other than the run's own, or of the same script if it is not Latin."""
    out = []
    for m in _letters().finditer(text):
        own = {_script(c) for c in m[0]}
        for e in ENCODINGS:
            chars = to_byte(e)
            if not all(c in chars for c in m[0]):
                continue
            for f in ENCODINGS:
                back = _from_byte(f)
                made = [back.get(chars[c], "") for c in m[0]] if f != e else []
                scripts = set(map(_script, made)) if all(made) else {""}
                if made and len(scripts) == 1 and "" not in scripts and (scripts != own or own != {"LATIN"}) and "".join(made) != m[0]:
                    out.append((m.start(), m.end(), f"{e}={f}", "".join(made)))
    return out


def readings(text: str) -> list[tuple[int, int, str, str]]:
    """(from, to, chain, restored) of all stretches of a text under all chains."""
    out = []
    for e in ENCODINGS:
        for m in pattern(e).finditer(text):
            made = undo(m[0], e)
            if made is None:
                continue
            out.append((m.start(), m.end(), e, made))
            if STEPS > 1:
                for f in ENCODINGS:
                    again = pattern(f).sub(lambda x, f=f: undo(x[0], f) or x[0], made)
                    if again != made:
                        out.append((m.start(), m.end(), f"{f}>{e}", again))
    # where bytes of a whole run of letters make UTF-8 sequences, it is no accident
    return out + [r for r in legacy(text) if not any(a <= r[0] and r[1] <= z for a, z, _, _ in out)]


@lru_cache
def runs() -> re.Pattern:
    """Two or more characters in a row that bytes from 128 on have in any of the encodings: no stretch reaches over its ends."""
    every = {c for e in ENCODINGS for c in to_byte(e)} | {LOST}
    return re.compile("[" + "".join(map(re.escape, sorted(every))) + "]{2,}")


@lru_cache(maxsize=100_000)
def known(run: str) -> list[tuple[int, int, str, str]]:
    """Readings of a run; workers keep them, as runs are mostly words that come again."""
    return readings(run)


def clusters(found: list[tuple[int, int, str, str]]) -> list[list[tuple[int, int, str, str]]]:
    """Readings whose places overlap, directly or through others, which compete with each other."""
    out, end = [], -1
    for r in sorted(found):
        if r[0] >= end:
            out.append([])
        out[-1].append(r)
        end = max(end, r[1])
    return out


def weigh(text: str, cluster: list, w: Weights, prior: np.ndarray) -> list[float]:
    """Posteriors of the readings of a cluster; what they leave is the posterior that nothing is garbled.

    A reading stands for the whole cluster with its own stretch restored, so that readings of different places compare: each
    is weighed by the log-levels of its characters beyond ASCII against those of the stretch it replaces.
    """
    logs = [prior[0]]
    for a, b, chain, made in cluster:
        gain = sum([w.restored[min(ord(c), cp.TOP - 1)] for c in made]) - sum([w.level[min(ord(c), cp.TOP - 1)] for c in text[a:b]])
        logs.append(gain + prior[w.place[chain]])
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    return [w / sum(weights) for w in weights[1:]]


def _first_level(column: pa.Array) -> Counter:
    cps, _ = cp.decode(column)
    cps = cps[cps > 0x7F]
    number = np.bincount(cp.clip(cps), minlength=1) if len(cps) else np.zeros(0, np.int64)
    return Counter({chr(c): int(number[c]) for c in np.flatnonzero(number)})


class Weights:
    """What EM learns of the whole corpus: log-levels of characters as written and as restored, and the counts of chains.

    Both levels are tables by code point in which ASCII counts nothing. What each source has of its own is a table beside it.
    """

    def __init__(self, table: dict[str, float], pooled: dict[str, float], outside: dict[str, float]):
        total = sum(table.values()) + UNSEEN * max(len(table), 1)
        self.level = np.full(cp.TOP, math.log(UNSEEN / total))
        for c, n in table.items():
            self.level[min(ord(c), cp.TOP - 1)] = math.log((n + UNSEEN) / total)
        self.restored = np.full(cp.TOP, NOWHERE)
        blocks: Counter = Counter()
        for c, n in outside.items():
            blocks[ord(c) >> 7] += max(n, 0.0)
        for b, n in blocks.items():
            if n > 0.5:
                self.restored[b << 7 : b + 1 << 7] = math.log((BLOCK * n / 128 + UNSEEN) / total)
        for c, n in outside.items():
            if n > 0.5:
                self.restored[min(ord(c), cp.TOP - 1)] = self.level[min(ord(c), cp.TOP - 1)]
        self.level[:128] = self.restored[:128] = 0.0
        self.place = {c: i for i, c in enumerate(chains())}
        given = np.array([CLEAN] + [LEGACY if "=" in c else CHAIN for c in chains()[1:]])
        for c, n in pooled.items():
            given[self.place[c]] += n
        self.prior = given / given.sum()

    def of(self, own: list[tuple[str, float]] | None) -> np.ndarray:
        """Log-probabilities of the chains in a source: its counts, with the whole corpus's proportions as prior."""
        counts = 10 * self.prior
        for c, n in own or ():
            counts[self.place[c]] += n
        return np.log(counts / counts.sum())


READING = "array<struct<c:int,chain:int,was:string,made:string>>"


def _expected(w: Weights):
    """A function of batches (s, n, found, own): expected uses of chains by source, and of characters as written and restored."""

    def run(batches):
        for b in batches:
            n, found = b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            each, sizes = found.flatten(), pc.list_value_length(found).to_numpy(zero_copy_only=False)
            if not len(each):
                continue
            stretch = np.repeat(np.arange(len(n)), sizes)
            cluster, chain = each.field("c").to_numpy(zero_copy_only=False), each.field("chain").to_numpy(zero_copy_only=False)
            # readings of a cluster stand together
            first = np.flatnonzero(np.concatenate([[True], (np.diff(stretch) != 0) | (np.diff(cluster) != 0)]))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(stretch))))
            (was, was_at), (made, made_at) = cp.decode(each.field("was")), cp.decode(each.field("made"))
            gain = cp.per_row(w.restored[cp.clip(made)], made_at) - cp.per_row(w.level[cp.clip(was)], was_at)
            names = b.column(0).dictionary_encode()
            source = names.indices.to_numpy(zero_copy_only=False)
            own = {}
            for i, x in zip(source.tolist(), b.column(3)):
                if i not in own:
                    own[i] = w.of(x.as_py())
            logs = np.stack([own[i] for i in range(len(names.dictionary))])
            clean = logs[source[stretch[first]], 0]
            log = gain + logs[source[stretch], chain]
            top = np.maximum(np.maximum.reduceat(log, first), clean)
            part = np.exp(log - top[of])
            whole = np.add.reduceat(part, first) + np.exp(clean - top)
            q = part / whole[of] * n[stretch]
            uses = np.zeros(logs.shape)
            np.add.at(uses, (source[stretch], chain), q)
            np.add.at(uses, (source[stretch[first]], 0), np.exp(clean - top) / whole * n[stretch[first]])
            rows = [(names.dictionary[int(i)].as_py(), chains()[j], "", float(uses[i, j])) for i, j in zip(*np.nonzero(uses > 1e-9))]
            for kind, cps, at, sign in (("was", was, was_at, -1), ("made", made, made_at, 1)):
                moved = np.bincount(cp.clip(cps), np.repeat(q, np.diff(at)))
                rows += [(None, kind, chr(c), sign * float(moved[c])) for c in np.flatnonzero(moved > 1e-9).tolist() if c > 0x7F]
            s, k, c, x = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(k, pa.string()), pa.array(c, pa.string()), pa.array(x, pa.float64())], ["s", "k", "c", "n"])

    return run


def _own(sums: DataFrame) -> DataFrame:
    """(s, own): each source's uses of chains as a map."""
    return sums.where("s is not null").groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("own"))


def learn(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, Weights]:
    """(s, own) of every source with stretches, and the weights of the whole corpus.

    rows: (s, t). Counting characters and stretches is one pass over the corpus; the rounds of EM read the distinct
    stretches only, joined to what their source has of its own, and end when hardly any stretch changes its chain.
    """
    spark = rows.sparkSession
    suspect = _suspect()

    def scan(batches):
        for b in batches:
            made = [(None, c, float(n)) for c, n in _first_level(b.column(1)).items()]
            some = pc.fill_null(pc.match_substring_regex(b.column(1), suspect), False)
            found: Counter = Counter()
            for s, t in zip(b.column(0).filter(some).to_pylist(), b.column(1).filter(some).to_pylist()):
                for m in runs().finditer(t):
                    if known(m[0]):
                        found[s, m[0]] += 1
            made += [(s, x, float(n)) for (s, x), n in found.items()]
            s, x, n = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(x, pa.string()), pa.array(n, pa.float64())], ["s", "x", "n"])

    counted = rows.where("t is not null").mapInArrow(scan, "s string, x string, n double").groupBy("s", "x").agg(F.sum("n").alias("n"))
    counted = scratch.save(counted, "counted")
    # at most one row for each character there is
    table = {r.x: r.n for r in counted.where("s is null").collect()}
    what = pa.list_(pa.struct([("c", pa.int32()), ("chain", pa.int32()), ("was", pa.string()), ("made", pa.string())]))

    def read(batches):
        place = {c: i for i, c in enumerate(chains())}
        for b in batches:
            made = []
            for x in b.column("x").to_pylist():
                made.append([dict(c=i, chain=place[r[2]], was=x[r[0] : r[1]], made=r[3]) for i, group in enumerate(clusters(readings(x))) for r in group])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, what)], [*b.schema.names, "found"])

    # readings are made once for all rounds, spread evenly as there are few rows but much work in each
    stretches = counted.where("s is not null").repartition(spark.sparkContext.defaultParallelism, "x", "s")
    stretches = scratch.save(stretches.mapInArrow(read, f"s string, x string, n double, found {READING}"), "stretches")
    chars = F.explode(F.split("x", ""))
    # whole words of a script can be read in other encodings, so only stretches of UTF-8 are doubtful from the start
    single = min(i for i, c in enumerate(chains()) if "=" in c)
    inside = stretches.where(F.exists("found", lambda r: r.chain < single)).select(chars.alias("c"), "n").where("c > '\x7f'").groupBy("c").agg(F.sum("n").alias("n")).collect()  # characters
    outside = dict(table)
    for r in inside:
        outside[r.c] = outside.get(r.c, 0.0) - r.n
    whole = stretches.agg(F.sum(F.col("n") * F.size("found"))).first()[0]
    # the first guess: characters as counted, chains rare
    weights, used, turn = Weights(table, {}, outside), {}, 0
    own = scratch.save(spark.createDataFrame([], "s string, own map<string, double>"), "own0")
    while whole:
        turn += 1
        rows_ = sized_join(stretches.select("s", "n", "found"), own, ["s"], "left")
        sums = scratch.save(rows_.mapInArrow(_expected(weights), "s string, k string, c string, n double").groupBy("s", "k", "c").agg(F.sum("n").alias("n")), "sums")
        own = scratch.save(_own(sums), f"own{turn % 2}")
        clean, before = dict(table), used
        small = sums.where("s is null").select("k", "c", "n").collect()  # two rows for each character there is
        for r in small:
            if r.k == "was":
                clean[r.c] = max(clean.get(r.c, 0.0) + r.n, 0.0)
        now = dict(clean)
        for r in small:
            if r.k == "made":
                # what only ever comes from decoding supports no further decoding
                have = clean.get(r.c, 0.0)
                now[r.c] = have + r.n * have / (have + 1)
        pooled = {r.k: r.n for r in sums.where("s is not null").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # chains
        weights = Weights(now, pooled, clean)
        # chains that restore alike share their stretches anyhow, so not chains are compared but what is restored
        used = {(r.k, r.c): abs(r.n) for r in small}
        moved = sum(abs(used.get(k, 0.0) - before.get(k, 0.0)) for k in {*used, *before}) / max(sum(used.values()), 1e-9)
        if moved < CHANGE:
            break
        if turn == ROUNDS:
            warnings.warn(f"after {ROUNDS} rounds {moved:.2g} of what is restored still changes", stacklevel=2)
            break
    return own, weights


def repairs(df: DataFrame, key: str, source: str, texts: list[str]) -> DataFrame:
    """(key, field, chains, stretches, lost, evidence, repaired) of every text with a garbled stretch or a replacement character.

    chains: distinct chains undone, as inner>outer, or read=written between single-byte encodings; chains that restore a
    stretch alike stand together, parted by |. stretches: how many were restored; lost: replacement characters that remain,
    whose originals cannot be had; evidence: posterior, or lost where nothing but replacement characters tells of the damage.
    repaired: the whole text with the restored stretches. Null and empty texts are no cases. A null source shares one set of
    weights with other null sources. Repeated rows come out repeatedly; other columns are not read. Equally likely readings:
    the first by place, then in the order of ENCODINGS.
    """
    scratch = Scratch(df.sparkSession, "mojibake")
    named = [(f, pick(df, k=key, s=source, t=f)) for f in texts]
    parts = [p.select("k", F.concat(F.lit(f"{f}\x01"), F.coalesce(F.col("s").cast("string"), F.lit(""))).alias("s"), F.lit(f).alias("f"), "t") for f, p in named]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    own, weights = learn(rows.select("s", "t"), scratch)
    kind = rows.schema["k"].dataType.simpleString()
    suspect = _suspect() + "|" + LOST

    def doubtful(batches):
        for b in batches:
            yield b.filter(pc.fill_null(pc.match_substring_regex(b.column(3), suspect), False))

    def repair(batches, w=weights):
        order = {c: i for i, c in enumerate(chains())}
        for b in batches:
            made = [[], [], [], [], [], [], []]
            of: dict = {}
            for s, k, f, t, mine in zip(*(c.to_pylist() for c in b.columns)):
                if len(of) > 10_000:
                    of.clear()
                prior = of.get(s)
                if prior is None:
                    prior = of[s] = w.of(mine)
                out, at, used, n = [], 0, [], 0
                for first, x, cluster in ((m.start(), m[0], c) for m in runs().finditer(t) for c in clusters(known(m[0]))):
                    p = weigh(x, cluster, w, prior)
                    if sum(p) <= 0.5:
                        continue
                    # the likeliest readings that do not overlap
                    end, chosen = set(), []
                    for i in sorted(range(len(p)), key=lambda i: (-p[i], cluster[i][0], i)):
                        a, z = cluster[i][:2]
                        if (not chosen or p[i] > 0.05) and not end & set(range(a, z)):
                            chosen.append(cluster[i])
                            end |= set(range(a, z))
                    for a, z, _, restored in sorted(chosen):
                        out += [t[at : first + a], restored]
                        at = first + z
                        used.append("|".join(sorted({r[2] for r in cluster if (r[0], r[1], r[3]) == (a, z, restored)}, key=order.__getitem__)))
                        n += 1
                text = "".join(out) + t[at:]
                if n or LOST in t:
                    for column, value in zip(made, (k, f, sorted(set(used)), n, text.count(LOST), "posterior" if n else "lost", text)):
                        column.append(value)
            types = (b.schema.field(1).type, pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(made, types)], ["k", "field", "chains", "stretches", "lost", "evidence", "repaired"])

    # only texts that a stretch or a mark can be in meet the table of sources
    some = rows.where("t is not null").mapInArrow(doubtful, f"k {kind}, s string, f string, t string")
    some = sized_join(some, own, ["s"], "left").select("s", "k", "f", "t", "own")
    out = some.mapInArrow(repair, f"k {kind}, field string, chains array<string>, stretches bigint, lost bigint, evidence string, repaired string")
    return out.withColumnRenamed("k", key)
