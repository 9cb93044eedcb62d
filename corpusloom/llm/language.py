"""Languages of documents and of their parts: a bidirectional gated recurrent network over bytes.

The network is written and trained here in numpy, by backpropagation through time. It reads the bytes of a word from both
sides and gives every position a distribution over languages; positions pool to words, words to sentences, lines and field
values, these to documents. Its state starts afresh at each word, so cost does not depend on how long a text is and a word
seen before costs nothing. Where the words of a part without punctuation change language for good, a Viterbi path with a
price on each change cuts it.
"""

from __future__ import annotations

import atexit
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.copies import FIELD_NAMES, field_patterns, fields
from corpusloom.llm.lookalike import look
from corpusloom.runtime import pick, remove, scratch_root

LANGUAGES = ("bangla", "banglish", "english", "french", "hindi")
#: Labelled texts that a fit reads for each language, chosen by hash; the only bounded sample here.
SAMPLE = 1_500
#: Steps of a fit, and of the further one without wrongly labelled texts, which goes on from its weights.
HIDDEN, STEPS, MORE_STEPS, BATCH, RATE = 24, 1_600, 400, 128, 1.5e-2
#: A word's weight in training is its frequency to this power.
POWER = 0.7
#: Price of a change of language between two words, in nats.
CHANGE = 7.0
#: Words from which a part says that its language is of the text, one that changes cut off too. A whole sentence, line or field
#: value of at least SHORT words says so as well if its confidence is SURE; single words never do beside longer parts.
PART, SHORT, SURE = 4, 2, 0.98
#: Words are read up to this many bytes at a time, in training as well; longer ones pool their pieces.
BYTES = 96
#: Log-probability below which a word says nothing more against a language.
FLOOR = -3.5
WORDS = 400_000

_word = re.compile(r"(?:[^\W\d_]|[̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣঁ-ঃ়-্ৗৢৣ‌‍])+")
_ends = re.compile(r"[।॥.?!…]+[\"”'’»)\]]*(?=\s|$)|\n\s*\n|\s[/|]\s")
_lines = re.compile(r"[\r\n]+")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights: of each direction the input rows of the 256 bytes and the padding, the recurrent matrix; then the output."""

    w: dict[str, np.ndarray]
    languages: tuple[str, ...]

    @classmethod
    def new(cls, languages: tuple[str, ...], seed: int = 17) -> Network:
        rng, h = np.random.default_rng(seed), HIDDEN
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (257, 3 * h)).astype(np.float32)
            w[f"u{d}"] = rng.normal(0, 1 / h**0.5, (h, 3 * h)).astype(np.float32)
        w["o"] = rng.normal(0, 1 / h**0.5, (2 * h, len(languages))).astype(np.float32)
        w["c"] = np.zeros(len(languages), np.float32)
        return cls(w, languages)

    def _run(self, ids: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States after each byte, in the order of the bytes; ids: (words, length), read from the right for d = b."""
        n, length, h = *ids.shape, HIDDEN
        state, out, kept = np.zeros((n, h), np.float32), np.zeros((length, n, h), np.float32), []
        x, u = self.w[f"x{d}"], self.w[f"u{d}"]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a, r = x[ids[:, t]], state @ u
            gates = _sigmoid(a[:, : 2 * h] + r[:, : 2 * h])
            z, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + reset * r[:, 2 * h :])
            m = mask[:, t : t + 1]
            following = state + m * (1 - z) * (new - state)
            kept.append((t, state, z, reset, new, r[:, 2 * h :]))
            state = out[t] = following
        return out, kept

    def positions(self, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Log-probabilities (length, words, languages) of each position, and what backpropagation needs."""
        f, kf = self._run(ids, mask, "f")
        b, kb = self._run(ids, mask, "b")
        both = np.concatenate([f, b], axis=2)
        y = both @ self.w["o"] + self.w["c"]
        y -= y.max(axis=2, keepdims=True)
        return y - np.log(np.exp(y).sum(axis=2, keepdims=True)), (both, kf, kb)

    def gradients(self, ids: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        """Of the weighted cross-entropy over all positions, by backpropagation through time in both directions."""
        logs, (both, kf, kb) = self.positions(ids, mask)
        each = (mask / mask.sum(axis=1, keepdims=True) * weight[:, None]).T[:, :, None] / weight.sum()
        loss = float(-(each * target * logs).sum())
        dy = each * (np.exp(logs) * target.sum(axis=1)[None, :, None] - target[None])
        g = {"o": np.einsum("tnh,tnk->hk", both, dy), "c": dy.sum(axis=(0, 1))}
        dboth = dy @ self.w["o"].T
        h = HIDDEN
        for d, kept, dout in (("f", kf, dboth[:, :, :h]), ("b", kb, dboth[:, :, h:])):
            u = self.w[f"u{d}"]
            gx, gu, back, rows = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u), np.zeros_like(dout[0]), []
            for t, state, z, reset, new, rn in reversed(kept):
                m = mask[:, t : t + 1]
                total = back + dout[t]
                dnew = total * m * (1 - z) * (1 - new * new)
                dz = -total * m * (new - state) * z * (1 - z)
                dr = dnew * rn * reset * (1 - reset)
                drec = np.concatenate([dz, dr, dnew * reset], axis=1)
                rows.append(np.concatenate([dz, dr, dnew], axis=1))
                gu += state.T @ drec
                back = total * (1 - m * (1 - z)) + drec @ u.T
            # sums by byte, in the order of the bytes
            at = ids[:, [t for t, *_ in reversed(kept)]].T.ravel()
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
            gx[at[order][first]] = np.add.reduceat(np.concatenate(rows)[order], first)
            g[f"x{d}"], g[f"u{d}"] = gx, gu
        return g, loss

    def _read(self, ids: np.ndarray, sizes: np.ndarray, d: str) -> np.ndarray:
        """States like those of _run, for words in falling order of size, of which only those that go on are computed."""
        n, length, h = *ids.shape, HIDDEN
        # half the gates' input, as their sigmoid is half a tanh
        half = np.concatenate([np.full(2 * h, 0.5, np.float32), np.ones(h, np.float32)])
        x, u = self.w[f"x{d}"] * half, self.w[f"u{d}"] * half
        going = np.searchsorted(-sizes, -np.arange(1, length + 1), side="right")
        state, out = np.zeros((n, h), np.float32), np.zeros((length, n, h), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            k = going[t]
            s = state[:k]
            a, r = x[ids[:k, t]], s @ u
            gates = a[:, : 2 * h] + r[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = r[:, 2 * h :] * gates[:, h:]
            new += a[:, 2 * h :]
            np.tanh(new, out=new)
            s -= new
            s *= gates[:, :h]
            s += new
            out[t, :k] = s
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """(words, languages): the mean log-probability over each word's positions, at least FLOOR."""
        pieces, of = [], []
        for i, w in enumerate(words):
            b = w.encode("utf-8", "replace")
            for j in range(0, len(b), BYTES):
                pieces.append(b[j : j + BYTES])
                of.append(i)
        sums, size = np.zeros((len(words), len(self.languages)), np.float32), np.zeros(len(words), np.float32)
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        for k in range(0, len(order), 512):
            some = order[k : k + 512]
            ids, mask = batch([pieces[i] for i in some])
            sizes = mask.sum(axis=1)
            y = self._read(ids, sizes, "f") @ self.w["o"][:HIDDEN] + self._read(ids, sizes, "b") @ self.w["o"][HIDDEN:] + self.w["c"]
            top = y.max(axis=2, keepdims=True)
            y -= top + np.log(np.exp(y - top).sum(axis=2, keepdims=True))
            rows = np.array([of[i] for i in some])
            np.add.at(sums, rows, np.einsum("tnk,nt->nk", y, mask))
            np.add.at(size, rows, sizes)
        return np.maximum(sums / np.maximum(size, 1)[:, None], FLOOR)


def batch(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in pieces])
    mask = np.arange(sizes.max()) < sizes[:, None]
    ids = np.full(mask.shape, 256)
    ids[mask] = np.frombuffer(b"".join(pieces), np.uint8)
    return ids, mask.astype(np.float32)


def plain(column: pa.Array) -> list[str | None]:
    """Texts in the consistent form, so that widths, look-alikes and invisible characters do not count; lower case."""
    odd = pc.fill_null(pc.match_substring_regex(column, r"[^\x{0}-\x{7f}\x{980}-\x{9ff}\x{900}-\x{97f}\x{2010}-\x{2026}]"), False)
    if pc.any(odd).as_py():
        made, _ = look(column.filter(odd))
        column = pc.replace_with_mask(column, odd, made.cast(column.type))
    return pc.utf8_lower(column).to_pylist()


def parts_of(text: str, starts: re.Pattern, names: tuple[str, ...] = FIELD_NAMES) -> list[str]:
    """Sentences, lines and field values of a text; field names are left out."""
    values = fields(text, names, starts)
    out: list[str] = []
    for v in [text] if values is None else [v for _, v in values]:
        for sentence in _ends.split(v):
            out += _lines.split(sentence)
    return out


class Reader:
    """Reads texts with a network, keeping the words it has seen."""

    def __init__(self, network: Network, names: tuple[str, ...] = FIELD_NAMES):
        self.network, self.names, self.starts = network, names, field_patterns(names)[1]
        self.known: dict[str, int] = {}
        self.level = np.zeros((1024, len(network.languages)), np.float32)

    def read(self, column: pa.Array) -> list[list[tuple[str, int, float, int, bool]]]:
        """Of each text the parts with words: (part, language, confidence, words, whether it is a whole sentence, line or value)."""
        k = len(self.network.languages)
        if len(self.known) > WORDS:
            self.known.clear()
        texts = [[] if t is None else [(p, w) for p in parts_of(t, self.starts, self.names) if (w := _word.findall(p))] for t in plain(column)]
        new = {w for parts in texts for _, words in parts for w in words if w not in self.known}
        if new:
            fresh = sorted(new)
            first = len(self.known)
            while len(self.level) < first + len(fresh):
                self.level = np.concatenate([self.level, np.zeros_like(self.level)])
            self.level[first : first + len(fresh)] = self.network.words(fresh)
            self.known.update(zip(fresh, range(first, first + len(fresh))))
        flat = np.array([self.known[w] for parts in texts for _, words in parts for w in words], np.int64)
        if not len(flat):
            return [[] for _ in texts]
        scores = self.level[flat]
        sizes = np.array([len(words) for parts in texts for _, words in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = np.add.reduceat(scores, starts)
        best = sums.argmax(axis=1)
        # no path with a change can win where even the best word by word gains less than its price
        gain = np.add.reduceat(scores.max(axis=1), starts) - sums.max(axis=1)
        spread = np.exp((sums - sums.max(axis=1, keepdims=True)) / np.sqrt(sizes)[:, None])
        sure = 1 / spread.sum(axis=1)
        out, i = [], 0
        for parts in texts:
            made = []
            for p, words in parts:
                if gain[i] > CHANGE and sizes[i] >= 2 * PART:
                    made += self._cut(p, words, scores[starts[i] : starts[i] + sizes[i]], k)
                else:
                    made.append((p.strip(), int(best[i]), float(sure[i]), int(sizes[i]), True))
                i += 1
            out.append(made)
        return out

    def _cut(self, part: str, words: list[str], scores: np.ndarray, k: int) -> list[tuple[str, int, float, int, bool]]:
        total, back = scores[0].copy(), []
        for s in scores[1:]:
            top = int(total.argmax())
            change = total[top] - CHANGE > total
            back.append(np.where(change, top, np.arange(k)))
            total = np.where(change, total[top] - CHANGE, total) + s
        path = [int(total.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        spans = [0, *[j for j in range(1, len(path)) if path[j] != path[j - 1]], len(path)]
        at = [m.start() for m in _word.finditer(part)] + [len(part)]
        out = []
        for a, b in zip(spans, spans[1:]):
            s = scores[a:b].sum(axis=0)
            sure = 1 / np.exp((s - s.max()) / (b - a) ** 0.5).sum()
            out.append((part[at[a] : at[b]].strip(), path[a], float(sure), b - a, len(spans) == 2))
        return out


def training_words(texts: list[tuple[str, str]], languages: tuple[str, ...]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, their distribution over languages (each language of equal mass), and their weights."""
    starts = field_patterns(FIELD_NAMES)[1]
    count: dict[str, np.ndarray] = {}
    whole = plain(pa.array([t for t, _ in texts], pa.string()))
    for t, (_, language) in zip(whole, texts):
        k = languages.index(language)
        for p in parts_of(t, starts):
            for w in _word.findall(p):
                if w not in count:
                    count[w] = np.zeros(len(languages))
                count[w][k] += 1
    words = sorted(count, key=lambda w: (-count[w].sum(), w))
    number = np.array([count[w] for w in words]).reshape(len(words), len(languages))
    mass = number.sum(axis=0)
    # each language has the same mass, so that one with few texts is not read as its likest neighbour
    even = number / np.maximum(mass, 1) + 0.02 / max(mass.max(), 1)
    return words, (even / even.sum(axis=1, keepdims=True)).astype(np.float32), (even.sum(axis=1) ** POWER).astype(np.float32)


def train(texts: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES, seed: int = 17, start: Network | None = None, steps: int = STEPS) -> Network:
    """A network fitted to (text, language) pairs with Adam, from `start` if it is given; the same pairs give the same network.

    All distinct words are trained on, whole: of words above BYTES bytes every piece, each with its part of the weight.
    """
    words, target, weight = training_words(texts, languages)
    network, rng = Network.new(languages, seed) if start is None else Network({k: x.copy() for k, x in start.w.items()}, languages), np.random.default_rng(seed)
    if not words:
        return network
    m = {k: np.zeros_like(v) for k, v in network.w.items()}
    v = {k: np.zeros_like(x) for k, x in network.w.items()}
    parts = [[b[j : j + BYTES] for j in range(0, len(b), BYTES)] for b in (w.encode() for w in words)]
    of = np.repeat(np.arange(len(words)), [len(p) for p in parts])
    pieces = [x for p in parts for x in p]
    target, weight = target[of], weight[of] / np.array([len(p) for p in parts], np.float32)[of]
    order = np.argsort([len(p) for p in pieces], kind="stable")
    groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    share = np.array([weight[x].sum() for x in groups])
    top = RATE if start is None else RATE / 3
    for step, i in enumerate(rng.choice(len(groups), steps, p=0.5 / len(groups) + 0.5 * share / share.sum()), 1):
        some = groups[i]
        ids, mask = batch([pieces[j] for j in some])
        g, _ = network.gradients(ids, mask, target[some], weight[some])
        rate = top * (0.5 + 0.5 * np.cos(np.pi * step / steps))
        for k, x in g.items():
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            network.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def fit(labelled: DataFrame, text: str, language: str, languages: tuple[str, ...] = LANGUAGES, seed: int = 17) -> Network:
    """Train on SAMPLE labelled rows of each language, those of least hash; rows of null text or other labels are not read.

    A language without any labelled row is hardly ever given; without rows at all the network stays as it was drawn. Weights
    are kept in the shared folder under a hash of the sample and all parameters, so that a session fits them once.
    """
    rows = pick(labelled, t=text, l=language).select("t", F.lower(F.trim("l")).alias("l")).where("t is not null").where(F.col("l").isin(*languages))
    best = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64(F.lit(seed), "t"), "t"))  # cut to SAMPLE before the shuffle
    texts = [(r.t, r.l) for r in rows.withColumn("n", best).where(F.col("n") <= SAMPLE).orderBy("l", "n").collect()]
    texts.sort(key=lambda x: languages.index(x[1]))
    name = hashlib.sha256(repr((texts, languages, seed, HIDDEN, STEPS, MORE_STEPS, BATCH, RATE, POWER, BYTES, FLOOR)).encode()).hexdigest()[:24]
    spark = labelled.sparkSession
    # of this session only: another one fits anew
    path = f"{scratch_root(spark)}/corpusloom/language-{spark.sparkContext.applicationId}-{name}"
    if kept := _kept(spark, path, languages):
        return kept
    atexit.register(remove, spark, path)
    network = train(texts, languages, seed)
    # labels can be wrong: texts that the network reads as another language altogether are left out when it is fitted further
    read = Reader(network).read(pa.array([t for t, _ in texts], pa.string()))
    right = [x for x, parts in zip(texts, read) if not parts or any(languages[p[1]] == x[1] for p in parts)]
    if len(right) < len(texts):
        network = train(right, languages, seed, network, MORE_STEPS)
    rows = [(k, list(x.shape), x.tobytes()) for k, x in sorted(network.w.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, weights binary").coalesce(1).write.mode("overwrite").parquet(path)
    return network


def _kept(spark: SparkSession, path: str, languages: tuple[str, ...]) -> Network | None:
    """The network written under a path, if it was written to the end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    rows = spark.read.schema("name string, shape array<int>, weights binary").parquet(path).collect()  # a few kilobytes
    return Network({r.name: np.frombuffer(bytes(r.weights), np.float32).reshape(r.shape).copy() for r in rows}, languages)


def languages_of(df: DataFrame, key: str, text: str, network: Network, names: tuple[str, ...] = FIELD_NAMES, least: int = PART) -> DataFrame:
    """(key, languages, lang, confidence, segments) of every row.

    segments: text, lang, confidence, words of each sentence, line or field value, or the parts of one that change language.
    languages: those of segments with at least `least` words, and of whole ones with SHORT words or more that are SURE, or of
    the longest segment if none has `least` words, sorted. lang: the only one, or code-mixed; confidence: the mean of the
    segments' weighted by words. A text without letters, empty or null has no segments, no languages and null lang.
    Repeated rows come out repeatedly; whole texts are read, whatever their length. Equal scores go to the first language.
    """
    rows = pick(df, k=key, t=text)
    kind = rows.schema["k"].dataType.simpleString()
    item = pa.struct([("text", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int64())])
    state: dict = {}

    def run(batches):
        if "reader" not in state:
            state["reader"] = Reader(network, names)
        called = network.languages
        for b in batches:
            langs, one, sure, segments = [], [], [], []
            for parts in state["reader"].read(b.column(1)):
                longest = max((p[3] for p in parts), default=0)
                found = sorted({called[p[1]] for p in parts if p[3] >= min(least, longest) or p[4] and p[3] >= SHORT and p[2] >= SURE})
                langs.append(found)
                one.append(None if not found else found[0] if len(found) == 1 else "code-mixed")
                words = sum(p[3] for p in parts)
                sure.append(sum(p[2] * p[3] for p in parts) / words if words else None)
                segments.append([dict(text=p[0], lang=called[p[1]], confidence=p[2], words=p[3]) for p in parts])
            columns = [b.column(0), pa.array(langs, pa.list_(pa.string())), pa.array(one, pa.string()), pa.array(sure, pa.float64()), pa.array(segments, pa.list_(item))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "languages", "lang", "confidence", "segments"])

    made = rows.mapInArrow(run, f"k {kind}, languages array<string>, lang string, confidence double, segments array<struct<text:string,lang:string,confidence:double,words:bigint>>")
    return made.withColumnRenamed("k", key)


def mislabelled(df: DataFrame, key: str, text: str, bucket: str, network: Network) -> DataFrame:
    """(key, lang): one row for each language of a text with letters whose bucket is not the right one.

    Right is the only language, if it is one that buckets have, or code-mixed if there are several; case and outer blanks of
    the bucket do not count, and null, blank and placeholder buckets are never right.
    """
    named = pick(df, key=key, t=text, bucket=bucket).withColumn("bucket", F.lower(F.trim("bucket")))
    made = languages_of(named.select(F.struct("key", "bucket").alias("k"), "t"), "k", "t", network)
    right = F.when(F.size("languages") > 1, "code-mixed").otherwise(F.col("languages")[0])
    right = F.when(right.isin("bangla", "banglish", "english", "code-mixed"), right)
    wrong = made.where(F.size("languages") > 0).where(~F.col("k.bucket").eqNullSafe(right) | right.isNull())
    return wrong.select(F.col("k.key").alias(key), F.explode("languages").alias("lang"))


