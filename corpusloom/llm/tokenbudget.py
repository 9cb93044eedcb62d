"""Tokens per document under an existing tokenizer, and exact totals by slice.

Words are counted once per worker and weighted by their frequency. For tokenizers with ranked merges a word is a linked list
of symbols with a priority queue of merges, and its tokens are the symbols that survive. A unigram model has no merges: its
segmentation is the likeliest path, which greedy merging does not find in general, so its words are counted by Viterbi search.
"""

from __future__ import annotations

import base64
import unicodedata
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import need, pick

#: Score of each byte of a character without a piece; below any piece's score.
BYTE = -30.0
#: A vocabulary above this many pieces is refused, as every worker holds it.
PIECES = 2_000_000
#: Words whose counts a worker keeps.
WORDS = 500_000


def merge(symbols: list, priority: dict) -> list:
    """The symbols that survive merging neighbours, those of least priority value first, the leftmost of equal ones.

    A pair can merge if together it is in priority. Symbols are linked to their neighbours; a queue holds the pairs that could
    merge, and entries whose symbols have changed meanwhile are passed over.
    """
    symbols, n = list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(priority[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in priority]
    heapify(queue)
    while queue:
        _, i, piece = heappop(queue)
        j = after[i] if symbols[i] else n
        if j >= n or symbols[i] + symbols[j] != piece:
            continue
        symbols[i], symbols[j] = piece, piece[:0]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (p := piece + symbols[after[i]]) in priority:
                heappush(queue, (priority[p], i, p))
        if before[i] >= 0 and (p := symbols[before[i]] + piece) in priority:
            heappush(queue, (priority[p], before[i], p))
    return [s for s in symbols if s]


def surviving(word: str, score: dict[str, float]) -> int:
    """Tokens of a word by merging its characters, best-scored pieces first; characters without a piece cost their bytes."""
    left = merge(word, {p: -s for p, s in score.items()} if not isinstance(score, Scores) else score.priority)
    return sum(1 if s in score else len(s.encode("utf-8", "surrogatepass")) for s in left)


class Scores(dict):
    """Scores with the priorities of merging beside them."""

    def __init__(self, score: dict[str, float]):
        super().__init__(score)
        self.priority = {p: -s for p, s in score.items()}


def likeliest(word: str, score: dict[str, float], longest: int) -> int:
    """Tokens of the likeliest segmentation; of equally likely ones that found first, bytes before pieces, short before long."""
    n = len(word)
    best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    for i in range(n):
        base, c = best[i], word[i]
        size = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        if base + BYTE * size > best[i + 1]:
            best[i + 1], count[i + 1] = base + BYTE * size, count[i] + size
        for j in range(i + 1, min(i + longest, n) + 1):
            s = score.get(word[i:j])
            if s is not None and base + s > best[j]:
                best[j], count[j] = base + s, count[i] + 1
    return count[n]


def vocabulary(pieces: DataFrame, piece: str = "piece", score: str = "score") -> dict[str, float]:
    """Pieces and scores; of a piece given twice the better score. Refuses vocabularies that workers cannot hold."""
    pieces = pick(pieces, piece=piece, score=score)
    rows = pieces.where("piece <> '' and score is not null").groupBy("piece").agg(F.max("score").alias("score")).limit(PIECES + 1).collect()
    if len(rows) > PIECES:
        raise ValueError(f"more than {PIECES} pieces")
    return {r[0]: r[1] for r in rows}


def count_tokens(df: DataFrame, text: str, score: dict[str, float], method: str = "unigram", out: str = "n_tokens") -> DataFrame:
    """df with a column of token counts.

    Text is composed canonically and split at blanks; words are joined by one blank, which is one token. method: "unigram"
    (likeliest path) or "merges" (symbols surviving the merge queue). Null text has 0 tokens, as has a text of blanks only.
    A column named like out is replaced. Texts of any length are counted whole; scores are positive nowhere.
    """
    if method not in ("unigram", "merges"):
        raise ValueError(method)
    need(df, text)
    longest, score = max(map(len, score), default=1), Scores(score) if method == "merges" else score
    df = df.drop(out)
    names = df.columns
    one = (lambda w: likeliest(w, score, longest)) if method == "unigram" else (lambda w: surviving(w, score))

    def run(batches):
        known: dict[str, int] = {}
        at = names.index(text)
        for b in batches:
            made = []
            for t in b.column(at).to_pylist():
                words, n = t.split() if t else (), 0
                for w in words:
                    c = known.get(w)
                    if c is None:
                        if len(known) >= WORDS:
                            known.clear()
                        c = known[w] = one(w if w.isascii() else unicodedata.normalize("NFC", w))
                    n += c
                made.append(n + max(len(words) - 1, 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.int64())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, {out} bigint")


def count_public(df: DataFrame, text: str, path: str, out: str = "n_tokens") -> DataFrame:
    """df with the tokens of text under a public byte-level BPE (a .tiktoken file of ranks), by the merge queue over its bytes.

    Text is parted by the tokenizer's pattern; each distinct part is merged once per worker. Null text has 0 tokens.
    """
    need(df, text)
    df = df.drop(out)
    names, state = df.columns, {}

    def run(batches):
        import regex

        if not state:
            state["ranks"] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            # fixed value: the pattern by which byte-level BPE of this kind parts text
            state["parts"] = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        ranks, parts, known = state["ranks"], state["parts"], {}
        for b in batches:
            made = []
            for t in b.column(names.index(text)).to_pylist():
                n = 0
                for x in parts.findall(t or ""):
                    c = known.get(x)
                    if c is None:
                        if len(known) >= WORDS:
                            known.clear()
                        raw = x.encode("utf-8", "surrogatepass")
                        c = known[x] = 1 if raw in ranks else len(merge([raw[i : i + 1] for i in range(len(raw))], ranks))
                    n += c
                made.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.int64())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, {out} bigint")


#: Buckets that say nothing.
PLACEHOLDERS = ("", "?", "unknown", "und", "n/a", "na", "none", "null", "-")


def collection(source: Column) -> Column:
    """The whole collection of a source, or the part of a single work's source before the colon; blanks and case do not count."""
    plain = F.lower(F.regexp_replace(source, r"[\s\p{Z}\p{Cc}\p{Cf}]+", ""))
    return F.nullif(F.regexp_extract(plain, "^[^:]*", 0), F.lit(""))


def record_tokens(records: DataFrame, sources: DataFrame, pieces: DataFrame | str, key: str = "rid", method: str = "unigram") -> DataFrame:
    """(key, source, bucket, domain, n_tokens) of every record under the tokenizer in pieces, or a public one in a file of ranks.

    source: the collection; bucket: null if it says nothing; domain: that of the collection in sources, null if it has none,
    the least if sources gives several. sources must be small enough to be broadcast, which is checked.
    """
    records = pick(records, **{key: key}, text="text", source="source", bucket="bucket")
    domains = pick(sources, source="source", domain="domain").groupBy(collection(F.col("source")).alias("source")).agg(F.min("domain").alias("domain"))
    if domains.limit(100_001).count() <= 100_000:
        domains = F.broadcast(domains)
    bucket = F.lower(F.trim("bucket"))
    bucket = F.when(~bucket.isin(*PLACEHOLDERS), bucket)
    rows = records.select(key, collection(F.col("source")).alias("source"), bucket.alias("bucket"), "text")
    counted = count_public(rows, "text", pieces) if isinstance(pieces, str) else count_tokens(rows, "text", vocabulary(pieces), method)
    counted = counted.drop("text")
    return counted.join(domains, "source", "left").select(key, "source", "bucket", "domain", "n_tokens")


def budget(counted: DataFrame) -> DataFrame:
    """(level, source, bucket, domain, records, n_tokens): exact totals by source, bucket and domain, by each alone, and in all."""
    sets = counted.select("source", "bucket", "domain", "n_tokens").groupingSets(
        [("source", "bucket", "domain"), ("source",), ("bucket",), ("domain",), ()], "source", "bucket", "domain"
    )
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("records"), F.sum("n_tokens").alias("n_tokens"))
    level = F.when(F.col("g") == 0, "slice").when(F.col("g") == 3, "source").when(F.col("g") == 5, "bucket").when(F.col("g") == 6, "domain").otherwise("all")
    return out.select(level.alias("level"), "source", "bucket", "domain", "records", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
