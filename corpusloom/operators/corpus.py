"""Corpus operators: links, groups, splits, deduplication, audits, weighted word counts."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph
from corpusloom.operators import ranking as R
from corpusloom.runtime import Scratch, need, sized_join

SPLITS = ("train", "validation", "test")
NEAR = 3
#: Bits of the filter of runs that every task of overlaps() gets, 16 MB.
BITS = 1 << 27


def blank_is_null(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def record_problems(df: DataFrame) -> DataFrame:
    """(rid, problem): records without group, source or bucket (incomplete), else of a split of another name (unknown split)."""
    lacking = "coalesce(group_id, '') = '' or coalesce(source, '') = '' or coalesce(bucket, '') = ''"
    problem = F.when(F.expr(lacking), "incomplete").when(~F.coalesce("split", F.lit("")).isin("", *SPLITS), "unknown split")
    return df.select("rid", problem.alias("problem")).where("problem is not null")


def check_records(df: DataFrame) -> None:
    """Raise on the first record, by rid, without group, source or bucket, or with a split of another name."""
    for r in record_problems(df).orderBy("rid").limit(1).collect():
        raise ValueError(f"record {r.rid} lacks a group, source or bucket" if r.problem == "incomplete" else f"record {r.rid} has an unknown split")


def split_problems(df: DataFrame, allowed: tuple[str, ...], split: str = "split") -> DataFrame:
    """(split, records) of rows whose split is none of those allowed; null and blank count as none."""
    name = F.coalesce(F.lower(F.trim(split)), F.lit(""))
    return df.select(name.alias("split")).where(~F.col("split").isin(*allowed)).groupBy("split").agg(F.count("*").alias("records"))


def require_splits(df: DataFrame, *allowed: str, split: str = "split") -> DataFrame:
    """df, if all its rows are of the splits allowed; raises otherwise. Fitting takes train rows only, evaluation only held-out ones."""
    for r in split_problems(df, allowed, split).orderBy(F.desc("records"), "split").limit(1).collect():
        raise ValueError(f"{r.records} rows are of split {r.split!r}, not {' or '.join(allowed)}")
    return df


def normalized(df: DataFrame) -> DataFrame:
    """df with its text in normal form, the column key, and ok for acceptable text."""
    need(df, "rid", "text")
    out = df.withColumn("text", T.normalize("text"))
    out = out.withColumn("key", T.key("text"))
    return out.withColumn("ok", T.acceptable("text", "key"))


def digest(c: str | Column) -> Column:
    """16 bytes that stand for a text in joins and groups; null for null and empty."""
    return F.unhex(F.md5(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))))


def facts(df: DataFrame, *further: str) -> DataFrame:
    """(rid, group_id, split, ok, key, h, further columns) of df's records, without their texts.

    key: the digest of the canonical key, null if that is empty; h: the SimHash, null below 12 words; blank groups are null.
    """
    rows = normalized(df)
    h = F.when(F.col("key") != "", T.simhash64("text"))
    return rows.select("rid", blank_is_null("group_id").alias("group_id"), "split", "ok", digest("key").alias("key"), h.alias("h"), *further)


def first_links(df: DataFrame, c: str) -> DataFrame:
    """(u, v): each record with the first of the same value, by an aggregate and a join that is broadcast only if small."""
    some = df.where(F.col(c).isNotNull())
    if df.schema[c].dataType.typeName() == "string":
        some = some.where(F.col(c) != "")
    first = some.groupBy(c).agg(F.min("rid").alias("v"), F.count("*").alias("n"))
    first = first.where("n > 1").select(c, "v")
    return df.select(F.col("rid").alias("u"), c).join(first, c).where("u <> v").select("u", "v")


def blocks_for(n: int, distance: int = NEAR) -> int:
    """Into how many blocks to cut n distinct hashes: that of least work, rows of all equality joins and pairs they meet.

    More blocks make longer join keys, so fewer accidental pairs, but more joins; every number finds the same pairs.
    """
    work = lambda b: comb(b, b - distance) * n * (1 + n / 2.0 ** (64 * (b - distance) // b))
    return min(range(distance + 1, distance + 6), key=work)


def near_hashes(hashes: DataFrame, distance: int = NEAR, blocks: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of distinct 64-bit hashes (h) at most `distance` bits apart.

    Bits are cut into `blocks`; two such hashes agree on at least blocks - distance of them, so equality joins on every choice
    of so many blocks miss none. Without `blocks` the hashes are counted and blocks_for() says how many.
    """
    if blocks is None:
        hashes = Scratch(hashes.sparkSession, "hashes").save(hashes.select("h").distinct(), "hashes")
        blocks = blocks_for(hashes.count(), distance)
    if blocks <= distance:
        raise ValueError("blocks must exceed distance")
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (ends[i + 1] - ends[i])) - 1) << ends[i] for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = [sum(masks[i] for i in some) for some in combinations(range(blocks), blocks - distance)]
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("h").bitwiseAND(F.lit(signed(m))).alias("part")) for k, m in enumerate(choices)]))
    rows = hashes.select("h").distinct().select("h", parts.alias("p")).select("h", "p.k", "p.part")
    a, b = rows.withColumnRenamed("h", "a"), rows.withColumnRenamed("h", "b")
    return a.join(b, ["k", "part"]).where(F.col("a") < F.col("b")).where(T.hamming("a", "b") <= distance).select("a", "b").distinct()


def hashed(df: DataFrame) -> DataFrame:
    """(rid, h) of normalised records with a key and at least 12 words."""
    return df.where("key <> ''").select("rid", T.simhash64("text").alias("h")).where("h is not null")


def links(rows: DataFrame, scratch: Scratch, blocks: int | None = None) -> DataFrame:
    """(u, v, kind): u later than v; 0 same group, 1 same key, 2 near by SimHash; rows as facts() gives them.

    Records of one hash are linked to the first of them, and first records of near hashes to each other: all near pairs
    follow from these, whatever the number of copies.
    """
    members = rows.where("h is not null").select("rid", "h")
    first = scratch.save(members.groupBy("h").agg(F.min("rid").alias("v")), "first")
    near = scratch.save(near_hashes(first, blocks=blocks), "near")
    same = sized_join(members, first, ["h"]).where("rid <> v").select(F.col("rid").alias("u"), "v")
    pairs = near.join(first.select(F.col("h").alias("a"), F.col("v").alias("x")), "a").join(first.select(F.col("h").alias("b"), F.col("v").alias("y")), "b")
    pairs = pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    kinds = [first_links(rows, "group_id"), first_links(rows, "key"), same.unionByName(pairs)]
    out = kinds[0].withColumn("kind", F.lit(0))
    for k in (1, 2):
        out = out.unionByName(kinds[k].withColumn("kind", F.lit(k)))
    return scratch.save(out, "links")


def components(rows: DataFrame, scratch: Scratch, blocks: int | None = None, few: int = graph.FEW) -> DataFrame:
    """(rid, root): the smallest rid each record is linked to, by group, key or SimHash, through any others; rows as facts() gives."""
    edges = links(rows, scratch, blocks).select("u", "v")
    to = scratch.save(graph.roots(edges, scratch, few), "to").withColumnRenamed("label", "rid")
    return sized_join(rows.select("rid"), to, ["rid"], "left").select("rid", F.coalesce("root", "rid").alias("root"))


def prepare(df: DataFrame, strict: bool = False, blocks: int | None = None, reserve: str | None = None, few: int = graph.FEW) -> DataFrame:
    """The corpus: acceptable records, one per key, with the name and split of their group; columns as df, group_id and split new.

    All records are linked before any is dropped, so rejected ones bridge groups and carry held-out priority. A group is named
    by its least group_id (a record's rid where none has one); test wins over validation over the hash of the name. Of equal
    keys the acceptable record of smallest rid stays. Records of the source `reserve` take part in all of this and are left out
    of what comes out, with the copies they stand for. strict raises on incomplete records; otherwise a null or blank group
    ties nothing, and splits of other names count as unset. Texts are read twice and never written or shuffled but with the
    rows that stay.
    """
    need(df, "rid", "text", "group_id", "split", "source")
    if strict:
        check_records(df)
    scratch = Scratch(df.sparkSession, "prepare")
    rows = scratch.save(facts(df), "facts")
    rooted = scratch.save(rows.select("rid", "group_id", "split", "ok", "key").join(components(rows, scratch, blocks, few), "rid"), "rooted")
    split = F.lower(F.trim("split"))
    held = F.max(F.when(split == "test", 2).when(split == "validation", 1).otherwise(0)).alias("held")
    named = rooted.groupBy("root").agg(held, F.coalesce(F.min("group_id"), F.concat(F.lit("record:"), F.min("rid").cast("string"))).alias("name"))
    named = scratch.save(named, "named")
    kept = rooted.where("ok").groupBy("key").agg(F.min(F.struct("rid", "root")).alias("x")).select("x.rid", "x.root")
    kept = scratch.save(sized_join(kept, named, ["root"]).select("rid", "held", "name"), "kept")
    scratch.drop("facts", "rooted", "named", "first", "near", "links", "to", "edges", "hook", "jump", "roots")
    out = df if reserve is None else df.where(~F.col("source").eqNullSafe(F.lit(reserve)))
    out = out.drop("group_id", "split").join(kept, "rid").withColumn("text", T.normalize("text"))
    new = F.when(F.col("held") == 2, "test").when(F.col("held") == 1, "validation").otherwise(T.hash_split("name"))
    return out.withColumn("group_id", F.col("name")).withColumn("split", new).select(*df.columns)


#: Source of rows that only block: texts kept for evaluation.
RESERVE = "benchmark-reserve"


def combined(prepared: DataFrame, forms: DataFrame | None, material: DataFrame, key: str, surfaces: tuple[str, ...], reserve: str = RESERVE) -> DataFrame:
    """One table of records: a prepared corpus of all its splits, imported forms, and the surfaces of evaluation material as
    rows of the source `reserve`, split test, group `agent-domain:` and the material's key.

    forms: (rid, text, bucket, source, group_id, attribution, split), numbered on their own. rids of the corpus stay, those of
    forms and blockers come after them in this order; blockers are numbered by a seeded shuffle of the material.
    """
    columns = ["rid", "text", "bucket", "source", "group_id", "attribution", "split"]
    part = lambda k: F.lit(k << 56)
    ranked = R.hash_rank(material, [], key)
    texts = F.posexplode(F.array(*[F.col(c) for c in surfaces]))
    rows = ranked.select("rank", F.concat(F.lit("agent-domain:"), F.col(key).cast("string")).alias("group_id"), texts.alias("place", "text")).where("text is not null")
    rows = rows.select((part(2) + F.col("rank") * len(surfaces) + F.col("place")).alias("rid"), "text", F.lit("english").alias("bucket"), F.lit(reserve).alias("source"), "group_id", F.lit("kept for evaluation").alias("attribution"), F.lit("test").alias("split"))
    out = prepared.select(*columns)
    if forms is not None:
        out = out.unionByName(forms.select((part(1) + F.col("rid")).alias("rid"), *columns[1:]))
    return out.unionByName(rows)


def expand(prepared: DataFrame, forms: DataFrame | None, material: DataFrame, key: str, surfaces: tuple[str, ...], reserve: str = RESERVE, blocks: int | None = None) -> DataFrame:
    """A corpus prepared anew together with imported forms, in which nothing near the material stays in train; see combined().

    The blockers tie what is equal or near to them to the test split, take the place of exact copies, and are left out.
    """
    return prepare(combined(prepared, forms, material, key, surfaces, reserve), blocks=blocks, reserve=reserve)


def prepare_stats(df: DataFrame, prepared: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row: input_records, quality_rejected, duplicates_removed, near_duplicate_links.

    near_duplicate_links counts the links that join two groups when records are added in order, group, key and near links of
    each record in this order: the near edges of the minimum spanning forest under it.
    """
    scratch = Scratch(df.sparkSession, "stats")
    rows = scratch.save(facts(df), "rows")
    edges = links(rows, scratch, blocks).select("u", "v", F.col("u").alias("late"), "kind", F.col("v").alias("early")).distinct()
    near = graph.spanning_forest(edges, scratch).where("kind = 2").agg(F.count("*").alias("near_duplicate_links"))
    total = rows.agg(F.count("*").alias("input_records"), F.count_if(~F.col("ok")).alias("quality_rejected"), F.count_if("ok").alias("accepted"))
    kept = prepared.agg(F.count("*").alias("kept"))
    out = total.crossJoin(kept).crossJoin(near)  # three single rows
    return out.select("input_records", "quality_rejected", (F.col("accepted") - F.col("kept")).alias("duplicates_removed"), "near_duplicate_links")


def split_bucket_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "bucket").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("characters"))


def audit(df: DataFrame) -> DataFrame:
    """(problem, what, records): canonical duplicates, groups in several splits, unknown or empty splits, empty groups."""
    rows = df.select("rid", "group_id", "split", T.key(T.normalize("text")).alias("key"))
    # only keys that come twice are shuffled as texts
    scratch = Scratch(df.sparkSession, "audit")
    several = rows.select(digest("key").alias("d")).where("d is not null").groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    twice = sized_join(rows.select("key", digest("key").alias("d")), scratch.save(several, "several"), ["d"], "left_semi").groupBy("key").agg(F.count("*").alias("records"))
    across = rows.where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("records"), F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    wrong = rows.where(F.coalesce(~F.col("split").isin(*SPLITS), F.lit(True))).groupBy("split").agg(F.count("*").alias("records"))
    empty = rows.where("coalesce(group_id, '') = ''").agg(F.count("*").alias("records")).where("records > 0")
    parts = [
        twice.select(F.lit("duplicate key").alias("problem"), F.col("key").alias("what"), "records"),
        across.select(F.lit("group in several splits").alias("problem"), F.col("group_id").alias("what"), "records"),
        wrong.select(F.lit("split").alias("problem"), F.coalesce("split", F.lit("")).alias("what"), "records"),
        empty.select(F.lit("empty group").alias("problem"), F.lit("").alias("what"), "records"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def audit_counts(df: DataFrame) -> DataFrame:
    """(split, source, records, groups) with subtotals by split and in all; null names mark the subtotals."""
    sets = df.groupingSets([("split", "source"), ("split",), ()], "split", "source")
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("records"), F.countDistinct("group_id").alias("groups"))


def holdout_hits(df: DataFrame, key: str, text: str, heldout: DataFrame, item: str, item_text: str) -> DataFrame:
    """(item, key): texts whose canonical key is that of a held-out text; must be empty for a clean corpus."""
    held = heldout.select(F.col(item).alias("i_"), digest(T.key(T.normalize(item_text))).alias("d_")).where("d_ is not null")
    held = Scratch(df.sparkSession, "holdout").save(held, "held")
    rows = df.select(F.col(key).alias("k_"), digest(T.key(T.normalize(text))).alias("d_")).where("d_ is not null")
    return sized_join(rows, held, ["d_"]).select(F.col("i_").alias(item), F.col("k_").alias(key))


def word_counts(df: DataFrame, mixture: dict[str, float] | None = None, fitting: bool = False) -> DataFrame:
    """(word, weight): every text has equal mass in its bucket, every bucket its weight times a million.

    Words above 64 characters are not counted but take their part of the text's mass. Without mixture all buckets weigh the
    same. Raises if a bucket of the mixture has no text or a weight that is not positive and finite; fitting: also if a row
    is not of the train split.
    """
    need(df, "text", "bucket")
    if fitting:
        require_splits(df, "train")
    rows = df.select("bucket", T.words(T.normalize("text")).alias("w")).where("size(w) > 0 and bucket is not null")
    per = rows.groupBy("bucket").agg(F.count("*").alias("texts"))
    found = {r.bucket: r.texts for r in per.collect()} if mixture is not None else None
    if mixture is not None:
        for b in sorted(mixture):
            if not 0 < mixture[b] < float("inf"):
                raise ValueError(f"the weight of bucket {b} must be positive and finite")
            if b not in found:
                raise ValueError(f"no text in bucket {b}")
        spark = df.sparkSession
        weights = spark.createDataFrame([(b, w * 1e6 / found[b]) for b, w in sorted(mixture.items())], "bucket string, scale double")
    else:
        whole = per.agg(F.count("*").alias("buckets"))
        weights = per.crossJoin(whole).select("bucket", (1e6 / F.col("buckets") / F.col("texts")).alias("scale"))
    one = rows.select("bucket", (1 / F.size("w")).alias("part"), F.explode("w").alias("word")).where("length(word) <= 64")
    summed = one.groupBy("bucket", "word").agg(F.sum("part").alias("part"))
    weights = Scratch(df.sparkSession, "weights").save(weights, "weights")
    return sized_join(summed, weights, ["bucket"]).groupBy("word").agg(F.sum(F.col("part") * F.col("scale")).alias("weight"))


def paragraphs(df: DataFrame, key: str, text: str, least: int = 8, most: int = 10) -> DataFrame:
    """(key, place, paragraph): of each article the first `most` lines of at least `least` words; the cap is the feature."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("place", "paragraph"))
    lines = lines.where(F.size(T.words(F.trim(F.regexp_replace("paragraph", T.BLANK, " ")))) >= least)
    order = Window.partitionBy(key).orderBy("place")
    return lines.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def _kept_runs(texts: DataFrame, runs: DataFrame, bits: int) -> DataFrame:
    """(k, run): each of texts (k, runs) with those of its runs that are in runs (run), or fall on the bit of one that is.

    A bit for every run's last digits, BITS at most, is what each task gets; the fuller, the more runs pass that are not there.
    """
    mask = bits - 1
    places = runs.select(F.col("run").bitwiseAND(F.lit(mask)).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    held = np.zeros(bits >> 6, np.int64)
    held[words["w"].to_numpy()] = words["b"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(held)

    def keep(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            p = x & mask
            some = np.flatnonzero(sent.value[p >> 6] >> (p & 63) & 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[some])), pa.array(x[some])], ["k", "run"])

    return texts.mapInArrow(keep, f"k {texts.schema['k'].dataType.simpleString()}, run bigint")


def overlaps(df: DataFrame, key: str, text: str, benchmark: DataFrame, item: str, item_text: str, n: int = 8, least: int = 3, part: float = 0.8) -> DataFrame:
    """(item, key, kind): texts equal to a benchmark item by key (canonical), or holding at least `least` and `part` of its
    distinct runs of n canonical words (containment). Rows of one item, or of one key, are taken together.

    Runs are 64-bit hashes. Those of the benchmark filter the corpus's before anything is shuffled. A text that holds so many of
    an item's runs holds one of any size - least + 1 of them, so only texts that share one of an item's rarest runs are
    compared with it: runs that many items and texts share don't pair them.
    """
    # signs leave all words of a text at once; words of signs alone stay as empty ones
    plain = lambda t: F.lower(F.regexp_replace(t, T.NOT_KEY.replace("[^", "[^ "), ""))
    canonical = lambda c: F.when(T.normalize(c) != "", F.split(plain(T.normalize(c)), " "))
    scratch = Scratch(df.sparkSession, "overlaps")
    runs = benchmark.select(F.col(item).alias("i"), canonical(item_text).alias("w")).select("i", F.explode(T.run_hashes("w", n)).alias("run"))
    runs = scratch.save(runs.distinct(), "runs")
    per = scratch.save(runs.groupBy("run").agg(F.count("*").alias("items")), "per")
    rarest, whole = Window.partitionBy("i").orderBy("items", "run"), Window.partitionBy("i")
    ranked = sized_join(runs, per, ["run"]).select("i", "run", F.row_number().over(rarest).alias("place"), F.count("*").over(whole).alias("size"))
    ranked = scratch.save(ranked, "ranked")
    seeds = scratch.save(ranked.where(F.col("place") <= F.col("size") - F.greatest(F.lit(least), F.ceil(part * F.col("size"))) + 1).select("i", "run"), "seeds")
    texts = df.select(F.col(key).alias("k"), canonical(text).alias("w")).select("k", T.run_hashes("w", n).alias("runs"))
    bits = 1 << max(10, min(BITS.bit_length() - 1, (per.count() * 16).bit_length()))
    hits = scratch.save(_kept_runs(texts, per, bits).distinct(), "hits")
    pairs = scratch.save(sized_join(hits, seeds, ["run"]).select("i", "k").distinct(), "pairs")
    shared = sized_join(ranked.select("i", "run", "size"), pairs, ["i"]).join(hits, ["k", "run"]).groupBy("i", "k").agg(F.count("*").alias("shared"), F.first("size").alias("size"))
    held = shared.where((F.col("shared") >= least) & (F.col("shared") >= part * F.col("size")))
    equal = holdout_hits(df, key, text, benchmark, item, item_text).select(item, key, F.lit("canonical").alias("kind"))
    return held.select(F.col("i").alias(item), F.col("k").alias(key), F.lit("containment").alias("kind")).unionByName(equal).distinct()


def overlap_audit(inputs: dict[str, DataFrame], key: str, fields: tuple[str, ...], benchmark: DataFrame, item: str, surfaces: tuple[str, ...]) -> DataFrame:
    """(input, field, key, intent, kind): overlaps() of every text field of every input with every surface of the benchmark."""
    faces = benchmark.select(F.col(item).alias("intent"), F.posexplode(F.array(*[F.col(c) for c in surfaces])).alias("place", "face")).where("face is not null")
    faces = faces.select(F.struct("intent", "place").alias("item"), "face")
    texts = None
    for name, df in inputs.items():
        there = [f for f in fields if f in df.columns]
        if not there:
            raise ValueError(f"{name} has none of the fields {fields}")
        for f in there:
            one = df.select(F.struct(F.lit(name).alias("input"), F.lit(f).alias("field"), F.col(key).cast("string").alias("key")).alias("k"), F.col(f).alias("text"))
            texts = one if texts is None else texts.unionByName(one)
    return overlaps(texts, "k", "text", faces, "item", "face").select("k.input", "k.field", "k.key", "item.intent", "kind").distinct()


def group_violations(df: DataFrame, group: str, split: str) -> DataFrame:
    """(group, splits): groups found in more than one split."""
    return df.where(f"{group} is not null").groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")
