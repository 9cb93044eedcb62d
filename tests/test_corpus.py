import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.operators import graph
from corpusloom.runtime import Scratch

TWELVE = "one two three four five six seven eight nine ten eleven twelve"
SCHEMA = "rid bigint, text string, bucket string, source string, group_id string, attribution string, split string"
GOLDEN = [
    (0, "  Café   has good coffee  ", "english", "fixture", "solo", "A&B", None),
    (1, TWELVE, "english", "fixture", "z-near", None, "train"),
    (2, " ".join(reversed(TWELVE.split())), "english", "fixture", "y-near", None, "validation"),
    (3, "tiny bridge", "english", "fixture", "y-near", None, None),
    (4, "TINY BRIDGE!", "english", "fixture", "a-heldout", None, "test"),
    (5, "আমি আজ অনেক ভালো আছি", "bangla", "fixture", "a-heldout", None, None),
    (6, TWELVE.upper() + "!!!", "english", "duplicate", "copy", None, None),
    (7, "A separate validation sentence", "english", "fixture", "validation-only", None, "validation"),
    (8, "Please email person@example.com", "english", "fixture", "private", None, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_golden(spark):
    df = frame(spark, GOLDEN)
    out = C.prepare(df, strict=True)
    got = {r.rid: (r.text, r.group_id, r.split) for r in out.collect()}
    assert set(got) == {0, 1, 2, 4, 5, 7}
    assert got[0] == ("Café has good coffee", "solo", "train")
    assert all(got[i][1:] == ("a-heldout", "test") for i in (1, 2, 4, 5))
    assert got[7][2] == "validation"
    assert C.prepare_stats(df, out).collect()[0].asDict() == {"input_records": 9, "quality_rejected": 2, "duplicates_removed": 1, "near_duplicate_links": 1}
    counts = {(r.split, r.bucket): (r.records, r.characters) for r in C.split_bucket_counts(out).collect()}
    assert counts == {("test", "bangla"): (1, 20), ("test", "english"): (3, 136), ("train", "english"): (1, 20), ("validation", "english"): (1, 30)}


def test_rejected_rows_bridge(spark):
    rows = [(0, "tiny", "b", "s", "z-train", None, "train"), (1, "TINY!", "b", "s", "a-test", None, "test"), (2, "a text that is long enough", "b", "s", "z-train", None, None)]
    assert [(r.rid, r.group_id, r.split) for r in C.prepare(frame(spark, rows)).collect()] == [(2, "a-test", "test")]


def test_filter_before_dedupe(spark):
    rows = [(0, "password = value here", "b", "s", "a", None, None), (1, "password value here", "b", "s", "b", None, "test"), (2, "PASSWORD VALUE HERE", "b", "s", "c", None, None)]
    assert [(r.rid, r.split) for r in C.prepare(frame(spark, rows)).collect()] == [(1, "test")]


def test_first_error_by_rid(spark):
    rows = [(0, "x", "b", "s", "g", None, None), (2, "y", "b", "s", "g", None, "other"), (1, "z", "b", "s", "", None, None)]
    with pytest.raises(ValueError, match="record 1"):
        C.prepare(frame(spark, rows), strict=True)
    with pytest.raises(ValueError, match="unknown split"):
        C.prepare(frame(spark, rows[:2]), strict=True)


def test_empty(spark):
    assert C.prepare(frame(spark, [])).count() == 0


def test_text_functions(spark):
    rows = [("Café!", "café", None), ("ami আমি 5", "plain", "plain")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = df.select(T.key(T.normalize("a")).alias("a"), T.key(T.normalize("b")).alias("b"), T.key(T.normalize("c")).alias("c"), *[v.alias(k) for k, v in T.script_features("a").items()]).collect()
    assert got[0].a == got[0].b == "café" and got[0].c is None
    assert got[1].mixed and got[1].has_digit and not got[0].mixed
    assert df.limit(1).select(T.hash_split(F.lit("solo"))).first()[0] == "train"


@pytest.mark.parametrize("text", ["Call 01712345678 now", "password = notasecret", "a@b.co and more words", "lost � character here"])
def test_not_acceptable(spark, text):
    df = C.normalized(spark.createDataFrame([(1, text)], "rid bigint, text string"))
    assert not df.first().ok


def test_simhash_without_order_and_short(spark):
    df = spark.createDataFrame([(TWELVE,), (" ".join(reversed(TWELVE.split())),), ("too few words",)], "t string")
    a, b, c = [r[0] for r in df.select(T.simhash64("t")).collect()]
    assert a == b and c is None


def test_near_hashes_find_all(spark):
    import random

    rng = random.Random(1)
    hs = [rng.getrandbits(64) for _ in range(60)]
    hs += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for h in hs]
    signed = [h - (1 << 64) if h >> 63 else h for h in hs]
    df = spark.createDataFrame([(h,) for h in signed], "h bigint")
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    for blocks in (4, 6):
        assert {(r.a, r.b) for r in C.near_hashes(df, blocks=blocks).collect()} == want


@pytest.mark.parametrize("few", [0, 40, 10_000])
def test_components_of_long_chain(spark, few):
    import random

    n, rng = 300, random.Random(3)
    names = rng.sample(range(10_000), n)
    edges = list(zip(names, names[1:]))
    got = graph.roots(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t"), few).collect()
    assert len(got) == n - 1 and {r.root for r in got} == {min(names)}


@pytest.mark.parametrize("few", [0, 30, 10_000])
def test_components_of_random_graph(spark, few):
    import random

    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r.label: r.root for r in graph.roots(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t"), few).collect()}
    assert got == {x: find(x) for x in {x for e in edges for x in e} if find(x) != x}
    assert graph.roots(spark.createDataFrame([], "u bigint, v bigint"), Scratch(spark, "t"), few).count() == 0


def test_spanning_forest_is_kruskals(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40), i) for i in rng.sample(range(1000), 120)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = list(range(40))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = set()
    for u, v, w in sorted(edges, key=lambda e: e[2]):
        if find(u) != find(v):
            parent[find(u)] = find(v)
            want.add(w)
    got = graph.spanning_forest(spark.createDataFrame(edges, "u bigint, v bigint, w bigint"), Scratch(spark, "t")).collect()
    assert {r.w for r in got} == want


def test_near_links_match_union_find(spark):
    """Against the definition: records one by one, linked by group, key and near hashes of any earlier record."""
    import random

    rng, vocabulary = random.Random(7), [f"w{i}" for i in range(30)]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=14) if rng.random() < 0.5 or not rows else rng.choice(rows)[1].split()
        words = words[:]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "b", "s", f"g{rng.randrange(50)}", None, None))
    df = C.normalized(frame(spark, rows))
    hashes = {r.rid: r.h & (1 << 64) - 1 for r in C.hashed(df).collect()}
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i, *_ in rows:
        for j in range(i):
            if rows[i][4] == rows[j][4] or rows[i][1] == rows[j][1]:
                parent[find(i)] = find(j)
        for j in range(i):
            if bin(hashes[i] ^ hashes[j]).count("1") <= 3 and find(i) != find(j):
                links, parent[find(i)] = links + 1, find(j)
    assert links > 3
    assert C.prepare_stats(frame(spark, rows), C.prepare(frame(spark, rows))).first().near_duplicate_links == links


def test_word_counts(spark):
    rows = [(b, "ami tumi se") for b in ("bangla", "banglish", "english", "code-mixed")]
    df = spark.createDataFrame(rows, "bucket string, text string")
    got = C.word_counts(df, {"bangla": 0.4, "banglish": 0.25, "english": 0.25, "code-mixed": 0.1}).collect()
    assert len(got) == 3 and all(abs(r.weight - 1e6 / 3) < 1e-3 for r in got)
    with pytest.raises(ValueError, match="no text"):
        C.word_counts(df, {"french": 1.0})
    with pytest.raises(ValueError, match="positive"):
        C.word_counts(df, {"bangla": 0.0})


def test_audit_finds_corruption(spark):
    rows = [(0, "same text here", "b", "s", "g", None, "train"), (1, "SAME text, here", "b", "s", "g", None, "test"), (2, "other", "b", "s", "", None, "nowhere")]
    assert {r.problem for r in C.audit(frame(spark, rows)).collect()} == {"duplicate key", "group in several splits", "split", "empty group"}


def test_overlap_kinds(spark):
    item = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, f"prefix words {item} suffix"), (2, item.upper()), (3, "a b c d e f g h"), (4, None)], "d bigint, t string")
    items = spark.createDataFrame([(9, item), (8, None)], "i bigint, x string")
    got = {(r.d, r.kind) for r in C.overlaps(docs, "d", "t", items, "i", "x").collect()}
    assert got == {(1, "containment"), (2, "containment"), (2, "canonical")}


def test_every_number_of_blocks_finds_the_same_pairs(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = base + [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for h in base for _ in range(2)]
    signed = [h - (1 << 64) if h >> 63 else h for h in set(values)]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    df = spark.createDataFrame([(h,) for h in signed], "h bigint")
    for blocks in (None, 4, 5, 8):
        assert {tuple(r) for r in C.near_hashes(df, blocks=blocks).collect()} == want
    assert [C.blocks_for(n) for n in (10**3, 10**6, 10**9, 10**12)] == sorted(C.blocks_for(n) for n in (10**3, 10**6, 10**9, 10**12)) and C.blocks_for(10**9) >= 5


def test_overlaps_do_not_pair_by_common_runs(spark):
    from test_retrieval import shuffled

    common = "a b c d e f g h i j"
    items = spark.range(1500).selectExpr("id as i", f"concat('{common} ', concat_ws(' ', transform(sequence(1, 12), x -> concat('w', id, 'x', x)))) as x")
    docs = spark.range(1500).selectExpr("id as d", f"concat('{common} ', concat_ws(' ', transform(sequence(1, 12), x -> concat(if(id < 3, 'w', 'v'), id, 'x', x)))) as t")
    before = shuffled(spark)
    got = C.overlaps(docs, "d", "t", items, "i", "x").where("kind = 'containment'").collect()
    assert sorted((r.i, r.d) for r in got) == [(0, 0), (1, 1), (2, 2)] and shuffled(spark) - before < 3_000_000  # 2.25 million pairs share a run


def test_overlaps_take_rows_of_a_key_together(spark):
    words = [f"w{i}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(words))], "i int, x string")
    docs = spark.createDataFrame([(1, " ".join(words[:14])), (1, " ".join(words[:14])), (2, " ".join(words[:13])), (2, " ".join(words[5:]) + " !"), (3, "? " + " ".join(words[:9]))], "d int, t string")
    assert [(r.i, r.d, r.kind) for r in C.overlaps(docs, "d", "t", items, "i", "x").collect()] == [(1, 2, "containment")]
