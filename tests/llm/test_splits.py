import random

from corpusloom.llm import splits as S

SCHEMA = "rid bigint, group_id string, source string, split string, bucket string"


def sets(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    plain = lambda s: "".join(s.split()).lower() if s else ""
    for rid, g, s, *_ in rows:
        find(("r", rid))
        for kind, v in (("g", plain(g)), ("s", plain(s) if ":" in plain(s).strip(":") else "")):
            if v:
                parent[find((kind, v))] = find(("r", rid))
    return {r[0]: find(("r", r[0])) for r in rows}


def random_rows(n, seed):
    rng = random.Random(seed)
    spell = lambda s: rng.choice([s, s.upper(), f" {s}", s.replace(":", ": ")]) if s else s
    rows = []
    for i in range(n):
        g = rng.choice([None, "", " ", f"g:{rng.randrange(n)}", "g:hot" if i % 3 == 0 else f"h{rng.randrange(n)}"])
        s = rng.choice([None, "collection", f"work:{rng.randrange(n // 2)}", "also-collection:"])
        rows.append((i, spell(g), spell(s), rng.choice([None, "", "train", "TRAIN", " test", "validation"] + [None] * 12), rng.choice(["a", "b", None])))
    return rows


def test_found_against_union_find(spark):
    for seed in (1, 2):
        rows = random_rows(400, seed)
        of, seen = sets(rows), {}
        for r in rows:
            if r[3] and r[3].strip():
                seen.setdefault(of[r[0]], set()).add(r[3].strip().lower())
        want = {r[0] for r in rows if len(seen.get(of[r[0]], ())) > 1}
        got = {r.rid for r in S.contradictory(spark.createDataFrame(rows, SCHEMA), "rid", "group_id", "source", "split").collect()}
        assert got == want and want


def test_long_chain(spark):
    # record i ties group i to work i, record i' ties group i + 1 to work i
    rows = [(2 * i + j, f"g{i + j}", f"w:{i}", "train" if i + j == 0 else "test" if i + j == 80 else None, "a") for i in range(80) for j in (0, 1)]
    assert S.contradictory(spark.createDataFrame(rows, SCHEMA), "rid", "group_id", "source", "split").count() == 160


def test_splits_keep_sets_and_shares(spark):
    rows = random_rows(6000, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.assign_splits(df, "rid", "group_id", "source", "bucket", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(got) == 6000 and {r.rid for r in got} == set(range(6000))
    of, per = sets(rows), {}
    for r in got:
        per.setdefault(of[r.rid], set()).add((r.split, r.set_id))
    assert all(len(x) == 1 for x in per.values())
    largest = max(sum(of[r[0]] == x for r in rows) for x in set(of.values())) / 6000
    for split, part in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        for label in ("a", "b", None):
            mine = [r for r in got if rows[r.rid][4] == label]
            assert abs(sum(r.split == split for r in mine) / len(mine) - part) < max(0.03, largest / 2)
    again = S.assign_splits(df.repartition(5), "rid", "group_id", "source", "bucket", {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_defined_for_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.contradictory(empty, "rid", "group_id", "source", "split").count() == 0
    assert S.assign_splits(empty, "rid", "group_id", "source", "bucket").count() == 0
    clash = spark.createDataFrame([(1, "g", None, "train", None, 7, "x"), (2, "G ", None, "test", None, 7, "x")], SCHEMA + ", k int, root string")
    assert S.contradictory(clash, "rid", "group_id", "source", "split").count() == 2
    assert S.assign_splits(clash, "rid", "group_id", "source", "bucket").select("split").distinct().count() == 1


def test_deviation_is_balanced(spark):
    """Sets of several labels and sizes: each label comes within a set's size of its share; every label counts, however many."""
    rng, rows, rid = random.Random(4), [], 0
    for n in range(1500):
        labels = [f"l{min(int(rng.expovariate(0.4)), 9)}"] if n % 4 else rng.sample([f"l{i}" for i in range(10)], 2)
        for _ in range(rng.choice((1, 1, 1, 2, 5))):
            rows.append((rid, f"g{n}", None, None, rng.choice(labels)))
            rid += 1
    rows += [(rid + i, None, None, None, f"rare{i % 40}") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    made = S.assign_splits(df, "rid", "group_id", "source", "bucket", shares)
    got = S.deviation(df, "rid", "bucket", made, shares).collect()
    assert len(got) == 3 * 50 and sum(r.records for r in got) == len(rows)
    assert max(abs(r.deviation) for r in got) <= 5
