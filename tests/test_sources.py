import hashlib
import json
import zipfile

import pytest

from corpusloom.sources import files
from corpusloom.streaming import ingest


def test_jsonl_round_trip_and_guards(spark, tmp_path):
    rows = [(1, 'text "quoted" আমি\n', "b", "s", "g", None, "train"), (2, None, "b", "s", "g", None, "test")]
    df = spark.createDataFrame(rows, files.RECORD)
    counts = files.write_splits(df, f"{tmp_path}/out")
    assert {(r.split, r.records) for r in counts.collect()} == {("train", 1), ("test", 1)}
    assert sorted(files.read_jsonl(spark, f"{tmp_path}/out").select("rid", "text").collect())[0].text == rows[0][1]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_splits(df, f"{tmp_path}/out")
    (tmp_path / "bad.json").write_text('{"rid": 1}\n{"rid": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, f"{tmp_path}/bad.json").collect()


def test_csv_contract(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('id,text_transliterated,text_bengali\n1,"ami, ""ok""\nline",আমি\n2,,ভালো\n', "utf-8")
    header = ["id", "text_transliterated", "text_bengali"]
    df = files.read_csv(spark, str(p), header)
    got = files.forms(df, {"text_transliterated": "banglish", "text_bengali": "bangla"}).collect()
    assert {(r.id, r.bucket, r.text) for r in got} == {("1", "banglish", 'ami, "ok"\nline'), ("1", "bangla", "আমি"), ("2", "bangla", "ভালো")}
    with pytest.raises(ValueError, match="header"):
        files.read_csv(spark, str(p), ["id", "a", "b"])
    assert files.read_csv(spark, str(p), ["x", "y", "z"], check=False).columns == ["x", "y", "z"]


def test_zip_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ben.txt", "hello\tআমি\tCC-BY\twith tab\nbye\tবিদায়\tx\n")
        z.writestr("broken.txt", "one\ttwo\n")
        z.writestr("data/test/b.csv", "﻿purbo_bangla_speech,english_speech\nআমি,me\n".encode())
        z.writestr("data/train/a.csv", "purbo_bangla_speech,english_speech\nতুমি,you\n".encode())
    path = f"{tmp_path}/a.zip"
    got = files.read_zip_tsv(spark, path, "ben.txt", ["english", "other", "attribution"]).collect()
    assert got[0].attribution == "CC-BY\twith tab" and len(got) == 2
    for member in ("broken.txt", "missing.txt"):
        with pytest.raises(Exception):
            files.read_zip_tsv(spark, path, member, ["a", "b", "c"]).collect()
    got = files.read_zip_csv(spark, path, {"_bangla_speech": "bangla"}, 2).collect()
    assert [(r.split, r.forms) for r in got] == [("test", {"bangla": "আমি", "english_speech": "me"}), ("train", {"bangla": "তুমি", "english_speech": "you"})]
    with pytest.raises(ValueError):
        files.read_zip_csv(spark, path, {}, 3)


def test_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x").write_bytes(b"abc")
    good = {"path": "d/x", "bytes": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}
    check = lambda m: [tuple(r) for r in files.verify_manifest(spark, str(tmp_path), m).collect()]
    assert check([good]) == []
    assert check([good | {"bytes": 4}]) == [("d/x", "size")]
    assert check([good | {"sha256": "0" * 64}]) == [("d/x", "hash")]
    assert check([good, good | {"path": "d/y"}]) == [("d/y", "missing")]
    with pytest.raises(ValueError):
        check([good | {"path": "../x"}])


def test_report_is_not_overwritten(tmp_path):
    files.write_report({"a": 1}, str(tmp_path / "r"))
    assert json.loads((tmp_path / "r").read_text()) == {"a": 1}
    with pytest.raises(FileExistsError):
        files.write_report({}, str(tmp_path / "r"))


def test_stream_keeps_first_of_key(spark, tmp_path):
    schema = "rid bigint, text string, arrived_at timestamp"
    rows = [(i, t, None) for i, t in enumerate(["a long enough text", "A LONG enough text!", "short", "another long text"])]
    df = spark.createDataFrame(rows, schema)
    df.limit(2).coalesce(1).write.parquet(f"{tmp_path}/in")
    df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.records_stream(spark, f"{tmp_path}/in", df, files=1)
    got = ingest.drain(ingest.first_of_key(ingest.accepted(stream)), "t")
    assert sorted(r.key for r in got.collect()) == ["alongenoughtext", "anotherlongtext"]


def test_dataset_manifest(spark, tmp_path):
    for f in files.DATASET:
        (tmp_path / f).write_bytes(f.encode())
    hashes = {f: hashlib.sha256(f.encode()).hexdigest() for f in files.DATASET}
    check = lambda m: {tuple(r) for r in files.verify_dataset(spark, str(tmp_path), m).collect()}
    assert check(hashes) == set()
    assert check({k: v for k, v in hashes.items() if k[0] != "q"} | {"documents.jsonl": "0", "a/b": "0"}) == {("queries.jsonl", "not covered"), ("qrels.jsonl", "not covered"), ("documents.jsonl", "hash"), ("a/b", "not a name"), ("a/b", "missing")}


def test_local_paths():
    assert all(map(files.is_local, ["a", "a/b", "a/../b", "./a", "a/.."]))
    assert not any(map(files.is_local, ["", "/a", "..", "a/../..", "../a", "a\0b"]))


def test_batches_refuse_another_split(spark):
    df = spark.range(600).selectExpr("id", "'train' as split")
    assert [len(b) for b in files.batches(df, "train")] == [256, 256, 88]
    with pytest.raises(ValueError, match="'test'"):
        list(files.batches(df, "test"))


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    (tmp_path / "y.csv").write_text('a,b\n1,"x ""y"""\n2,z\n', "utf-8")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/y.csv", ["a", "b"]).collect()] == [("1", 'x "y"'), ("2", "z")]


def test_decisions_archive(spark):
    rows = spark.createDataFrame([("q1", True, True, None, "r", "human", "text")], "query_id string, pair_correct boolean, privacy_review_passed boolean, exclusion_reason string, reviewer string, reviewer_origin string, query string")
    kept = files.archive_decisions(rows)
    assert "query" not in kept.columns
    packet = spark.createDataFrame([("q1", "text"), ("q2", "more")], "query_id string, query string")
    assert {(r.query_id, r.pair_correct) for r in files.restore_decisions(packet, kept).collect()} == {("q1", True), ("q2", None)}
    with pytest.raises(ValueError, match="no query"):
        files.restore_decisions(packet.where("query_id = 'q2'"), kept)
    with pytest.raises(ValueError, match="twice"):
        files.archive_decisions(rows.unionByName(rows))


def test_replayed_batch_is_there_once(spark, tmp_path):
    write = ingest.batch_writer(f"{tmp_path}/rows")
    for number in (0, 1, 1):
        write(spark.range(3), number)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 6


def test_scratch_refuses_a_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from corpusloom.runtime import scratch_root

    conf = SimpleNamespace(get=lambda key, default=None: None, set=lambda *a: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    conf = SimpleNamespace(get=lambda key, default=None: "hdfs:///shared/")
    assert scratch_root(SimpleNamespace(conf=conf)) == "hdfs:///shared"


def test_wide_rows_are_not_broadcast(spark, tmp_path):
    from corpusloom.runtime import fits_broadcast

    spark.range(100).selectExpr("id", "repeat('x', 1000) as t").write.parquet(f"{tmp_path}/wide")
    wide = spark.read.parquet(f"{tmp_path}/wide")
    assert fits_broadcast(wide) and not fits_broadcast(wide, rows=99) and not fits_broadcast(wide, most=90_000)
