import pytest
from pyspark.sql import functions as F

from quarrymint.sources.jsonl import inventory, read_commented, read_strict, read_versioned, source_tree, split_valid, with_provenance, write_jsonl
from quarrymint.streaming.logs import run_once, running_totals, stream_table, window_counts


def text(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(path))
    return str(path)


def test_strict_scan(spark, tmp_path):
    assert [tuple(r) for r in read_strict(spark, text(spark, tmp_path / "a", ['{"a": 1}', " ", '{"a": 2}']), "a long").orderBy("a").collect()] == [(1,), (2,)]
    for bad in ("[1]", "{", '{"a": "x"}'):
        with pytest.raises(Exception):  # noqa: B017
            read_strict(spark, text(spark, tmp_path / f"b{len(bad)}", [bad]), "a long").collect()


def test_versions_and_comments(spark, tmp_path):
    p = text(spark, tmp_path / "v", ['{"schema_version": "v1", "a": 1}', '{"schema_version": "v2", "a": 2}'])
    with pytest.raises(Exception):  # noqa: B017
        read_versioned(spark, p, "schema_version string, a long", "v1").collect()
    assert read_commented(spark, text(spark, tmp_path / "c", ["# x", '{"a": 1}', ""]), "a long").count() == 1


def test_kinds_and_provenance(spark):
    df = spark.createDataFrame([("p", 1, '{"a": 1}'), ("p", 2, "[1]"), ("q", 3, "{"), ("q", 4, " "), ("q", 5, None)], "p string, i long, line string")
    assert [r["kind"] for r in split_valid(df, "line").orderBy("i").collect()] == ["object", "other", "invalid", "blank", "blank"]
    assert [r["line_number"] for r in with_provenance(df, "p", "i").orderBy("i").collect()] == [1, 2, 1, 2, 3]


def test_write_is_deterministic_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "b long, a string")
    for name in ("x", "y"):
        write_jsonl(df, str(tmp_path / name), ["b"])
    lines = lambda n: sorted(r["value"] for r in spark.read.text(str(tmp_path / n)).collect())
    assert lines("x") == lines("y") == ['{"a":"x","b":1}', '{"b":2}']
    write_jsonl(df, str(tmp_path / "x"), ["b"], "append")
    assert len(lines("x")) == 4
    assert all(len(r["sha256"]) == 64 and r["bytes"] > 0 for r in inventory(spark, str(tmp_path / "x"), "*.txt").where("bytes > 0").collect())


def test_source_tree_leaves_out(spark, tmp_path):
    for p, data in (("a.py", b"x = 1\n"), ("__pycache__/b.py", b"y"), ("c.txt", b"z"), ("d.py", b"\xff\xfe\x80")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(data)
    assert [r["source"] for r in source_tree(spark, str(tmp_path)).collect()] == ["x = 1\n"]


def test_streams_equal_batches(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts, id % 3 as k, cast(id as double) as x from range(300)")
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    path = str(tmp_path / "e")
    got = run_once(window_counts(stream_table(spark, path), "ts", ["k"], "x", "1 hour"), "complete")
    want = df.groupBy(F.window("ts", "1 hour"), "k").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    assert {tuple(r) for r in got.select("window.start", "k", "n", "total").collect()} == {tuple(r) for r in want.select("window.start", "k", "n", "total").collect()}
    got = run_once(running_totals(stream_table(spark, path), "k", "x"), "update", ["k"])
    assert {tuple(r) for r in got.select("k", "n", "total").collect()} == {tuple(r) for r in df.groupBy("k").agg(F.count("*"), F.sum("x")).collect()}
