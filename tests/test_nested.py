import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrymint.operators.nested import child_table, decoded, fitted, flat_tables, infer_json, merge_shapes, parse_json_lines, shape_of, spark_type, strict_json
from quarrymint.plans import nested_queries
from tests.oracle import same

SCHEMA = "id long, ordinal string, a struct<x:long, items:array<struct<v:string, ordinal:int, deep:array<long>>>>, m map<string,long>, nested array<array<int>>"
ROWS = [
    (1, "q", (5, [("p", 7, [1, None]), None, ("r", None, [])]), {"b": 2, "a": 1}, [[1, 2], None, []]),
    (2, None, None, None, None),
    (3, "z", (None, []), {}, []),
]


def test_children_keep_parent_and_place(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    t = flat_tables(df, "id")
    assert set(t) == {"root", "root__a__items", "root__a__items__deep", "root__m", "root__nested", "root__nested__[]"}
    assert [tuple(r) for r in t["root"].orderBy("row_key").collect()] == [("1", "q", 5), ("2", None, None), ("3", "z", None)]
    items = t["root__a__items"]
    assert items.columns == ["parent_key", "ordinal", "row_key", "root_key", "positions", "v", "ordinal_"]
    assert [(r["row_key"], r["ordinal"], r["v"], r["ordinal_"]) for r in items.orderBy("ordinal").collect()] == [("1/1", 1, "p", 7), ("1/2", 2, None, None), ("1/3", 3, "r", None)]
    assert [(r["parent_key"], r["ordinal"], r["value"]) for r in t["root__a__items__deep"].orderBy("ordinal").collect()] == [("1/1", 1, 1), ("1/1", 2, None)]
    assert [(r["key"], r["value"]) for r in t["root__m"].orderBy("ordinal").collect()] == [("a", 1), ("b", 2)]
    assert [(r["parent_key"], r["value"]) for r in t["root__nested__[]"].orderBy("row_key").collect()] == [("1/1", 1), ("1/1", 2)]


def test_empty_table_and_wrong_path(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert all(t.count() == 0 for t in flat_tables(df, "id").values())
    with pytest.raises(ValueError):
        child_table(df, "id", ("ordinal",))


def test_children_read_only_their_columns(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "t"))
    t = child_table(spark.read.parquet(str(tmp_path / "t")), "id", ("a", "items")).select("root_key", "v")
    plan = t._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "nested" not in schema and "deep" not in schema


LINES = ['{"h": {"x": 1}}', '{"h": [{"x": "t"}, null]}', '{"h": "[{\\"x\\": 2}]"}', '"{\\"h\\": {\\"x\\": [1]}}"', '{"record": {"h": {"x": true}}}', '{"h": null, "record": "{\\"h\\": {\\"x\\": 0}}"}', "null", "3", "[]", "{", "", None, '{"h": NaN}', '{"k": {}}']


def test_merged_schema_of_json_lines(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "id long, line string")
    schema = infer_json(df, "line", ("record",))
    assert schema.simpleString() == "struct<h:array<struct<x:string>>,k:string>"
    rows = {r["id"]: r["h"] for r in parse_json_lines(df, "id", "line", schema, ("record",)).collect()}
    assert set(rows) == {0, 1, 2, 3, 4, 5, 13}
    assert [x and x["x"] for x in rows[1]] == ["t", None]
    assert [rows[i][0]["x"] for i in (0, 2, 3, 4, 5)] == ["1", "2", "[1]", "true", "0"]


def test_lines_without_objects_and_key_clash(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, line string")
    assert parse_json_lines(df, "id", "line").count() == 0
    df = spark.createDataFrame([(1, '{"ID": 5, "y": 1}')], "id long, line string")
    assert [tuple(r) for r in parse_json_lines(df, "id", "line").collect()] == [(1, 5, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_merging_shapes_does_not_depend_on_order(seed):
    rnd = random.Random(seed)

    def value(d):
        kind = rnd.randrange(8 if d else 5)
        return [None, 1, 1.5, "s", True][kind] if kind < 5 else [value(d - 1) for _ in range(rnd.randrange(3))] if kind < 6 else {rnd.choice("abc"): value(d - 1) for _ in range(rnd.randrange(3))}

    values = [value(3) for _ in range(8)]
    kinds = set()
    for _ in range(6):
        rnd.shuffle(values)
        total = {"k": []}
        for v in values:
            total = merge_shapes(total, shape_of(v))
        kinds.add(spark_type(total).simpleString())
        for v in values:
            json.dumps(fitted(v, spark_type(total)))
    assert len(kinds) == 1


def test_strict_json_and_decoding():
    for bad in ("NaN", "[Infinity]", "{", "", "[" * 100_000):
        with pytest.raises(ValueError):
            strict_json(bad)
    assert decoded('"[1, \\"{\\\\\\"a\\\\\\": null}\\"]"') == [1, {"a": None}]
    assert strict_json("1" * 5000) == float("inf")


GOOD = '{"failure_hints": [{"assertions": [{"expected": 1}, {"expected": null}]}]}'
ODD = {
    "wide line": json.dumps({f"a{i}": i for i in range(300)}),
    "wide hint": json.dumps({"failure_hints": [{f"a{i}": {"b": i} for i in range(300)}]}),
    "scalar hint": '{"failure_hints": ["plain", 3]}',
    "scalar assertion": '{"failure_hints": [{"assertions": ["plain", {"expected": 2}]}]}',
    "letter case": '{"Failure_Hints": 1, "failure_hints": [{"Assertions": 2}]}',
    "nested lists": '{"failure_hints": [[{"assertions": [[{"expected": 3}]]}]]}',
    "list expected": '{"failure_hints": [{"assertions": [{"expected": [1, {"x": 2}]}]}]}',
    "no lists": '{"failure_hints": {"assertions": {"expected": {"": 5, "a.b": 6}}}, "": 1, "a.b": 2, "_rest": 3}',
}


@pytest.mark.parametrize("odd", sorted(ODD))
def test_one_odd_line_leaves_the_others(spark, tmp_path, odd):
    """The cases of p6 equal its SQL; the merged schema keeps the other line's table too."""
    lines = [(1, GOOD), (2, ODD[odd])]
    df = spark.createDataFrame(lines, "line_id long, line string")
    df.write.parquet(str(tmp_path / "outcome_log.parquet"))
    for t, kind in (
        ("candidate_outcomes", "candidate_id long, failure_hints array<struct<assertions:array<struct<expected:string>>>>, overlapping_candidate_ranks array<long>"),
        ("prompt_repo_transitions", "id string, outcome struct<status:string>"),
    ):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{t}.parquet"))
    con = duckdb.connect()
    for p in tmp_path.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    got = nested_queries.p6_found(spark, str(tmp_path))
    assert ("log_assertion", "1", 1, 1) in [tuple(r) for r in got.collect()]
    same(got, con, nested_queries.ORACLE["p6_found"])


def test_odd_values_keep_their_place_and_text(spark):
    lines = ['{"h": [{"x": 1}, "s"]}', '{"h": 7}', json.dumps({f"a{i}": i for i in range(300)})]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    log = parse_json_lines(df, "id", "line")
    rows = [tuple(r) for r in child_table(log, "id", ("h",)).select("row_key", "x", "_rest").orderBy("row_key").collect()]
    assert rows == [("0/1", 1, None), ("0/2", None, "s"), ("1/1", None, "7")]
    assert len(log.columns) == 258
    wide = log.where("id = 2").first().asDict()
    values = {k: v for k, v in wide.items() if k[0] == "a"} | json.loads(wide["_rest"])
    assert {k: v for k, v in values.items() if v is not None} == {f"a{i}": i for i in range(300)}
    clash = parse_json_lines(spark.createDataFrame([(1, '{"h": 7, "H": 2, "ID": 3, "id_": 4}')], "id long, line string"), "id", "line")
    assert clash.first().asDict() == {"id": 1, "h": 7, "H_": 2, "ID_": 3, "id__": 4}
