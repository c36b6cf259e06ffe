import json

import pytest
from pyspark.sql import functions as F

from quarrymint.operators.validation import read_model, refused, violations



def rules():
    return {"positive": F.col("x") > 0, "named": F.trim("n") != ""}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 1.0, "a"), (2, -1.0, " "), (3, None, "c"), (4, 2.0, None)], "id long, x double, n string")


def test_a_rule_that_is_not_met_or_null_is_broken(rows):
    assert sorted(tuple(r) for r in violations(rows, "id", rules()).collect()) == [(2, "named"), (2, "positive"), (3, "positive"), (4, "named")]
    assert violations(rows.where("false"), "id", rules()).count() == 0


def test_rows_that_break_a_rule_are_refused(rows):
    assert refused(rows.where("id = 1"), rules()).count() == 1
    with pytest.raises(Exception, match="rule broken: named"):
        refused(rows.where("id = 4"), rules()).collect()


@pytest.mark.parametrize("change", [{}, {"format": "other"}, {"version": 2}, {"dim": 3}, {"rows": [{"id": 1, "v": [1.0]}]}])
def test_model_documents(spark, tmp_path, change):
    doc = {"format": "f", "version": 1, "dim": 2, "rows": [{"id": 1, "v": [1.0, 2.0]}]} | change
    (tmp_path / "m.json").write_text(json.dumps(doc))
    read = lambda: read_model(spark, f"file://{tmp_path}", "id: bigint, v: array<double>", "f", 1, 2).collect()
    if not change:
        assert [r["v"] for r in read()] == [[1.0, 2.0]]
    else:
        with pytest.raises(Exception, match="rule broken"):
            read()
