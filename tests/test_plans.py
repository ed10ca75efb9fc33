"""Shape of the physical plans."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as contract
from sightline.plans import all_queries
from sightline.sources import tables as tb
from tests.conftest import SMALL

QUERIES, _ = all_queries()
KEYS = ("fidelity_features", "point_grid_join", "nearest_line", "point_in_polygon", "predict_draws", "cross_grid",
        "densify", "assign_nearest", "label_sightings", "jolly_seber", "pixel_rwpci", "global_max", "model_grid")


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("key", KEYS)
def test_no_cross_join_and_no_python_rows(spark, key):
    text = plan(QUERIES[key](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in text


def test_fidelity_reads_only_its_columns(spark):
    text = plan(QUERIES["fidelity_features"](spark, SMALL))
    schemas = {line.strip() for line in text.splitlines() if line.strip().startswith("ReadSchema")}
    assert schemas == {  # the sightings, and the calendar
        "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>", "ReadSchema: struct<o_orderdate:timestamp_ntz>",
    }


def test_date_filter_reaches_the_files(spark):
    text = plan(QUERIES["scan_matrix"](spark, SMALL).filter("sdate >= DATE'1998-01-01'"))
    assert "GreaterThanOrEqual(sdate,1998-01-01)" in text and "age_class" not in text.split("ReadSchema")[1]


def test_delimited_with_a_leading_row_number(spark, tmp_path):
    path = tmp_path / "depth.txt"
    path.write_text("1 0.5 1.5 -2.25\n2 0.5 3.5 7\n")
    out = tb.scan_delimited(spark, str(path), tb.T.StructType([tb.T.StructField("row", tb.T.IntegerType()), *tb.GRID_SCHEMA.fields]))
    assert [tuple(r) for r in out.orderBy("row").collect()] == [(1, 0.5, 1.5, -2.25), (2, 0.5, 3.5, 7.0)]


def test_contract(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and df.columns[0] == "id"
    assert set(contract.oracle_sql()) <= set(contract.queries())
