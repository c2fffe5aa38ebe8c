"""What the plans must keep: pruned scans, one aggregate for all traits, an equality join for the window."""

import re

from pyspark.sql import functions as F

from helixframe import queries
from helixframe.operators import gwas, ld

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_regression_is_one_aggregate_over_a_pruned_scan(spark):
    cells, totals = gwas.centred_cells(queries.cells(spark, SF), ["y1", "y2"])
    text = plan(gwas.regress_cells(cells, totals, p_values=False))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    assert re.findall(r"ReadSchema: (\S+)", text) == ["struct<l_partkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double>"]


def test_window_join_has_equality_keys(spark):
    text = plan(ld.window_pairs(queries.markers(spark)))
    assert not re.search("Cartesian|NestedLoop", text) and re.search("HashJoin|SortMergeJoin", text)


def test_filters_reach_the_scan(spark):
    text = plan(queries.table(spark, SF, "customer").where(F.col("c_acctbal") > 0).select("c_custkey"))
    assert "GreaterThan(c_acctbal,0.0)" in text
