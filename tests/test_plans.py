"""Plan shape: no nested-loop joins, filters reach the scan, ordered work is split by range."""
import pytest

from conftest import SF
from tracework.plans import load_all
from tracework.plans.registry import QUERIES
from tracework.session import ROWS_PER_RANGE

load_all()


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", [
    "join_asof_nearest", "join_broadcast_scalar", "flt_depth_gate", "agg_describe", "agg_bin_mean_two_level", "sig_cell_lines",
    "sig_common_grid", "vec_knn_mean_dist", "ret_bm25", "fus_scores", "win_margin_slice", "ml_impute_mean", "prj_wall_distance"])
def test_no_cross_join(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filter_reaches_scan(spark):
    p = plan(QUERIES["flt_fixed_gate"](spark, SF))
    assert "GreaterThanOrEqual(o_totalprice,42062.0)" in p and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def shuffles(df):
    return plan(df).split("== Physical Plan ==")[1].count("Exchange hashpartitioning")


def test_ordered_window_uses_ranges(spark):
    """With ranges: one range shuffle ahead (written), then no shuffle of the rows; only border rows are dealt by key and by range."""
    plain = shuffles(QUERIES["win_count_size"](spark, SF))
    spark.conf.set(ROWS_PER_RANGE, "100")
    try:
        ranged = QUERIES["win_count_size"](spark, SF)
    finally:
        spark.conf.unset(ROWS_PER_RANGE)
    p = plan(ranged).split("== Physical Plan ==")[1]
    assert "hashpartitioning(part" in p and "hashpartitioning(_range" in p
    assert plain == 1 and shuffles(ranged) <= plain + 1


def test_nearest_join_is_one_shuffle(spark):
    p = plan(QUERIES["join_asof_nearest"](spark, SF)).split("== Physical Plan ==")[1]
    assert p.count("Exchange hashpartitioning") == 1
