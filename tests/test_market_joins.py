"""Joins of markets do not send what grows with the tables through the driver."""

from skytally.operators import markets as M
from skytally.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listed_markets_are_not_broadcast(spark, views):
    """Each open market is listed under dozens of cells, which Spark's estimate does not count."""
    got = plan(M.unique_market(views.preds, views.markets))
    assert "SortMergeJoin" in got and "BroadcastHashJoin" not in got


def test_interval_confidence_broadcasts_the_calibration_alone(spark):
    got = plan(catalog.QUERIES["mkt4_joi13_interval_confidence"](spark, SF))
    assert got.count("SortMergeJoin") == 2 and got.count("BroadcastHashJoin") <= 1
