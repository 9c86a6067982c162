"""Plan guards: no registered query plans a Cartesian product or nested-loop join."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def _names():
    from tastebud.plans.registry import QUERIES, load_all
    load_all()
    return sorted(QUERIES)


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
@pytest.mark.parametrize("name", _names())
def test_no_cartesian(spark, name):
    from tastebud.plans.registry import QUERIES
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan[:2000]


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_the_split_window_reaches_the_scan(spark):
    """The preprocess stage reads dates alone for the anchor, and then only row groups of the window."""
    from tastebud.operators import clean as C
    from tastebud.plans.frames import Frames
    f = Frames(spark, SF)
    _, anchor = C.split_anchor(f.raw_transactions)
    rows = C.kept_interactions(C.windowed_interactions(f.raw_transactions, f.items, anchor))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan, plan[:3000]


def test_catalog_ids_are_not_collected_for_the_reject_reasons(spark):
    """Their files may be a few MB where the ids are a GB in memory, so no size estimate may send them to the driver."""
    from tastebud.operators import clean as C
    raw = spark.createDataFrame([("u", "1", "2024-01-02", "1.0", "1"), ("u", None, "2024-01-02", "1.0", "1"), ("v", "9", "2024-01-03", "1.0", "1")],
                                "customer_id string, article_id string, t_dat string, price string, sales_channel_id string")
    labelled = C.labelled_interactions(raw, spark.range(3).selectExpr("cast(id as string) article_id"))
    assert "BroadcastHashJoin" not in labelled._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.article_id or "", r.reject_reason) for r in labelled.collect()) == [("", "missing"), ("1", None), ("9", "orphan")]
    assert "BroadcastHashJoin" not in labelled._jdf.queryExecution().executedPlan().toString()
