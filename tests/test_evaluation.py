import math

import pytest

from tastebud.operators import evaluate as E


def _recs(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, rank long, article_id string")


def _truth(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, article_id string")


def test_average_precision_quarter(spark):
    recs = _recs(spark, [("u", 1, "a"), ("u", 2, "b"), ("u", 3, "c"), ("u", 4, "d")])
    truth = _truth(spark, [("u", "d"), ("u", "z")])
    m = E.per_user_metrics(recs, truth, 4).first()
    assert m.map_at_k == pytest.approx(0.125)  # one hit at rank 4: (1/4) / min(2, 4)
    assert m.ndcg_at_k == pytest.approx((1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert m.hit_rate_at_k == 1.0


def test_duplicates_count_once_and_empty_list_scores_zero(spark):
    recs = _recs(spark, [("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b")])
    truth = _truth(spark, [("u", "b"), ("v", "b")])
    users = spark.createDataFrame([("u",), ("v",)], "customer_id string")
    ev = E.evaluate_rankings(recs, truth, 2, rec_users=users).first()
    assert ev.users_evaluated == 2
    assert ev.hit_rate_at_k == pytest.approx(0.5)  # u: b is at deduped rank 2; v: empty list


def test_no_users(spark):
    recs = _recs(spark, [("u", 1, "a")])
    ev = E.evaluate_rankings(recs, _truth(spark, [("x", "a")]), 12).first()
    assert (ev.users_evaluated, ev.ndcg_at_k) == (0, 0.0)


def test_fresh_metrics(spark):
    recs = _recs(spark, [("u", 1, "f1"), ("u", 2, "a"), ("v", 1, "a")])
    fresh = spark.createDataFrame([("f1",), ("f2",)], "article_id string")
    m = E.fresh_metrics(recs, fresh, 12).first()
    assert m.fresh_coverage_at_k == pytest.approx(0.5)
    assert m.fresh_share_at_k == pytest.approx(0.25)
    assert m.users_with_fresh_hit_at_k == pytest.approx(0.5)


def test_bootstrap_repeatable(spark):
    pu = spark.createDataFrame([(f"u{i}", i / 10, i / 20, float(i % 2)) for i in range(10)],
                               "customer_id string, ndcg_at_k double, map_at_k double, hit_rate_at_k double")
    a = sorted(E.bootstrap_ci(pu, 50, 0.9, 7).collect())
    b = sorted(E.bootstrap_ci(pu, 50, 0.9, 7).collect())
    assert a == b
    for r in a:
        assert r.lower <= r.upper
    with pytest.raises(ValueError):
        E.bootstrap_ci(pu, 0)


def test_catalog_coverage(spark):
    recs = _recs(spark, [("u", 1, "a"), ("v", 1, "a"), ("v", 2, "b")])
    assert E.catalog_coverage(recs, 4, 12).first()[0] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        E.catalog_coverage(recs, 0, 12)
