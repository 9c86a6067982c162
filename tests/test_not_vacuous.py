"""Rules that depend on what users write must both hit and miss in the SQL results."""

import os

import pytest

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
@pytest.mark.parametrize("name,condition", [
    ("guardrail_flag", "unsafe"), ("greeting_flag", "greeting"), ("extract_budget", "max_budget IS NOT NULL"),
    ("extract_limit", '"limit" <> 6'), ("constraint_filter", "final_rank > 1"),
    ("result_message", "message LIKE 'I found 0%'"), ("result_message", "message LIKE '%under $%'"),
    ("result_message", "message LIKE '%brand#%'"), ("intent_fallback", "strategy = 'category_popularity'"),
    ("rec_cold_start", "strategy = 'category_popularity'"), ("rec_cold_start", "strategy = 'demographic_popularity'"),
    ("search_catalog", "article_id IS NULL"), ("search_catalog", "explanation LIKE '% under $%'"), ("search_catalog", "price_label IS NOT NULL"),
    ("build_request", "preferred_product_group IS NOT NULL"), ("cross_score", "rank > 1")])
def test_rule_hits_and_misses(name, condition):
    import __spark_entry__ as ent
    import oracle_check
    con = oracle_check.duck(SF)
    hit, miss = con.execute(f"SELECT count(*) FILTER ({condition}), count(*) FILTER (NOT coalesce(({condition}), false)) FROM ({ent.oracle_sql()[name]})").fetchone()
    assert hit > 0 and miss > 0


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_a_budget_keeps_some_rows_and_drops_others():
    import __spark_entry__ as ent
    import oracle_check
    from tastebud.plans.oracle import with_ctes
    con = oracle_check.duck(SF)
    kept = con.execute(f"SELECT count(*) FROM ({ent.oracle_sql()['budget_filter']})").fetchone()[0]
    every = con.execute(with_ctes("SELECT count(*) FROM (SELECT DISTINCT customer_id, article_id FROM val_b)", "val_b")).fetchone()[0]
    assert 0 < kept < every
