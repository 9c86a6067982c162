"""Joins with tables that grow with the input: same rows on every path, and no side sent whole through the driver."""

import pytest

from tastebud.operators import similar as SIM


def _plan(df):
    df.collect()  # the final plan, after measured sizes are known
    return df._jdf.queryExecution().executedPlan().toString()


def _weights(spark):
    rows = [(f"a{i}", t, 1.0 / (1 + (i * k) % 5)) for i in range(12) for k, t in enumerate(("x", "y", "z")) if (i + k) % 3]
    return rows, spark.createDataFrame(rows, "article_id string, term string, weight double")


@pytest.mark.parametrize("few", (0, 50_000))
def test_pair_scores_meet_the_lists_in_parts_or_where_they_lie(spark, monkeypatch, few):
    monkeypatch.setattr(SIM, "FEW_TERMS", few)
    monkeypatch.setattr(SIM, "POSTINGS", 3)
    rows, weights = _weights(spark)
    queries = spark.createDataFrame([("a1",), ("a4",), ("a4",), ("none",)], "article_id string")
    own = {}
    for a, t, w in rows:
        own.setdefault(a, {})[t] = w
    want = {(q, a): sum(w * own[a][t] for t, w in own[q].items() if t in own[a])
            for q in ("a1", "a4") for a in own if a != q and set(own[q]) & set(own[a])}
    scored = SIM.pair_scores(weights, queries)
    got = {(r.query_article_id, r.article_id): r.score for r in scored.collect()}
    assert got == pytest.approx(want) and len(want) > 10
    assert ("SortMergeJoin [term" in _plan(scored)) == (not few)


def test_weights_meet_the_query_articles_by_key(spark):
    _, weights = _weights(spark)
    terms = SIM.query_terms(weights, spark.createDataFrame([("a1",)], "article_id string"))
    assert "SortMergeJoin [article_id" in _plan(terms)


@pytest.mark.parametrize("bands", (1000, 1))
def test_budget_search_reads_the_first_items_of_each_price_band(spark, monkeypatch, bands):
    from tastebud.operators import search as S
    monkeypatch.setattr(S, "BANDS", bands)
    items = [(f"a{i:02d}", ("Small", "Large")[i % 2], f"Ring{i % 3}") for i in range(40)]
    score = {a: float(7 * i % 11) for i, (a, _, _) in enumerate(items) if i % 4}
    price = {a: 13 * i % 29 for i, (a, _, _) in enumerate(items) if i % 5}
    asked = [("q1", "find small", 10.0), ("q2", "small", None), ("q3", "small things", 5.0), ("q4", "large", 10.5), ("q5", "smalls", 10.0), ("q6", "small", 0.0)]
    out = S.search_catalog(
        spark.createDataFrame(asked, "query_id string, query string, b double"),
        spark.createDataFrame(items, "article_id string, product_type_name string, product_group_name string"),
        spark.createDataFrame(list(score.items()), "article_id string, score double"), 3,
        spark.createDataFrame(list(price.items()), "article_id string, price_k long"), "b")
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.article_id)
    want = {}
    for q, text, b in asked:
        kind = {"q3": None, "q4": "Large"}.get(q, "Small")
        fits = [a for a, k, _ in items if k == kind and (b is None or price.get(a, 0) <= b)]
        if fits:
            want[q] = sorted(fits, key=lambda a: (-score.get(a, 0.0), a))[:3]
    assert got == want and len(want) == 5


def test_vector_search_deals_the_tables_of_its_queries(spark, monkeypatch):
    from tastebud.operators import vectorsearch as V
    hinted = []
    monkeypatch.setattr(V, "dealt", lambda df, *a, **k: hinted.append(tuple(df.columns)) or df.hint("merge"))
    rows = spark.range(30).selectExpr("id", "array(cast(id as double), cast(30 - id as double)) vec")
    top = V.top_products(V.build_index(rows, block_rows=4), rows.withColumnRenamed("id", "query_id"), 2,
                         rows.selectExpr("id query_id", "id"))
    assert {("query_id", "vec"), ("query_id", "nth"), ("query_id", "block", "gone"), ("id", "block")} <= set(hinted)
    assert top.where("query_id = id").count() == 0 and top.count() == 60
