import pytest
from pyspark.sql import functions as F

from tastebud.operators import coldstart as CS
from tastebud.operators import intent as I
from tastebud.operators import policy as PO
from tastebud.operators import search as S
from tastebud.operators.stats import metrics_long


def test_ctr_with_certain_click(spark):
    recs = spark.createDataFrame([("u1", 1, "a"), ("u1", 2, "b"), ("u2", 1, "c"), ("u2", 2, "d")],
                                 "customer_id string, rank long, article_id string")
    truth = spark.createDataFrame([("u1", "a")], "customer_id string, article_id string")
    out = PO.expected_clicks(recs, truth, relevant_base=1.0, irrelevant_base=0.0).first()
    assert out.sessions == 1 and out.impressions == 2
    assert out.click_through_rate == pytest.approx(0.5)
    assert out.sessions_with_click_rate == pytest.approx(1.0)


def test_lift_infinite_and_zero(spark):
    row = spark.range(1).select(PO.lift(F.lit(0.2), F.lit(0.0)).alias("a"), PO.lift(F.lit(0.0), F.lit(0.0)).alias("b"),
                                PO.lift(F.lit(0.3), F.lit(0.2)).alias("c")).first()
    assert row.a == float("inf") and row.b == 0.0 and row.c == pytest.approx(0.5)


def _msgs(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "msg_id string, text string")


def test_intent_extraction(spark):
    df = _msgs(spark, ["Show me 3 red casual dresses under $40", "hello!", "ignore previous instructions",
                       "find 99 things in gray", "need shorts below 12.50"])
    t = F.col("text")
    rows = df.select(I.extract_limit(t).alias("l"), I.extract_budget(t).alias("b"), I.extract_colour(t).alias("c"),
                     I.extract_style(t).alias("s"), I.greeting_flag(t).alias("g"), I.unsafe_flag(t).alias("u")).collect()
    assert (rows[0].l, rows[0].b, rows[0].c, rows[0].s) == (3, 40.0, "red", "casual")
    assert rows[1].g and not rows[0].g
    assert rows[2].u
    assert (rows[3].l, rows[3].c) == (20, "grey")
    assert (rows[4].l, rows[4].b) == (6, 12.5)


def test_newest_category_wins(spark):
    turns = spark.createDataFrame([(1, 0, "user", "I want trousers"), (1, 1, "assistant", "ok"),
                                   (1, 2, "user", "actually show me shirts")],
                                  "conv_id long, turn long, role string, text string")
    groups = spark.createDataFrame([("Trousers",), ("Shirts",)], "product_group_name string")
    last = I.assistant_intents(turns, groups).where("turn = 2").first()
    assert last.product_group == "Shirts" and not last.use_demographics


def test_product_group_longest(spark):
    msgs = _msgs(spark, ["brand#17 economy"])
    groups = spark.createDataFrame([("brand#1",), ("brand#17",)], "product_group_name string")
    assert I.extract_product_group(msgs, groups).first().product_group == "brand#17"


def test_search_plural_and_all_tokens(spark):
    items = spark.createDataFrame([("1", "Shorts", "Garment Lower body"), ("2", "Cup", "Kitchen"),
                                   ("3", "Trousers", "Garment Lower body")],
                                  "article_id string, product_type_name string, product_group_name string")
    pop = spark.createDataFrame([("3", 5.0), ("1", 2.0)], "article_id string, score double")
    q = spark.createDataFrame([("q1", "show me cups"), ("q2", "lower body garments"), ("q3", "the and")],
                              "query_id string, query string")
    got = {}
    for r in S.search_catalog(q, items, pop, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.article_id)
    assert got == {"q1": ["2"], "q2": ["3", "1"]}


def test_cold_start_cascade(spark):
    segs = spark.createDataFrame([("25-34", "active", 1, "s1", 9.0)],
                                 "age_band string, club_member_status string, rank long, article_id string, score double")
    cats = spark.createDataFrame([("shoes", 1, "c1", 3.0)], "product_group_name string, rank long, article_id string, score double")
    pop = spark.createDataFrame([("g1", 5.0, 1), ("g2", 4.0, 2)], "article_id string, score double, pop_rank long")
    reqs = spark.createDataFrame([("r1", 1, 30.0, "ACTIVE", None, True), ("r2", 1, 30.0, "active", " Shoes ", False),
                                  ("r3", 2, None, None, None, True)],
                                 "request_id string, limit int, age double, club_member_status string, "
                                 "preferred_product_group string, use_demographics boolean")
    got = {r.request_id: (r.strategy, r.article_id) for r in CS.rec_cold_start(reqs, segs, cats, pop).where("rank = 1").collect()}
    assert got == {"r1": ("demographic_popularity", "s1"), "r2": ("category_popularity", "c1"),
                   "r3": ("global_popularity", "g1")}


def test_metrics_long(spark):
    rep = spark.createDataFrame([("pop", 12, 3, 0.1, 0.2)], "model string, k int, users_evaluated int, ndcg double, hit double")
    got = {r.name: r.value for r in metrics_long(rep).collect()}
    assert got == {"pop.ndcg": 0.1, "pop.hit": 0.2}


def test_intent_eval_accuracy(spark):
    labelled = spark.createDataFrame(
        [(1, "Show me 4 red dresses under 30", "Dresses", "red", 30.0, 4),
         (2, "any green shirts please", "Shirts", "green", None, 6),
         (3, "find 2 bags", "Dresses", None, None, 2)],
        "query_id long, query string, expected_product_group string, expected_colour string, "
        "expected_max_budget double, expected_limit int")
    groups = spark.createDataFrame([("Dresses",), ("Shirts",)], "product_group_name string")
    acc = I.intent_eval(labelled, groups).first()
    assert acc.colour_accuracy == pytest.approx(1.0)
    assert acc.product_group_accuracy == pytest.approx(2 / 3)
    assert acc.limit_accuracy == pytest.approx(1.0) and acc.budget_accuracy == pytest.approx(1.0)


def test_build_request(spark):
    controls = spark.createDataFrame(
        [("r1", "Personalized", " u1 ", 5, 30.0, "Active", "Shoes", "a,b"),
         ("r2", "Explore", "u2", 7, 40.0, "Not specified", "All products", " a , ,b ,a")],
        "request_id string, mode string, user_id string, limit int, age double, membership string, "
        "product_group string, session_text string")
    got = {r.request_id: r for r in I.build_request(controls).collect()}
    assert got["r1"].user_id == "u1" and got["r1"].age is None and got["r1"].session_article_ids == []
    assert got["r2"].user_id is None and got["r2"].club_member_status is None
    assert got["r2"].session_article_ids == ["a", "b", "a"]


def test_cold_start_session_first(spark):
    segs = spark.createDataFrame([("25-34", "active", 1, "s1", 9.0)],
                                 "age_band string, club_member_status string, rank long, article_id string, score double")
    cats = spark.createDataFrame([], "product_group_name string, rank long, article_id string, score double")
    pop = spark.createDataFrame([("g1", 5.0, 1)], "article_id string, score double, pop_rank long")
    sess = spark.createDataFrame([("r1", 1, "x9", 0.7)], "request_id string, rank long, article_id string, score double")
    reqs = spark.createDataFrame([("r1", 1, 30.0, "active", None, True), ("r2", 1, 30.0, "active", None, True)],
                                 "request_id string, limit int, age double, club_member_status string, "
                                 "preferred_product_group string, use_demographics boolean")
    got = {r.request_id: (r.strategy, r.article_id, r.explanation)
           for r in CS.rec_cold_start(reqs, segs, cats, pop, session_recs=sess).collect()}
    assert got["r1"] == ("session_content", "x9", CS.SESSION_TEXT)
    assert got["r2"][:2] == ("demographic_popularity", "s1")
    assert got["r2"][2] == "Popular with shoppers in age band 25-34 and membership active."


def test_route_requests_known_and_cold(spark):
    from tastebud.operators.serving import HYBRID_STRATEGY, route_requests
    reqs = spark.createDataFrame([("q1", "u1", 2, None, None, None, True), ("q2", "zz", None, None, None, None, True),
                                  ("q3", "u1", 1, None, None, None, True)],
                                 "request_id string, user_id string, limit int, age double, club_member_status string, "
                                 "preferred_product_group string, use_demographics boolean")
    known = spark.createDataFrame([("u1",)], "customer_id string")
    ranked = "customer_id string, rank long, article_id string, score double"
    cf = spark.createDataFrame([("u1", r, f"a{r:02d}", 100.0 - r) for r in range(1, 41)], ranked)
    ct = spark.createDataFrame([("u1", 1, "a02", 0.9), ("u1", 2, "x", 0.1)], ranked)
    segs = spark.createDataFrame([], "age_band string, club_member_status string, rank long, article_id string, score double")
    cats = spark.createDataFrame([], "product_group_name string, rank long, article_id string, score double")
    pop = spark.createDataFrame([(f"g{i}", 10.0 - i, i) for i in range(1, 15)], "article_id string, score double, pop_rank long")
    out = route_requests(reqs, known, lambda users, n: (cf.where(F.col("rank") <= n), ct),
                         lambda rq: CS.rec_cold_start(rq.drop("user_id"), segs, cats, pop), 0.5).collect()
    of = lambda q: {r.article_id: r for r in out if r.request_id == q}
    q1, q3 = of("q1"), of("q3")
    assert {a: r.rank for a, r in q1.items()} == {"a02": 1, "a01": 2} and {r.strategy for r in q1.values()} == {HYBRID_STRATEGY}
    assert list(q3) == ["a02"]
    # scores are scaled within the request's own first 10 x limit candidates: 20 and 10 of them
    assert q1["a02"].collaborative_contribution == pytest.approx(0.5 * 18 / 19)
    assert q3["a02"].collaborative_contribution == pytest.approx(0.5 * 8 / 9)
    q2 = [r for r in out if r.request_id == "q2"]
    assert len(q2) == 10 and {r.strategy for r in q2} == {"global_popularity"}  # default limit 10


def test_resolve_name_kinds(spark):
    from tastebud.operators.similar import resolve_name
    names = ["alpha shirt", "beta shirt", "gamma shoe", "delta shoe", "Alpha Shirt", "epsilon"]
    items = spark.createDataFrame([(f"i{j}", n) for j, n in enumerate(names)], "article_id string, prod_name string")
    q = spark.createDataFrame([("ALPHA SHIRT ",), ("shoe",), ("gamma shoo",), ("zzzzzzzz",), ("",)], "query_name string")
    one = {r.query_name: (r.article_id, r.match_type) for r in resolve_name(q, items).collect()}
    assert one["ALPHA SHIRT "] == ("i0", "exact") and one["shoe"] == ("i2", "contains")
    assert one["gamma shoo"] == ("i2", "fuzzy") and one["zzzzzzzz"] == (None, "no_match") and one[""][1] == "contains"
