"""Popularity family, rankings, confidences (SQL-checked)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastebud.functions.numeric import r6
from tastebud.operators import popularity as P
from tastebud.operators import confidence as CF
from tastebud.plans.frames import K, Frames
from tastebud.plans.oracle import age_band as sql_age_band
from tastebud.plans.oracle import with_ctes
from tastebud.plans.registry import register


@register("popularity", with_ctes("SELECT article_id, score, pop_rank FROM pop_b", "pop_b"))
def q_popularity(spark, d):
    return Frames(spark, d).pop.select("article_id", "score", "pop_rank")


@register("popularity_orders", with_ctes("SELECT article_id, score, pop_rank FROM pop_a", "pop_a"))
def q_popularity_orders(spark, d):
    return Frames(spark, d, adapter="orders").pop.select("article_id", "score", "pop_rank")


@register("seen_sets", with_ctes("SELECT customer_id, article_id FROM seen_b", "seen_b"))
def q_seen_sets(spark, d):
    return Frames(spark, d).seen


REC_POP_SQL = """
SELECT customer_id, rank, article_id, score FROM (
  SELECT u.customer_id, p.article_id, p.score,
         row_number() OVER (PARTITION BY u.customer_id ORDER BY p.pop_rank) AS rank
  FROM {users} u CROSS JOIN {pop} p
  WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.customer_id = u.customer_id AND s.article_id = p.article_id))
WHERE rank <= {k}"""


@register("rec_popularity", with_ctes(REC_POP_SQL.format(users="users", pop="pop_b", seen="seen_b", k=K),
                                      "pop_b", "seen_b", "clean_b",
                                      extra="users AS (SELECT DISTINCT customer_id FROM clean_b)"))
def q_rec_popularity(spark, d):
    f = Frames(spark, d)
    return P.rec_popularity(f.pop, f.seen, f.clean.select("customer_id"), K)


@register("rec_popularity_orders", with_ctes(REC_POP_SQL.format(users="users", pop="pop_a", seen="seen_a", k=K),
                                             "pop_a", "seen_a", "clean_a",
                                             extra="users AS (SELECT DISTINCT customer_id FROM clean_a)"))
def q_rec_popularity_orders(spark, d):
    f = Frames(spark, d, adapter="orders")
    return P.rec_popularity(f.pop, f.seen, f.clean.select("customer_id"), K)


@register("anti_seen", with_ctes("""
SELECT v.customer_id, v.article_id FROM (SELECT DISTINCT customer_id, article_id FROM val_b) v
WHERE NOT EXISTS (SELECT 1 FROM seen_b s WHERE s.customer_id = v.customer_id AND s.article_id = v.article_id)""",
                                 "val_b", "seen_b"))
def q_anti_seen(spark, d):
    f = Frames(spark, d)
    return f.val.select("customer_id", "article_id").distinct().join(f.seen, ["customer_id", "article_id"], "left_anti")


@register("ground_truth", with_ctes("SELECT customer_id, article_id FROM truth_val_b", "truth_val_b"))
def q_ground_truth(spark, d):
    return Frames(spark, d).truth("val")


@register("ground_truth_orders", with_ctes("SELECT customer_id, article_id FROM truth_test_a", "truth_test_a"))
def q_ground_truth_orders(spark, d):
    return Frames(spark, d, adapter="orders").truth("test")


_SEG_SQL = f"""
SELECT age_band, club_member_status, rank, article_id, score FROM (
  SELECT age_band, club_member_status, article_id, CAST(n AS DOUBLE) AS score,
         sum(n) OVER (PARTITION BY age_band, club_member_status) AS seg_events,
         row_number() OVER (PARTITION BY age_band, club_member_status ORDER BY n DESC, article_id) AS rank
  FROM (SELECT coalesce(c.age_band, 'unknown') AS age_band, coalesce(c.club_member_status, 'none') AS club_member_status,
               e.article_id, count(*) AS n
        FROM {{ev}} e LEFT JOIN (SELECT customer_id, {sql_age_band('age')} AS age_band,
                                  lower(coalesce(club_member_status, 'none')) AS club_member_status FROM customers) c
          ON e.customer_id = c.customer_id
        WHERE e.customer_id IS NOT NULL AND e.article_id IS NOT NULL
        GROUP BY 1, 2, 3))
WHERE seg_events >= {{m}}"""


@register("segment_rankings", with_ctes(_SEG_SQL.format(ev="train_a", m=50), "train_a", "customers"))
def q_segment_rankings(spark, d):
    f = Frames(spark, d, adapter="orders")
    return P.segment_rankings(f.train, f.customers, 50)


@register("join_left_customer", with_ctes(f"""
SELECT e.customer_id, e.article_id, coalesce(c.age_band, 'unknown') AS age_band,
       coalesce(c.club_member_status, 'none') AS club_member_status
FROM test_a e LEFT JOIN (SELECT customer_id, {sql_age_band('age')} AS age_band,
                          lower(coalesce(club_member_status, 'none')) AS club_member_status FROM customers) c
  ON e.customer_id = c.customer_id""", "test_a", "customers"))
def q_join_left_customer(spark, d):
    from tastebud.operators.coldstart import customer_profile
    f = Frames(spark, d, adapter="orders")
    prof = customer_profile(f.customers)
    return (f.test.select("customer_id", "article_id").join(prof, "customer_id", "left")
            .select("customer_id", "article_id", F.coalesce("age_band", F.lit("unknown")).alias("age_band"),
                    F.coalesce("club_member_status", F.lit("none")).alias("club_member_status")))


@register("category_rankings", with_ctes("""
SELECT product_group_name, rank, article_id, score FROM (
  SELECT c.product_group_name, p.article_id, p.score,
         row_number() OVER (PARTITION BY c.product_group_name ORDER BY p.score DESC, p.article_id) AS rank
  FROM (SELECT article_id, CAST(count(*) AS DOUBLE) AS score FROM train_a GROUP BY article_id) p
  LEFT JOIN (SELECT article_id, lower(coalesce(product_group_name, '')) AS product_group_name FROM items) c USING (article_id)
  WHERE c.product_group_name IS NOT NULL AND c.product_group_name <> '')""", "train_a", "items"))
def q_category_rankings(spark, d):
    f = Frames(spark, d, adapter="orders")
    return P.category_rankings(f.train, f.items)


@register("join_left_catalog", with_ctes("""
SELECT p.article_id, p.score, c.product_group_name
FROM (SELECT article_id, CAST(count(*) AS DOUBLE) AS score FROM train_b GROUP BY article_id) p
LEFT JOIN (SELECT article_id, lower(coalesce(product_group_name, '')) AS product_group_name FROM items) c USING (article_id)""",
                                         "train_b", "items"))
def q_join_left_catalog(spark, d):
    f = Frames(spark, d)
    counts = f.train.groupBy("article_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    cat = f.items.select("article_id", F.lower(F.coalesce("product_group_name", F.lit(""))).alias("product_group_name"))
    return counts.join(cat, "article_id", "left")


@register("product_groups", with_ctes("""
SELECT DISTINCT product_group_name FROM items WHERE product_group_name IS NOT NULL AND product_group_name <> ''""", "items"))
def q_product_groups(spark, d):
    from tastebud.operators.intent import product_groups
    return product_groups(Frames(spark, d).items)


@register("interaction_confidence", with_ctes("""
SELECT customer_id, article_id, round(ln(1 + count(*)), 6) AS weight FROM train_b GROUP BY customer_id, article_id""",
                                              "train_b"))
def q_interaction_confidence(spark, d):
    c = CF.interaction_confidence(Frames(spark, d).train)
    return c.select("customer_id", "article_id", r6("weight").alias("weight"))


@register("recency_confidence", with_ctes("""
SELECT customer_id, article_id,
       round(ln(1 + sum(exp(-ln(2) / 30.0 * (epoch_us((SELECT max(event_ts) FROM train_b)) - epoch_us(event_ts)) / 86400000000.0))), 6) AS weight
FROM train_b GROUP BY customer_id, article_id""", "train_b"))
def q_recency_confidence(spark, d):
    c = CF.recency_confidence(Frames(spark, d).train, half_life_days=30.0)
    return c.select("customer_id", "article_id", r6("weight").alias("weight"))
