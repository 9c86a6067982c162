"""Sources, cleaning, split, id maps, set operations and joins (SQL-checked)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastebud.functions.numeric import r6
from tastebud.operators import clean as C
from tastebud.plans.frames import Frames
from tastebud.plans.oracle import age_band as sql_age_band
from tastebud.plans.oracle import uniform as sql_uniform
from tastebud.plans.oracle import label_sql, with_ctes
from tastebud.plans.registry import register
from tastebud.sources import adapters as A
from tastebud.sources.tables import read_interactions


def ts_str(c):
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


TS_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def tss(c: str) -> str:
    return TS_SQL.format(c=c)


@register("src_parquet_cols", with_ctes(f"""
SELECT customer_id, article_id, {tss('event_ts')} AS event_ts FROM clean_b
WHERE customer_id IS NOT NULL AND article_id IS NOT NULL AND event_ts IS NOT NULL""", "clean_b"))
def q_src_parquet_cols(spark, d):
    df, has = read_interactions(Frames(spark, d).clean, want_recency=True)
    assert has
    return df.select("customer_id", "article_id", ts_str("event_ts").alias("event_ts"))


@register("coerce_types", with_ctes(f"""
SELECT customer_id, article_id, price, sales_channel_id, event_date, {tss('event_ts')} AS event_ts
FROM coerced_d""", "coerced_d"))
def q_coerce_types(spark, d):
    df = C.coerce_interactions(A.dirty_transactions(spark, d))
    return df.select("customer_id", "article_id", "price", "sales_channel_id", "event_date",
                     ts_str("event_ts").alias("event_ts"))


@register("derive_event_date", with_ctes("""
SELECT event_date, count(*) AS n_rows FROM coerced_b GROUP BY event_date""", "coerced_b"))
def q_derive_event_date(spark, d):
    df = C.coerce_interactions(A.events_transactions(spark, d))
    return df.groupBy("event_date").agg(F.count(F.lit(1)).alias("n_rows"))


@register("temporal_split", with_ctes(f"""
SELECT customer_id, article_id, {tss('event_ts')} AS event_ts, CAST(month_number AS INTEGER) AS month_number,
       CAST(week_of_month AS INTEGER) AS week_of_month, split
FROM split_b""", "split_b"))
def q_temporal_split(spark, d):
    df = C.label_split(C.coerce_interactions(A.events_transactions(spark, d)))
    return df.select("customer_id", "article_id", ts_str("event_ts").alias("event_ts"),
                     "month_number", "week_of_month", "split")


@register("temporal_split_orders", with_ctes("""
SELECT split, count(*) AS n_rows, count(DISTINCT customer_id) AS n_users FROM split_a GROUP BY split""", "split_a"))
def q_temporal_split_orders(spark, d):
    df = C.label_split(C.coerce_interactions(A.order_transactions(spark, d)))
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.count_distinct("customer_id").alias("n_users"))


@register("empty_when_no_dates", with_ctes("""
SELECT count(*) FILTER (WHERE split IS NOT NULL) AS kept_rows, count(*) FILTER (WHERE split IS NULL) AS missing_rows
FROM nodates_lab""", "coerced_d", extra="nodates AS (SELECT * REPLACE (CAST(NULL AS TIMESTAMP) AS event_ts) FROM coerced_d),\n"
                                    + "nodates_lab AS (" + label_sql("nodates") + ")"))
def q_empty_when_no_dates(spark, d):
    # all dates unparseable -> the split maximum is null -> no row lands in any split
    raw = A.dirty_transactions(spark, d).withColumn("t_dat", F.lit("not-a-date"))
    df = C.label_split(C.coerce_interactions(raw))
    return df.agg(F.count_if(F.col("split").isNotNull()).alias("kept_rows"),
                  F.count_if(F.col("split").isNull()).alias("missing_rows"))


@register("clean_interactions", with_ctes(f"""
SELECT customer_id, article_id, price, sales_channel_id, event_date, {tss('event_ts')} AS event_ts, split
FROM clean_d""", "clean_d"))
def q_clean_interactions(spark, d):
    f = Frames(spark, d)
    lab = C.labelled_interactions(A.dirty_transactions(spark, d), f.items)
    return C.kept_interactions(lab).select(
        "customer_id", "article_id", "price", "sales_channel_id", "event_date",
        ts_str("event_ts").alias("event_ts"), "split")


@register("clean_reject_counts", with_ctes("""
SELECT split, reject_reason, count(*) AS n_rows FROM labelled_d
WHERE split IS NOT NULL AND reject_reason IS NOT NULL GROUP BY split, reject_reason""", "labelled_d"))
def q_clean_reject_counts(spark, d):
    f = Frames(spark, d)
    return C.reject_counts(C.labelled_interactions(A.dirty_transactions(spark, d), f.items))


@register("keep_duplicates_sorted", with_ctes(f"""
SELECT customer_id, article_id, {tss('event_ts')} AS event_ts, count(*) AS copies
FROM clean_d GROUP BY customer_id, article_id, event_ts HAVING count(*) > 1""", "clean_d"))
def q_keep_duplicates(spark, d):
    f = Frames(spark, d)
    kept = C.kept_interactions(C.labelled_interactions(A.dirty_transactions(spark, d), f.items))
    return (kept.groupBy("customer_id", "article_id", "event_ts").agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1).select("customer_id", "article_id", ts_str("event_ts").alias("event_ts"), "copies"))


@register("sink_clean_union", with_ctes(f"""
SELECT customer_id, article_id, {tss('event_ts')} AS event_ts, split FROM train_b UNION ALL
SELECT customer_id, article_id, {tss('event_ts')} AS event_ts, split FROM val_b UNION ALL
SELECT customer_id, article_id, {tss('event_ts')} AS event_ts, split FROM test_b""", "train_b", "val_b", "test_b"))
def q_sink_clean_union(spark, d):
    f = Frames(spark, d)
    cols = ["customer_id", "article_id", ts_str("event_ts").alias("event_ts"), "split"]
    return f.train.select(*cols).unionByName(f.val.select(*cols)).unionByName(f.test.select(*cols))


@register("union_all", with_ctes("""
SELECT split, count(*) AS n_rows FROM (SELECT split FROM train_b UNION ALL SELECT split FROM val_b
UNION ALL SELECT split FROM test_b) GROUP BY split""", "train_b", "val_b", "test_b"))
def q_union_all(spark, d):
    f = Frames(spark, d)
    u = f.train.select("split").unionByName(f.val.select("split")).unionByName(f.test.select("split"))
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("normalize_text", with_ctes("""
SELECT article_id, prod_name, product_type_name, product_group_name, department_name, detail_desc FROM items""", "items"))
def q_normalize_text(spark, d):
    return Frames(spark, d).items.select("article_id", "prod_name", "product_type_name", "product_group_name",
                                         "department_name", "detail_desc")


@register("clean_items", with_ctes("""
SELECT article_id, prod_name, product_type_name, product_group_name, department_name, section_name,
       garment_group_name, detail_desc, image_path, has_image, item_text FROM items""", "items"))
def q_clean_items(spark, d):
    return Frames(spark, d).items.select("article_id", "prod_name", "product_type_name", "product_group_name",
                                         "department_name", "section_name", "garment_group_name", "detail_desc",
                                         "image_path", "has_image", "item_text")


@register("build_item_text", with_ctes("SELECT article_id, item_text FROM items", "items"))
def q_build_item_text(spark, d):
    return Frames(spark, d).items.select("article_id", "item_text")


_LISTING_SQL = """
SELECT 'images/' || substr(CAST(p_partkey AS VARCHAR), 1, 3) || '/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS path
FROM part WHERE p_partkey % 3 = 0
UNION ALL
SELECT 'images/' || substr(lpad(CAST(p_partkey AS VARCHAR), 10, '0'), 1, 3) || '/' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') || '.png'
FROM part WHERE p_partkey % 4 = 0"""


@register("resolve_image_path", with_ctes("""
SELECT i.article_id, b.image_path, b.image_path IS NOT NULL AS has_image FROM items i LEFT JOIN best b USING (article_id)""",
  "items", extra=f"""
listing AS ({_LISTING_SQL}),
cands AS (
  SELECT article_id, 0 AS prio, 'images/' || substr(article_id,1,3) || '/' || article_id || '.jpg' AS path FROM items UNION ALL
  SELECT article_id, 1, 'images/' || substr(article_id,1,3) || '/' || article_id || '.png' FROM items UNION ALL
  SELECT article_id, 2, 'images/' || substr(pad,1,3) || '/' || pad || '.jpg' FROM (SELECT article_id, CASE WHEN length(article_id) < 10 THEN lpad(article_id,10,'0') ELSE article_id END AS pad FROM items) UNION ALL
  SELECT article_id, 3, 'images/' || substr(pad,1,3) || '/' || pad || '.png' FROM (SELECT article_id, CASE WHEN length(article_id) < 10 THEN lpad(article_id,10,'0') ELSE article_id END AS pad FROM items)),
best AS (SELECT article_id, arg_min(c.path, prio) AS image_path FROM cands c JOIN (SELECT DISTINCT path FROM listing) l ON c.path = l.path GROUP BY article_id)"""))
def q_resolve_image_path(spark, d):
    f = Frames(spark, d)
    out = C.clean_items(f.raw_items, A.image_listing(spark, d))
    return out.select("article_id", "image_path", "has_image")


@register("clean_customers", with_ctes("""
SELECT customer_id, FN, Active, club_member_status, fashion_news_frequency, age FROM customers""", "customers"))
def q_clean_customers(spark, d):
    return Frames(spark, d).customers


@register("build_id_maps", with_ctes("""
SELECT 'user' AS kind, customer_id AS id, row_number() OVER (ORDER BY customer_id) - 1 AS idx
FROM (SELECT DISTINCT customer_id FROM train_b)
UNION ALL
SELECT 'item', article_id, row_number() OVER (ORDER BY article_id) - 1 FROM (SELECT DISTINCT article_id FROM train_b)""",
                                     "train_b"))
def q_build_id_maps(spark, d):
    u, i = C.build_id_maps(Frames(spark, d).train)
    return (u.select(F.lit("user").alias("kind"), F.col("customer_id").alias("id"), F.col("user_idx").alias("idx"))
            .unionByName(i.select(F.lit("item").alias("kind"), F.col("article_id").alias("id"), F.col("item_idx").alias("idx"))))


_MAPS_SQL = """
umap AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS user_idx FROM (SELECT DISTINCT customer_id FROM train_a)),
imap AS (SELECT article_id, row_number() OVER (ORDER BY article_id) - 1 AS item_idx FROM (SELECT DISTINCT article_id FROM train_a))"""


@register("apply_id_maps", with_ctes("""
SELECT t.split, count(*) AS n_rows, count(u.user_idx) AS with_user_idx, count(m.item_idx) AS with_item_idx,
       CAST(sum(coalesce(u.user_idx, 0)) AS BIGINT) AS user_idx_sum, CAST(sum(coalesce(m.item_idx, 0)) AS BIGINT) AS item_idx_sum
FROM clean_a t LEFT JOIN umap u USING (customer_id) LEFT JOIN imap m USING (article_id) GROUP BY t.split""",
                                     "clean_a", "train_a", extra=_MAPS_SQL))
def q_apply_id_maps(spark, d):
    f = Frames(spark, d, adapter="orders")
    u, i = C.build_id_maps(f.train)
    m = C.apply_id_maps(f.clean, u, i)
    return m.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("user_idx").alias("with_user_idx"),
        F.count("item_idx").alias("with_item_idx"),
        F.sum(F.coalesce("user_idx", F.lit(0))).cast("long").alias("user_idx_sum"),
        F.sum(F.coalesce("item_idx", F.lit(0))).cast("long").alias("item_idx_sum"))


@register("join_left_maps", with_ctes("""
SELECT i.article_id, m.item_idx FROM items i LEFT JOIN imap m USING (article_id)""", "items", "train_a", extra=_MAPS_SQL))
def q_join_left_maps(spark, d):
    f = Frames(spark, d, adapter="orders")
    _, imap = C.build_id_maps(f.train)
    return f.items.select("article_id").join(imap, "article_id", "left")


@register("union_distinct_users", with_ctes("""
SELECT customer_id FROM train_a UNION SELECT customer_id FROM val_a""", "train_a", "val_a"))
def q_union_distinct_users(spark, d):
    f = Frames(spark, d, adapter="orders")
    return f.train.select("customer_id").union(f.val.select("customer_id")).distinct()


@register("except_items", with_ctes("""
SELECT article_id FROM items EXCEPT SELECT article_id FROM train_a""", "items", "train_a"))
def q_except_items(spark, d):
    f = Frames(spark, d, adapter="orders")
    return f.items.select("article_id").subtract(f.train.select("article_id"))


@register("intersect_users", with_ctes("""
SELECT customer_id FROM train_b INTERSECT SELECT customer_id FROM test_b""", "train_b", "test_b"))
def q_intersect_users(spark, d):
    f = Frames(spark, d)
    return f.train.select("customer_id").intersect(f.test.select("customer_id"))


@register("semi_catalog", with_ctes("""
SELECT count(*) AS n_rows FROM coerced_d WHERE article_id IN (SELECT article_id FROM items)""", "coerced_d", "items"))
def q_semi_catalog(spark, d):
    f = Frames(spark, d)
    co = C.coerce_interactions(A.dirty_transactions(spark, d))
    return co.join(f.items.select("article_id"), "article_id", "left_semi").agg(F.count(F.lit(1)).alias("n_rows"))


@register("semi_warm", with_ctes("""
SELECT customer_id, article_id FROM test_a
WHERE customer_id IN (SELECT customer_id FROM train_a) AND article_id IN (SELECT article_id FROM train_a)""",
                                 "test_a", "train_a"))
def q_semi_warm(spark, d):
    f = Frames(spark, d, adapter="orders")
    return (f.test.select("customer_id", "article_id")
            .join(f.train_users, "customer_id", "left_semi").join(f.train_items, "article_id", "left_semi"))


@register("anti_new_users", with_ctes("""
SELECT DISTINCT customer_id, article_id FROM test_a
WHERE customer_id NOT IN (SELECT customer_id FROM train_a UNION SELECT customer_id FROM val_a)
  AND article_id IN (SELECT article_id FROM train_a UNION SELECT article_id FROM val_a)""", "test_a", "train_a", "val_a"))
def q_anti_new_users(spark, d):
    f = Frames(spark, d, adapter="orders")
    known = f.train.select("customer_id", "article_id").unionByName(f.val.select("customer_id", "article_id"))
    return (f.test.select("customer_id", "article_id")
            .join(known.select("customer_id").distinct(), "customer_id", "left_anti")
            .join(known.select("article_id").distinct(), "article_id", "left_semi").distinct())


@register("anti_fresh_items", with_ctes("""
SELECT DISTINCT article_id FROM items WHERE article_id NOT IN (SELECT article_id FROM train_a)""", "items", "train_a"))
def q_anti_fresh_items(spark, d):
    return Frames(spark, d, adapter="orders").fresh_items


@register("anti_orphans", with_ctes("""
SELECT (SELECT count(*) FROM coerced_d c WHERE c.customer_id NOT IN (SELECT customer_id FROM customers)) AS customers_not_in_master,
       (SELECT count(*) FROM coerced_d c WHERE c.article_id NOT IN (SELECT article_id FROM items)) AS articles_not_in_master""",
                                   "coerced_d", "customers", "items"))
def q_anti_orphans(spark, d):
    f = Frames(spark, d)
    co = C.coerce_interactions(A.dirty_transactions(spark, d))
    cu = co.join(f.customers.select("customer_id").distinct(), "customer_id", "left_anti").select(F.count(F.lit(1))).scalar()
    ar = co.join(f.items.select("article_id").distinct(), "article_id", "left_anti").select(F.count(F.lit(1))).scalar()
    return spark.range(1).select(cu.alias("customers_not_in_master"), ar.alias("articles_not_in_master"))


@register("tail_limit", with_ctes("""
SELECT customer_id, article_id, split FROM (
  SELECT *, CASE split WHEN 'train' THEN 0 ELSE 1 END AS so FROM (SELECT * FROM train_b UNION ALL SELECT * FROM val_b))
ORDER BY so DESC, customer_id DESC, event_ts DESC, article_id DESC LIMIT 1000""", "train_b", "val_b"))
def q_tail_limit(spark, d):
    from tastebud.operators.sample import tail_limit
    f = Frames(spark, d)
    both = f.train.unionByName(f.val)
    return tail_limit(both, 1000).select("customer_id", "article_id", "split")


@register("first_n_users", with_ctes("""
SELECT DISTINCT customer_id FROM truth_val_b ORDER BY customer_id LIMIT 1000""", "truth_val_b"))
def q_first_n_users(spark, d):
    from tastebud.operators.sample import first_n_users
    return first_n_users(Frames(spark, d).truth("val"), 1000)  # max_eval_users


@register("sample_users", with_ctes(f"""
SELECT customer_id FROM (SELECT DISTINCT customer_id FROM truth_val_b)
ORDER BY {sql_uniform(42, 'customer_id')}, customer_id LIMIT 1000""",
                                    "truth_val_b"))
def q_sample_users(spark, d):
    from tastebud.operators.sample import sample_users
    return sample_users(Frames(spark, d).truth("val"), 1000, seed=42)  # max_eval_users


@register("age_band", with_ctes(f"""
SELECT customer_id, {sql_age_band('age')} AS age_band
FROM customers_raw""", "customers_raw"))
def q_age_band(spark, d):
    from tastebud.functions.numeric import age_band
    return Frames(spark, d).raw_customers.select("customer_id", age_band("age").alias("age_band"))


@register("data_counts", with_ctes("""
SELECT (SELECT count(*) FROM train_b) AS training_rows, (SELECT count(DISTINCT customer_id) FROM train_b) AS training_users,
       (SELECT count(DISTINCT article_id) FROM train_b) AS training_items, (SELECT count(DISTINCT article_id) FROM items) AS catalog_items,
       (SELECT count(DISTINCT article_id) FROM items WHERE article_id NOT IN (SELECT article_id FROM train_b)) AS fresh_items,
       (SELECT count(DISTINCT customer_id) FROM truth_val_b) AS warm_users""", "train_b", "items", "truth_val_b"))
def q_data_counts(spark, d):
    f = Frames(spark, d)
    t = f.train.agg(F.count(F.lit(1)).alias("training_rows"), F.count_distinct("customer_id").alias("training_users"),
                    F.count_distinct("article_id").alias("training_items"))
    return t.select("*",
                    f.items.select(F.count_distinct("article_id")).scalar().alias("catalog_items"),
                    f.fresh_items.select(F.count(F.lit(1))).scalar().alias("fresh_items"),
                    f.truth("val").select(F.count_distinct("customer_id")).scalar().alias("warm_users"))


@register("stats_summary", with_ctes("""
SELECT (SELECT count(*) FROM dirty_raw) AS interactions_raw_rows,
       (SELECT count(*) FROM clean_d WHERE split = 'train') AS interactions_train_rows,
       (SELECT count(*) FROM clean_d WHERE split = 'val') AS interactions_val_rows,
       (SELECT count(*) FROM clean_d WHERE split = 'test') AS interactions_test_rows,
       (SELECT count(*) FROM clean_d) AS interactions_clean_rows,
       (SELECT count(*) FROM labelled_d WHERE split IS NOT NULL AND reject_reason = 'missing') AS interactions_dropped_missing,
       (SELECT count(*) FROM labelled_d WHERE split IS NOT NULL AND reject_reason = 'invalid_price') AS interactions_dropped_invalid_price,
       CAST(0 AS BIGINT) AS interactions_deduplicated,
       (SELECT count(*) FROM labelled_d WHERE split IS NOT NULL AND reject_reason = 'orphan') AS interactions_dropped_orphan_items,
       (SELECT count(*) FROM items_raw) AS items_raw_rows, (SELECT count(*) FROM items) AS items_clean_rows,
       (SELECT count(*) FROM items WHERE has_image) AS items_with_images,
       (SELECT count(*) FROM customers_raw) AS customers_raw_rows, (SELECT count(*) FROM customers) AS customers_clean_rows""",
                                    "dirty_raw", "clean_d", "labelled_d", "items_raw", "items", "customers_raw", "customers"))
def q_stats_summary(spark, d):
    from tastebud.operators.stats import pipeline_stats
    f = Frames(spark, d)
    raw = A.dirty_transactions(spark, d)
    lab = C.labelled_interactions(raw, f.items)
    return pipeline_stats(raw, lab, f.raw_items, f.items, f.raw_customers, f.customers)


@register("budget_filter", with_ctes("""
SELECT r.customer_id, r.article_id, coalesce(p.price_k, 0) AS price_k FROM
 (SELECT DISTINCT customer_id, article_id FROM val_b) r LEFT JOIN prices p USING (article_id)
WHERE coalesce(p.price_k, 0) <= 36000""", "train_b", "val_b", extra="""
prices AS (SELECT article_id, CAST(round_even(median(price) * 1000, 0) AS BIGINT) AS price_k FROM train_b GROUP BY article_id)"""))
def q_budget_filter(spark, d):
    from tastebud.operators.serving import budget_filter, median_price
    f = Frames(spark, d)
    recs = f.val.select("customer_id", "article_id").distinct()
    return budget_filter(recs, median_price(f.train), 36000).select("customer_id", "article_id", "price_k")


@register("median_price", with_ctes("""
SELECT article_id, CAST(round_even(median(price) * 1000, 0) AS BIGINT) AS price_k FROM train_a GROUP BY article_id""",
                                    "train_a"))
def q_median_price(spark, d):
    from tastebud.operators.serving import median_price
    return median_price(Frames(spark, d, adapter="orders").train)


@register("eda_window_6m", with_ctes(f"""
SELECT customer_id, article_id, {tss('t_dat')} AS t_dat FROM raw_a
WHERE t_dat >= (SELECT max(t_dat) FROM raw_a) - INTERVAL 6 MONTH
ORDER BY t_dat, customer_id, article_id LIMIT 300000""", "raw_a"))
def q_eda_window(spark, d):
    from tastebud.operators.profile import recent_window
    w = recent_window(A.order_transactions(spark, d), months=6, n=300_000)  # the EDA sample size
    return w.select("customer_id", "article_id", ts_str("t_dat").alias("t_dat"))


@register("src_interactions_price", with_ctes("""
SELECT split, round(avg(price), 6) AS avg_price, round(min(price), 6) AS min_price FROM clean_a GROUP BY split""", "clean_a"))
def q_price_by_split(spark, d):
    f = Frames(spark, d, adapter="orders")
    return f.clean.groupBy("split").agg(r6(F.avg("price")).alias("avg_price"), r6(F.min("price")).alias("min_price"))
