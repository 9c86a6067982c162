"""Exploratory profiles of the (fault-injected) transaction log (SQL-checked)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastebud.functions.numeric import r6
from tastebud.operators import profile as PR
from tastebud.plans.frames import Frames
from tastebud.plans.oracle import with_ctes
from tastebud.plans.registry import register
from tastebud.sources import adapters as A


def eda_transactions(spark, d) -> DataFrame:
    """The raw log as a CSV reader would type it: blanks are missing, bad values null."""
    raw = A.dirty_transactions(spark, d)
    blank = lambda c: F.when(F.col(c) == "", F.lit(None)).otherwise(F.col(c))
    return raw.select(
        blank("customer_id").alias("customer_id"), blank("article_id").alias("article_id"),
        F.col("t_dat").try_cast("timestamp_ntz").alias("t_dat"),
        F.col("price").try_cast("double").alias("price"),
        F.col("sales_channel_id").try_cast("bigint").alias("sales_channel_id"))


def eda_window(spark, d) -> DataFrame:
    return PR.recent_window(eda_transactions(spark, d), months=6, n=0)


def eda_sample(spark, d) -> DataFrame:
    """All rows of the window, materialised once per session (every profile reads them several times)."""
    from tastebud.plans.evaluations import cached
    return cached(Frames(spark, d), "eda_sample", lambda: eda_window(spark, d).checkpoint(eager=True))


EDA = f"""
eda_tx AS (SELECT nullif(customer_id, '') AS customer_id, nullif(article_id, '') AS article_id,
                  TRY_CAST(t_dat AS TIMESTAMP) AS t_dat, TRY_CAST(price AS DOUBLE) AS price,
                  TRY_CAST(sales_channel_id AS BIGINT) AS sales_channel_id FROM dirty_raw),
eda_win AS (SELECT * FROM eda_tx WHERE t_dat >= (SELECT max(t_dat) FROM eda_tx) - INTERVAL 6 MONTH),
eda_sample AS (SELECT * FROM eda_win),
quality AS (
  SELECT metric, count, CASE WHEN (SELECT count(*) FROM eda_sample) > 0
                             THEN 100.0 * count / (SELECT count(*) FROM eda_sample) END AS pct_of_sample
  FROM (UNPIVOT (SELECT count(*) AS rows,
          count(*) FILTER (WHERE t_dat IS NULL) AS missing_t_dat,
          count(*) FILTER (WHERE customer_id IS NULL) AS missing_customer_id,
          count(*) FILTER (WHERE article_id IS NULL) AS missing_article_id,
          count(*) FILTER (WHERE price IS NULL) AS missing_price,
          count(*) FILTER (WHERE sales_channel_id IS NULL) AS missing_sales_channel_id,
          count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM eda_sample)) AS duplicate_rows,
          count(*) FILTER (WHERE coalesce(price, -1) <= 0) AS non_positive_price,
          count(*) FILTER (WHERE NOT coalesce(sales_channel_id IN (1, 2), false)) AS invalid_sales_channel
        FROM eda_sample) ON COLUMNS(*) INTO NAME metric VALUE count)),
ids AS (
  SELECT * FROM (UNPIVOT (SELECT count(DISTINCT customer_id) AS unique_customers_in_sample,
          count(DISTINCT article_id) AS unique_articles_in_sample,
          (SELECT count(*) FROM eda_sample s WHERE s.customer_id IS NULL OR s.customer_id NOT IN (SELECT customer_id FROM customers_raw)) AS customer_ids_not_in_customers,
          (SELECT count(*) FROM eda_sample s WHERE s.article_id IS NULL OR s.article_id NOT IN (SELECT article_id FROM items_raw)) AS article_ids_not_in_articles
        FROM eda_sample) ON COLUMNS(*) INTO NAME metric VALUE value))"""
EDA_DEPS = ("dirty_raw", "customers_raw", "items_raw")


def eda_sql(body: str, *extra_ctes: str, deps=()) -> str:
    extra = EDA + "".join(",\n" + e for e in extra_ctes)
    return with_ctes(body, *EDA_DEPS, *deps, extra=extra)


@register("quality_report", eda_sql("SELECT metric, count, round(pct_of_sample, 6) AS pct_of_sample FROM quality"))
def q_quality_report(spark, d):
    q = PR.quality_report(eda_sample(spark, d))
    return q.select("metric", "count", r6("pct_of_sample").alias("pct_of_sample"))


@register("id_profile", eda_sql("SELECT metric, value FROM ids"))
def q_id_profile(spark, d):
    f = Frames(spark, d)
    return PR.id_profile(eda_sample(spark, d), f.raw_customers, f.raw_items)


@register("monthly_activity", eda_sql("""
SELECT strftime(t_dat, '%Y-%m') AS month, count(*) AS transactions FROM eda_win GROUP BY 1"""))
def q_monthly_activity(spark, d):
    return PR.monthly_activity(eda_window(spark, d))


@register("monthly_activity_orders", with_ctes("""
SELECT strftime(t_dat, '%Y-%m') AS month, count(*) AS transactions FROM raw_a
WHERE t_dat >= (SELECT max(t_dat) FROM raw_a) - INTERVAL 6 MONTH GROUP BY 1""", "raw_a"))
def q_monthly_activity_orders(spark, d):
    return PR.monthly_activity(PR.recent_window(A.order_transactions(spark, d), months=6, n=0))


# The advice texts in rule order (same list as the operator).
_ACTIONS_SQL = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{text}' AS preprocessing_actions, {cond} AS fired"
    for i, (text, cond) in enumerate(zip([t for _, t in PR.ACTIONS], [
        "(SELECT count FROM quality WHERE metric = 'missing_t_dat') > 0",
        "(SELECT count FROM quality WHERE metric = 'missing_customer_id') > 0",
        "(SELECT count FROM quality WHERE metric = 'missing_article_id') > 0",
        "(SELECT count FROM quality WHERE metric = 'missing_price') > 0 OR (SELECT count FROM quality WHERE metric = 'non_positive_price') > 0",
        "(SELECT count FROM quality WHERE metric = 'invalid_sales_channel') > 0",
        "(SELECT value FROM ids WHERE metric = 'article_ids_not_in_articles') > 0",
        "(SELECT value FROM ids WHERE metric = 'customer_ids_not_in_customers') > 0",
    ])))


@register("preprocessing_actions", eda_sql(f"""
SELECT position, preprocessing_actions FROM ({_ACTIONS_SQL}) WHERE fired
UNION ALL
SELECT CAST(0 AS BIGINT), '{PR.NO_ACTION}' WHERE NOT EXISTS (SELECT 1 FROM ({_ACTIONS_SQL}) WHERE fired)"""))
def q_preprocessing_actions(spark, d):
    f = Frames(spark, d)
    s = eda_sample(spark, d)
    return PR.preprocessing_actions(PR.quality_report(s), PR.id_profile(s, f.raw_customers, f.raw_items))


def _profile_sql(master: str, key: str, cols: list[tuple[str, str]]) -> str:
    unions = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM sub" for c, _ in cols)
    dtype = 'CASE "column" ' + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in cols) + ' END'
    return f"""
sub AS (SELECT * FROM {master} WHERE {key} IN (SELECT {key} FROM eda_sample WHERE {key} IS NOT NULL)),
lng AS ({unions}),
cnt AS (SELECT "column", value, count(*) AS freq FROM lng GROUP BY 1, 2),
pc AS (SELECT "column", sum(CASE WHEN value IS NULL THEN freq ELSE 0 END) AS missing,
              count(*) FILTER (WHERE value IS NOT NULL) AS uniq,
              max(CASE WHEN value IS NOT NULL THEN freq END) AS top_freq FROM cnt GROUP BY 1),
tv AS (SELECT c."column", min(c.value) AS top_value FROM cnt c JOIN pc USING ("column")
       WHERE c.value IS NOT NULL AND c.freq = pc.top_freq GROUP BY 1),
prof AS (SELECT pc."column", {dtype} AS dtype, CAST(missing AS BIGINT) AS missing,
                round(100.0 * missing / (SELECT count(*) FROM sub), 2) AS missing_pct, CAST(uniq AS BIGINT) AS "unique",
                round(100.0 * uniq / (SELECT count(*) FROM sub), 2) AS unique_pct,
                substr(coalesce(top_value, 'None'), 1, 50) AS top_value, CAST(coalesce(top_freq, 0) AS BIGINT) AS top_freq
         FROM pc LEFT JOIN tv USING ("column"))"""


_CUST_COLS = [("customer_id", "string"), ("FN", "double"), ("Active", "double"), ("club_member_status", "string"),
              ("fashion_news_frequency", "string"), ("age", "double")]
_ITEM_COLS = [("article_id", "string"), ("prod_name", "string"), ("product_type_name", "string"),
              ("product_group_name", "string"), ("department_name", "string"), ("section_name", "string"),
              ("garment_group_name", "string"), ("detail_desc", "string")]


@register("column_profile", eda_sql("SELECT * FROM prof", _profile_sql("customers_raw", "customer_id", _CUST_COLS)))
def q_column_profile(spark, d):
    return PR.profile_subset(Frames(spark, d).raw_customers, eda_sample(spark, d), "customer_id")


@register("profile_subset", eda_sql("SELECT * FROM prof", _profile_sql("items_raw", "article_id", _ITEM_COLS)))
def q_profile_subset(spark, d):
    return PR.profile_subset(Frames(spark, d).raw_items, eda_sample(spark, d), "article_id")


@register("high_missing", eda_sql('SELECT "column", missing, missing_pct FROM prof WHERE missing_pct > 20',
                                  _profile_sql("customers_raw", "customer_id", _CUST_COLS)))
def q_high_missing(spark, d):
    prof = PR.profile_subset(Frames(spark, d).raw_customers, eda_sample(spark, d), "customer_id")
    return PR.high_missing(prof, 20.0)


@register("numeric_describe", eda_sql(" UNION ALL ".join(f"""
SELECT '{c}' AS column, CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std,
       round(min({c}), 2) AS min, round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50,
       round(quantile_cont({c}, 0.75), 2) AS p75, round(max({c}), 2) AS max FROM sub""" for c in ("FN", "Active", "age")),
                                      "sub AS (SELECT * FROM customers_raw WHERE customer_id IN (SELECT customer_id FROM eda_sample))"))
def q_numeric_describe(spark, d):
    sub = Frames(spark, d).raw_customers.join(
        eda_sample(spark, d).select("customer_id").where(F.col("customer_id").isNotNull()).distinct(), "customer_id", "left_semi")
    return PR.numeric_describe(sub)


def _summary_sql(key: str, entity: str) -> str:
    return f"""
SELECT metric, value FROM (UNPIVOT (
  SELECT CAST(count(*) AS DOUBLE) AS {entity}, round(avg(n), 2) AS mean, round(quantile_cont(n, 0.5), 2) AS median,
         round(quantile_cont(n, 0.9), 2) AS p90, round(quantile_cont(n, 0.95), 2) AS p95,
         round(quantile_cont(n, 0.99), 2) AS p99, CAST(max(n) AS DOUBLE) AS max
  FROM (SELECT {key}, count(*) AS n FROM eda_sample GROUP BY {key})) ON COLUMNS(*) INTO NAME metric VALUE value)"""


@register("activity_summary", eda_sql(_summary_sql("customer_id", "users")))
def q_activity_summary(spark, d):
    return PR.count_summary(PR.activity_counts(eda_sample(spark, d), "customer_id"), "users")


@register("popularity_summary", eda_sql(_summary_sql("article_id", "items")))
def q_popularity_summary(spark, d):
    return PR.count_summary(PR.activity_counts(eda_sample(spark, d), "article_id"), "items")


def _bins_sql(key: str, label: str) -> str:
    return f"""
SELECT b.bin_order, CASE WHEN b.bin_order = 5 THEN '(20, ' || CAST((SELECT max(n) FROM cnt) AS VARCHAR) || ']' ELSE b.bin END AS bin,
       CAST(coalesce(a.c, 0) AS BIGINT) AS {label}, round(100.0 * coalesce(a.c, 0) / (SELECT count(*) FROM cnt), 2) AS pct
FROM (VALUES (0, '[0, 1]'), (1, '(1, 2]'), (2, '(2, 5]'), (3, '(5, 10]'), (4, '(10, 20]'), (5, '(20, max]')) b(bin_order, bin)
LEFT JOIN (SELECT CASE WHEN n <= 1 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 10 THEN 3 WHEN n <= 20 THEN 4 ELSE 5 END AS bo,
                  count(*) AS c FROM cnt GROUP BY 1) a ON a.bo = b.bin_order"""


@register("activity_bins", eda_sql(_bins_sql("customer_id", "n_users"),
                                   "cnt AS (SELECT customer_id, count(*) AS n FROM eda_sample GROUP BY 1)"))
def q_activity_bins(spark, d):
    out = PR.count_bins(PR.activity_counts(eda_sample(spark, d), "customer_id"), "n_users")
    return out.withColumn("bin_order", F.col("bin_order").cast("int"))


@register("popularity_bins", eda_sql(_bins_sql("article_id", "n_items"),
                                     "cnt AS (SELECT article_id, count(*) AS n FROM eda_sample GROUP BY 1)"))
def q_popularity_bins(spark, d):
    out = PR.count_bins(PR.activity_counts(eda_sample(spark, d), "article_id"), "n_items")
    return out.withColumn("bin_order", F.col("bin_order").cast("int"))


@register("matrix_sparsity", eda_sql("""
SELECT n_interactions, n_users, n_items, n_users * n_items AS matrix_size,
       round(CASE WHEN n_users * n_items > 0 THEN n_interactions / (n_users * n_items) ELSE 0 END, 8) AS density,
       round(1 - CASE WHEN n_users * n_items > 0 THEN n_interactions / (n_users * n_items) ELSE 0 END, 8) AS sparsity
FROM (SELECT count(*) AS n_interactions, count(DISTINCT customer_id) AS n_users, count(DISTINCT article_id) AS n_items
      FROM eda_sample)"""))
def q_matrix_sparsity(spark, d):
    return PR.matrix_sparsity(eda_sample(spark, d))


_RISK = """
cut AS (SELECT max(t_dat) - INTERVAL 7 DAY AS c FROM eda_sample),
tr AS (SELECT * FROM eda_sample WHERE t_dat <= (SELECT c FROM cut)),
te AS (SELECT * FROM eda_sample WHERE t_dat > (SELECT c FROM cut)),
risk AS (SELECT metric, value FROM (UNPIVOT (SELECT
   CAST((SELECT count(*) FROM tr) AS DOUBLE) AS train_rows, CAST((SELECT count(*) FROM te) AS DOUBLE) AS test_rows,
   CAST((SELECT count(DISTINCT customer_id) FROM te) AS DOUBLE) AS test_unique_users,
   CAST((SELECT count(DISTINCT article_id) FROM te) AS DOUBLE) AS test_unique_items,
   CAST((SELECT count(DISTINCT customer_id) FROM te WHERE customer_id NOT IN (SELECT customer_id FROM tr WHERE customer_id IS NOT NULL)) AS DOUBLE) AS new_users_in_test,
   CAST((SELECT count(DISTINCT article_id) FROM te WHERE article_id NOT IN (SELECT article_id FROM tr WHERE article_id IS NOT NULL)) AS DOUBLE) AS new_items_in_test,
   round(100.0 * (SELECT count(DISTINCT customer_id) FROM te WHERE customer_id NOT IN (SELECT customer_id FROM tr WHERE customer_id IS NOT NULL))
         / greatest((SELECT count(DISTINCT customer_id) FROM te), 1), 2) AS new_user_rate_pct,
   round(100.0 * (SELECT count(DISTINCT article_id) FROM te WHERE article_id NOT IN (SELECT article_id FROM tr WHERE article_id IS NOT NULL))
         / greatest((SELECT count(DISTINCT article_id) FROM te), 1), 2) AS new_item_rate_pct
  ) ON COLUMNS(*) INTO NAME metric VALUE value))"""


@register("cold_start_risk", eda_sql("SELECT metric, value FROM risk", _RISK))
def q_cold_start_risk(spark, d):
    return PR.cold_start_risk(eda_sample(spark, d), days=7)


_INSIGHT_ROWS = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, CASE WHEN {cond} THEN '{yes}' " + (f"ELSE '{no}' " if no else "") + "END AS eda_insight_for_modeling"
    for i, (cond, (yes, no)) in enumerate(zip([
        "(SELECT quantile_cont(n, 0.95) FROM (SELECT count(*) AS n FROM eda_sample GROUP BY customer_id)) > 10",
        "(SELECT quantile_cont(n, 0.95) FROM (SELECT count(*) AS n FROM eda_sample GROUP BY article_id)) > 10",
        "(SELECT 1 - count(*) / (count(DISTINCT customer_id) * count(DISTINCT article_id)) FROM eda_sample) > 0.99",
        "(SELECT value FROM risk WHERE metric = 'new_users_in_test') > 0",
        "(SELECT value FROM risk WHERE metric = 'new_items_in_test') > 0",
    ], PR.INSIGHTS)))


@register("modeling_insights", eda_sql(f"SELECT * FROM ({_INSIGHT_ROWS}) WHERE eda_insight_for_modeling IS NOT NULL",
                                       _RISK))
def q_modeling_insights(spark, d):
    return PR.modeling_insights(eda_sample(spark, d), days=7)


@register("retrieval_tables", eda_sql("""
SELECT 'retrieval_tx' AS "table", (SELECT count(*) FROM (SELECT DISTINCT * FROM eda_win
   WHERE customer_id IS NOT NULL AND article_id IS NOT NULL AND t_dat IS NOT NULL AND price IS NOT NULL
     AND price > 0 AND sales_channel_id IN (1, 2))) AS "rows",
   'customer_id, article_id, t_dat, price, sales_channel_id' AS columns
UNION ALL SELECT 'retrieval_items', (SELECT count(*) FROM items_raw),
   'article_id, prod_name, product_type_name, product_group_name, department_name, section_name, garment_group_name, detail_desc'
UNION ALL SELECT 'retrieval_customers', (SELECT count(*) FROM customers_raw),
   'customer_id, age, fashion_news_frequency, club_member_status'"""))
def q_retrieval_tables(spark, d):
    f = Frames(spark, d)
    return PR.retrieval_tables(eda_window(spark, d), f.raw_items, f.raw_customers)[3]
