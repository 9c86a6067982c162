"""Response enrichment, chat constraint filtering, request building, CSV source and reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tastebud.functions.numeric import r6
from tastebud.operators import coldstart as CS
from tastebud.operators import intent as I
from tastebud.operators import popularity as P
from tastebud.operators import search as S
from tastebud.operators.serving import budget_filter, enrich_response, median_price
from tastebud.plans.frames import K, Frames
from tastebud.plans.oracle import age_band as sql_age_band
from tastebud.plans.oracle import with_ctes
from tastebud.plans.queries_rank import _SEG_SQL, REC_POP_SQL
from tastebud.plans.queries_text import _CTX, _GROUPS, SEARCH_SQL, _group_sql, _intent_cols_sql, _rx, _search_queries
from tastebud.plans.registry import register
from tastebud.sources.adapters import shopping_messages
from tastebud.sources.tables import load_table

_POPREC = ("tusers AS (SELECT DISTINCT customer_id FROM truth_val_b),\n"
           "recs AS (" + REC_POP_SQL.format(users="tusers", pop="pop_b", seen="seen_b", k=K) + ")")
_DEPS = ("truth_val_b", "pop_b", "seen_b", "items", "train_b")


def _pop_recs(f: Frames):
    return P.rec_popularity(f.pop, f.seen, f.truth("val").select("customer_id").distinct(), K)


@register("enrich_response", with_ctes("""
SELECT r.customer_id, r.rank, r.article_id, round(r.score, 6) AS score, 'global_popularity' AS strategy,
       m.prod_name AS product_name, m.product_group_name AS product_group,
       coalesce(nullif(m.item_text, ''), m.detail_desc) AS description,
       'Popular products across all shoppers.' AS reason, CAST(1.0 AS DOUBLE) AS signal
FROM recs r LEFT JOIN items m USING (article_id)""", *_DEPS, extra=_POPREC))
def q_enrich_response(spark, d):
    f = Frames(spark, d)
    recs = _pop_recs(f).select("*", F.lit("global_popularity").alias("strategy"),
                               F.lit("Popular products across all shoppers.").alias("explanation"))
    out = enrich_response(recs, f.items)
    return out.select("customer_id", "rank", "article_id", r6("score").alias("score"), "strategy", "product_name",
                      "product_group", "description", "reason", F.col("signals")["global_popularity"].alias("signal"))


@register("lookup_enrich", with_ctes("""
SELECT r.customer_id, r.rank, r.article_id, m.prod_name AS product_name, coalesce(p.price_k, 0) AS price_k
FROM recs r LEFT JOIN items m USING (article_id)
LEFT JOIN (SELECT article_id, CAST(round_even(median(price) * 1000, 0) AS BIGINT) AS price_k FROM train_b GROUP BY 1) p
  USING (article_id)""", *_DEPS, extra=_POPREC))
def q_lookup_enrich(spark, d):
    f = Frames(spark, d)
    recs = budget_filter(_pop_recs(f), median_price(f.train), None)
    return recs.join(f.items.select("article_id", F.col("prod_name").alias("product_name")), "article_id", "left") \
        .select("customer_id", "rank", "article_id", "product_name", "price_k")


# The chat flow: catalog search within the budget; turns without a hit go through
# request routing (cold start, as no user is known) and the same budget; the turn's
# group (not for catalog hits), colour and style filter the pool before its limit.
_FLOW = SEARCH_SQL + ",\n" + _CTX + ",\n" + _GROUPS + f""",
prices AS (SELECT article_id, CAST(round_even(median(price) * 1000, 0) AS BIGINT) AS price_k FROM train_b GROUP BY article_id),
intents AS (SELECT 'c:' || CAST(x.conv_id AS VARCHAR) || ':' || CAST(x.turn AS VARCHAR) AS msg_id, x.conv_id, x.turn,
                   {_intent_cols_sql('x.intent_text')}, {_group_sql('x', 'message', 'cur_group')},
                   {_group_sql('x', 'intent_text', 'any_group')}
            FROM ctx x
            WHERE NOT coalesce(regexp_matches(x.message, '{_rx(I.UNSAFE)}'), false)
              AND NOT coalesce(regexp_matches(x.message, '{_rx(I.GREETING)}'), false)),
found AS (SELECT * FROM (
  SELECT i.msg_id, x.article_id, row_number() OVER (PARTITION BY i.msg_id ORDER BY coalesce(p.score, 0.0) DESC, x.article_id) AS rank
  FROM qt q JOIN intents i ON i.msg_id = q.query_id JOIN tax x USING (taxonomy)
  LEFT JOIN pop_b p ON p.article_id = x.article_id LEFT JOIN prices r ON r.article_id = x.article_id
  WHERE i.max_budget IS NULL OR coalesce(r.price_k, 0) <= i.max_budget) WHERE rank <= 20),
segs AS ({_SEG_SQL.format(ev="train_b", m=50)}),
cats AS (SELECT lower(c.product_group_name) AS product_group_name, p.article_id,
                row_number() OVER (PARTITION BY lower(c.product_group_name) ORDER BY p.score DESC, p.article_id) AS rank
         FROM pop_b p JOIN items c USING (article_id) WHERE c.product_group_name <> ''),
routed AS (SELECT i.msg_id, i.max_budget, lower(trim(coalesce(cur_group, any_group))) AS category, w.age_band, w.status,
                  CASE WHEN coalesce(cur_group, any_group) IS NULL
                            AND EXISTS (SELECT 1 FROM segs s WHERE s.age_band = w.age_band AND s.club_member_status = w.status)
                         THEN 'demographic_popularity'
                       WHEN lower(trim(coalesce(cur_group, any_group))) IN (SELECT product_group_name FROM cats) THEN 'category_popularity'
                       ELSE 'global_popularity' END AS strategy
           FROM intents i JOIN (
             SELECT t.conv_id, coalesce(any_value(b.age_band), 'unknown') AS age_band, coalesce(any_value(b.status), 'none') AS status
             FROM (SELECT DISTINCT conv_id FROM intents) t LEFT JOIN (
               SELECT customer_id, {sql_age_band('age')} AS age_band, lower(coalesce(club_member_status, 'none')) AS status FROM customers) b
             ON b.customer_id = CAST(t.conv_id AS VARCHAR) GROUP BY t.conv_id) w ON w.conv_id = i.conv_id
           WHERE i.msg_id NOT IN (SELECT msg_id FROM found)),
fell AS (SELECT f.msg_id, f.strategy, f.rank, f.article_id, coalesce(r.price_k, 0) AS price_k
  FROM (SELECT msg_id, max_budget, strategy, s.rank, s.article_id FROM routed JOIN segs s ON strategy = 'demographic_popularity'
               AND s.age_band = routed.age_band AND s.club_member_status = routed.status
        UNION ALL SELECT msg_id, max_budget, strategy, c.rank, c.article_id FROM routed JOIN cats c
               ON strategy = 'category_popularity' AND c.product_group_name = category
        UNION ALL SELECT msg_id, max_budget, strategy, p.pop_rank, p.article_id FROM routed JOIN pop_b p ON strategy = 'global_popularity') f
  LEFT JOIN prices r ON r.article_id = f.article_id
  WHERE f.rank <= 20 AND (f.max_budget IS NULL OR coalesce(r.price_k, 0) <= f.max_budget)),
pool AS (SELECT s.*, m.prod_name, m.product_group_name, coalesce(nullif(m.item_text, ''), m.detail_desc) AS description
         FROM (SELECT msg_id, rank, article_id, true AS catalog FROM found UNION ALL SELECT msg_id, rank, article_id, false FROM fell) s
         JOIN items m USING (article_id)),
filt AS (SELECT * FROM (SELECT p.*, i."limit", row_number() OVER (PARTITION BY p.msg_id ORDER BY p.rank) AS final_rank
                        FROM pool p JOIN intents i USING (msg_id)
                        WHERE (p.catalog OR coalesce(i.cur_group, i.any_group) IS NULL
                               OR contains(lower(coalesce(p.product_group_name, '')), lower(coalesce(i.cur_group, i.any_group))))
                          AND (i.colour IS NULL OR contains(lower(concat_ws(' ', '', coalesce(p.prod_name, ''), coalesce(p.description, ''))), i.colour))
                          AND (i.style IS NULL OR contains(lower(concat_ws(' ', coalesce(p.prod_name, ''), coalesce(p.description, ''))), i.style)))
         WHERE final_rank <= "limit")"""
_FLOW_DEPS = ("items", "customers", "train_b", "pop_b")
POOL = 20  # candidates per chat turn


def _chat_flow(spark, d):
    """(intents, fallback recommendations, candidate pool) of the shopping messages."""
    f = Frames(spark, d)
    msg = F.concat_ws(":", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("msg_id")
    turns, groups = shopping_messages(spark, d), I.product_groups(f.items)
    cur = I.extract_product_group(turns.where(F.col("role") == "user").select(msg, "text"), groups) \
        .withColumnRenamed("product_group", "cur_group")
    intents = (I.assistant_intents(turns, groups).where(F.col("guardrail").isNull() & ~F.col("is_greeting"))
               .select(msg, "product_group", "colour", "style", "limit", "max_budget").join(cur, "msg_id", "left"))
    asked = _search_queries(spark, d).join(intents.select(F.col("msg_id").alias("query_id"), "max_budget"), "query_id")
    prices = median_price(f.train)
    hits = S.search_catalog(asked, f.items, f.pop, POOL, prices, "max_budget").select(
        F.col("query_id").alias("msg_id"), "rank", "article_id", F.lit(True).alias("catalog_search"))
    missed = intents.join(hits.select("msg_id").distinct(), "msg_id", "left_anti")
    # The context of a conversation is the customer of its number, where there is one.
    context = f.customers.select(F.concat(F.lit("c:"), "customer_id").alias("asker"), "age", "club_member_status")
    missed = missed.withColumn("asker", F.substring_index("msg_id", ":", 2)).join(context, "asker", "left")
    requests = missed.select(F.col("msg_id").alias("request_id"), F.lit(POOL).alias("limit"), "age", "club_member_status",
                             F.col("product_group").alias("preferred_product_group"),
                             F.col("product_group").isNull().alias("use_demographics"))
    recs = CS.rec_cold_start(requests, P.segment_rankings(f.train, f.customers, 50, top_n=CS.MAX_LIMIT),
                             P.category_rankings(f.train, f.items, top_n=CS.MAX_LIMIT), f.pop)
    fell = (budget_filter(recs, prices, None).withColumnRenamed("request_id", "msg_id")
            .join(intents.select("msg_id", "max_budget"), "msg_id")
            .where(F.col("max_budget").isNull() | (F.col("price_k") <= F.col("max_budget")))
            .select("msg_id", "strategy", "rank", "article_id", "price_k"))
    meta = f.items.select("article_id", "prod_name", "product_group_name",
                          F.coalesce(F.nullif(F.col("item_text"), F.lit("")), F.col("detail_desc")).alias("description"),
                          F.lit(None).cast("string").alias("colour_text"))
    pool = hits.unionByName(fell.select("msg_id", "rank", "article_id", F.lit(False).alias("catalog_search"))).join(meta, "article_id")
    return intents, fell, pool


@register("constraint_filter", with_ctes("SELECT msg_id, final_rank, article_id FROM filt", *_FLOW_DEPS, extra=_FLOW))
def q_constraint_filter(spark, d):
    intents, _, pool = _chat_flow(spark, d)
    return I.constraint_filter(pool, intents).select("msg_id", "final_rank", "article_id")


@register("result_message", with_ctes("""
SELECT msg_id, 'I found ' || CAST(n AS VARCHAR) || ' grounded recommendation(s)' ||
       CASE WHEN q <> '' THEN ' for ' || q ELSE '' END || '.' ||
       CASE WHEN n = 0 THEN ' Try a broader category or fewer constraints.' ELSE '' END AS message
FROM (SELECT i.msg_id, coalesce(n.n, 0) AS n,
             concat_ws(' · ', i.colour, i.style,
                       CASE WHEN i.msg_id IN (SELECT msg_id FROM found) THEN i.cur_group ELSE coalesce(i.cur_group, i.any_group) END,
                       CASE WHEN i.max_budget IS NOT NULL THEN 'under $' || CAST(CAST(trunc(i.max_budget) AS BIGINT) AS VARCHAR) END) AS q
      FROM intents i LEFT JOIN (SELECT msg_id, count(*) AS n FROM filt GROUP BY 1) n USING (msg_id))""", *_FLOW_DEPS, extra=_FLOW))
def q_result_message(spark, d):
    """Counts what is left after search or fallback; catalog hits clear a group that older turns named."""
    intents, _, pool = _chat_flow(spark, d)
    n = I.constraint_filter(pool, intents).groupBy("msg_id").agg(F.count(F.lit(1)).alias("n"))
    searched = pool.where("catalog_search").select("msg_id").distinct().withColumn("searched", F.lit(True))
    j = intents.join(n, "msg_id", "left").join(searched, "msg_id", "left")
    group = F.when(F.col("searched"), F.col("cur_group")).otherwise(F.col("product_group"))
    return j.select("msg_id", I.result_message(F.coalesce("n", F.lit(0)), F.col("colour"), F.col("style"), group,
                                               F.col("max_budget")).alias("message"))


@register("intent_fallback", with_ctes("SELECT msg_id, strategy, rank, article_id, price_k FROM fell", *_FLOW_DEPS, extra=_FLOW))
def q_intent_fallback(spark, d):
    """Chat turns without catalog hits fall back to routed recommendations within the budget."""
    return _chat_flow(spark, d)[1]


@register("build_request", with_ctes("""
SELECT request_id, CASE WHEN mode = 'Personalized' THEN nullif(trim(user_id), '') END AS user_id, CAST("limit" AS INTEGER) AS "limit",
       CASE WHEN mode <> 'Personalized' THEN age END AS age,
       CASE WHEN mode <> 'Personalized' AND membership NOT IN ('Not specified', '') THEN lower(membership) END AS club_member_status,
       CASE WHEN mode <> 'Personalized' AND product_group NOT IN ('All products', '') THEN product_group END AS preferred_product_group,
       CASE WHEN mode = 'Personalized' THEN '' ELSE
         array_to_string(list_slice(list_filter(list_transform(string_split(coalesce(session_text, ''), ','), lambda s: trim(s)),
                                                lambda s: s <> ''), 1, 50), ',') END AS session_ids
FROM controls""", "customers", "train_b", extra="""
controls AS (SELECT c.customer_id AS request_id, CASE WHEN CAST(c.customer_id AS BIGINT) % 2 = 0 THEN 'Personalized' ELSE 'Explore' END AS mode,
                    c.customer_id AS user_id, 10 AS "limit", c.age, coalesce(nullif(c.club_member_status, 'none'), 'Not specified') AS membership,
                    CASE WHEN CAST(c.customer_id AS BIGINT) % 3 = 0 THEN 'Brand#' || CAST(CAST(c.customer_id AS BIGINT) % 5 + 11 AS VARCHAR)
                         ELSE 'All products' END AS product_group, h.session_text
             FROM customers c LEFT JOIN (SELECT customer_id, string_agg(article_id, ' , ' ORDER BY event_ts, article_id) AS session_text
                                         FROM train_b GROUP BY 1) h USING (customer_id))"""))
def q_build_request(spark, d):
    """UI controls per customer: even ids personalised, odd ids exploring with their history as a session; every third with a group."""
    f = Frames(spark, d)
    hist = f.train.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("event_ts", "article_id"))).alias("h")) \
        .select("customer_id", F.array_join(F.col("h.article_id"), " , ").alias("session_text"))
    c = f.customers.join(hist, "customer_id", "left")
    number = F.col("customer_id").cast("long")
    controls = c.select(
        F.col("customer_id").alias("request_id"),
        F.when(F.col("customer_id").cast("long") % 2 == 0, F.lit("Personalized")).otherwise(F.lit("Explore")).alias("mode"),
        F.col("customer_id").alias("user_id"), F.lit(10).alias("limit"), "age",
        F.coalesce(F.nullif(F.col("club_member_status"), F.lit("none")), F.lit("Not specified")).alias("membership"),
        F.when(number % 3 == 0, F.concat(F.lit("Brand#"), (number % 5 + 11).cast("string"))).otherwise(F.lit("All products")).alias("product_group"),
        "session_text")
    out = I.build_request(controls)
    return out.select("request_id", "user_id", "limit", "age", "club_member_status", "preferred_product_group",
                      F.array_join("session_article_ids", ",").alias("session_ids"))


@register("src_csv_required", with_ctes("""
SELECT customer_id, CAST(FN AS VARCHAR) AS FN, CAST(Active AS VARCHAR) AS Active, nullif(club_member_status, '') AS club_member_status, fashion_news_frequency,
       CAST(age AS VARCHAR) AS age FROM customers_raw""", "customers_raw"))
def q_src_csv_required(spark, d):
    """Customers written as CSV to the checkpoint folder, read back as text with the required columns; empty text is null there."""
    from tastebud.session import checkpoint_dir
    from tastebud.sources.tables import REQUIRED_CUSTOMER_COLUMNS, read_table
    f = Frames(spark, d)
    path = f"{checkpoint_dir(spark)}/csv/customers-{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    (f.raw_customers.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_table(spark, path, REQUIRED_CUSTOMER_COLUMNS, "customers")


@register("report_tables")
def q_report_tables(spark, d):
    """Baseline report (configuration, data counts, metrics) written as JSON and returned long."""
    from tastebud.plans.evaluations import eval_baseline
    from tastebud.session import checkpoint_dir
    f = Frames(spark, d)
    metrics = eval_baseline(f, K)
    counts = f.train.agg(F.count(F.lit(1)).cast("double").alias("training_rows"),
                         F.count_distinct("customer_id").cast("double").alias("training_users"),
                         F.count_distinct("article_id").cast("double").alias("training_items"))
    cols = [c for c in metrics.columns if c != "model"]
    long = metrics.select("model", *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot(["model"], cols, "metric", "value").select(F.lit("metrics").alias("section"),
                                                            F.concat_ws(".", "model", "metric").alias("name"), "value")
    data = counts.unpivot([], counts.columns, "name", "value").select(F.lit("data").alias("section"), "name", "value")
    config = spark.createDataFrame([("configuration", "k", float(K)), ("configuration", "n_components", 64.0),
                                    ("configuration", "random_state", 42.0)], "section string, name string, value double")
    report = config.unionByName(data).unionByName(long)
    report.coalesce(1).write.mode("overwrite").json(f"{checkpoint_dir(spark)}/reports/baseline-{hashlib.sha256(d.encode()).hexdigest()[:16]}")
    return report
