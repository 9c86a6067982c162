"""Hybrid mechanics and cold start (SQL-checked on SQL-derivable candidate lists),
plus factor-model rankers (checked against numpy in tests; rows-only here)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tastebud.functions.numeric import r6
from tastebud.operators import coldstart as CS
from tastebud.operators.coldstart import MAX_LIMIT
from tastebud.operators import evaluate as E
from tastebud.operators import models as M
from tastebud.operators import policy as PO
from tastebud.operators import popularity as P
from tastebud.plans.frames import K, Frames
from tastebud.plans.oracle import age_band as sql_age_band
from tastebud.plans.oracle import with_ctes
from tastebud.plans.queries_eval import bootstrap_sql, random_policy_sql
from tastebud.plans.queries_rank import REC_POP_SQL, _SEG_SQL
from tastebud.plans.registry import register

CAND_K = K * 10  # candidate multiplier 10
WEIGHT = 0.75


# --- candidate lists ---------------------------------------------------------
def _cands(f: Frames):
    users = f.truth("val").select("customer_id").distinct()
    cf = P.rec_popularity(f.pop, f.seen, users, CAND_K)
    ct = PO.random_policy(f.train_items, f.seen, users, CAND_K, seed=42)
    return cf, ct


_RP = random_policy_sql("truth_val_b", "train_b", "seen_b", CAND_K)
CANDS = ",\n".join([
    "tusers AS (SELECT DISTINCT customer_id FROM truth_val_b)",
    "cfc AS (" + REC_POP_SQL.format(users="tusers", pop="pop_b", seen="seen_b", k=CAND_K) + ")",
    _RP[0].strip(),
    "ctc AS (SELECT * FROM rp)",
    """cfn AS (SELECT customer_id, article_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
                 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
               FROM cfc WINDOW w AS (PARTITION BY customer_id))""",
    """ctn AS (SELECT customer_id, article_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
                 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
               FROM ctc WINDOW w AS (PARTITION BY customer_id))""",
    f"""bl AS (SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, coalesce(a.article_id, b.article_id) AS article_id,
                 {WEIGHT} * coalesce(a.norm, 0) AS cfc_, {1 - WEIGHT} * coalesce(b.norm, 0) AS ctc_,
                 {WEIGHT} * coalesce(a.norm, 0) + {1 - WEIGHT} * coalesce(b.norm, 0) AS score
               FROM cfn a FULL OUTER JOIN ctn b ON a.customer_id = b.customer_id AND a.article_id = b.article_id)""",
    f"""hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 12) DESC, article_id) AS rank
               FROM bl) WHERE rank <= {K})""",
])
CANDS_DEPS = ("truth_val_b", "pop_b", "seen_b", "train_b")


@register("minmax_per_request", with_ctes("SELECT customer_id, article_id, round(norm, 6) AS norm FROM cfn",
                                          *CANDS_DEPS, extra=CANDS))
def q_minmax(spark, d):
    cf, _ = _cands(Frames(spark, d))
    return M.minmax(cf).select("customer_id", "article_id", r6("norm").alias("norm"))


@register("full_outer_blend", with_ctes("""
SELECT customer_id, article_id, round(score, 6) AS score, round(cfc_, 6) AS collaborative_contribution,
       round(ctc_, 6) AS content_contribution FROM bl""", *CANDS_DEPS, extra=CANDS))
def q_full_outer_blend(spark, d):
    cf, ct = _cands(Frames(spark, d))
    b = M.blend(cf, ct, WEIGHT)
    return b.select("customer_id", "article_id", r6("score").alias("score"),
                    r6("collaborative_contribution").alias("collaborative_contribution"),
                    r6("content_contribution").alias("content_contribution"))


@register("rec_hybrid", with_ctes("SELECT customer_id, rank, article_id, round(score, 6) AS score FROM hy",
                                  *CANDS_DEPS, extra=CANDS))
def q_rec_hybrid(spark, d):
    cf, ct = _cands(Frames(spark, d))
    return M.rec_hybrid(cf, ct, WEIGHT, K).select("customer_id", "rank", "article_id", r6("score").alias("score"))


@register("rec_hybrid_components", with_ctes("""
SELECT customer_id, rank, article_id, round(cfc_, 6) AS collaborative_contribution, round(ctc_, 6) AS content_contribution
FROM hy""", *CANDS_DEPS, extra=CANDS))
def q_rec_hybrid_components(spark, d):
    cf, ct = _cands(Frames(spark, d))
    h = M.rec_hybrid(cf, ct, WEIGHT, K)
    return h.select("customer_id", "rank", "article_id", r6("collaborative_contribution").alias("collaborative_contribution"),
                    r6("content_contribution").alias("content_contribution"))


_RPF = random_policy_sql("truth_val_b", "fresh_b", "seen_b", CAND_K, p="f")
FRESH = CANDS + ",\n" + """
fresh_b AS (SELECT DISTINCT article_id FROM items WHERE article_id NOT IN (SELECT article_id FROM train_b))""" + ",\n" + \
    _RPF[0].strip() + f""",
outp AS (SELECT h.customer_id, h.rank, h.article_id, h.score, h.article_id IN (SELECT article_id FROM fresh_b) AS fr FROM hy h),
need AS (SELECT customer_id, 1 - count(*) FILTER (WHERE fr) AS nd FROM outp GROUP BY 1 HAVING 1 - count(*) FILTER (WHERE fr) > 0),
adds AS (SELECT * FROM (SELECT c.customer_id, c.article_id, c.score, n.nd,
                               row_number() OVER (PARTITION BY c.customer_id ORDER BY c.score DESC, c.article_id) AS r
                        FROM frp c JOIN need n USING (customer_id)
                        WHERE NOT EXISTS (SELECT 1 FROM outp o WHERE o.customer_id = c.customer_id AND o.article_id = c.article_id))
         WHERE r <= nd),
nadd AS (SELECT customer_id, count(*) AS na FROM adds GROUP BY 1),
kept AS (SELECT o.customer_id, o.article_id, o.score FROM (
           SELECT o.*, row_number() OVER (PARTITION BY o.customer_id, o.fr ORDER BY o.rank DESC) AS rev FROM outp o) o
         LEFT JOIN nadd n USING (customer_id) WHERE o.fr OR n.na IS NULL OR o.rev > n.na),
merged AS (SELECT * FROM kept UNION ALL SELECT customer_id, article_id, score FROM adds),
fq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 12) DESC, article_id) AS rank
       FROM merged) WHERE rank <= {K})"""


@register("fresh_quota", with_ctes("SELECT customer_id, rank, article_id, round(score, 6) AS score FROM fq",
                                   *CANDS_DEPS, "items", extra=FRESH))
def q_fresh_quota(spark, d):
    f = Frames(spark, d)
    cf, ct = _cands(f)
    out = M.rec_hybrid(cf, ct, WEIGHT, K).select("customer_id", "rank", "article_id", "score")
    users = f.truth("val").select("customer_id").distinct()
    fresh_c = PO.random_policy(f.fresh_items, f.seen, users, CAND_K, seed=42)
    q = M.fresh_quota(out, fresh_c, f.fresh_items, 1, K)
    return q.select("customer_id", "rank", "article_id", r6("score").alias("score"))


WEIGHTS = (0.25, 0.5, 0.75)


def _tune_sql() -> str:
    parts = []
    for w in WEIGHTS:
        parts.append(f"""SELECT {w} AS weight, customer_id, article_id,
              row_number() OVER (PARTITION BY customer_id ORDER BY round({w} * coalesce(a_norm, 0) + {1 - w} * coalesce(b_norm, 0), 12) DESC, article_id) AS rank
            FROM fo""")
    return f"""
fo AS (SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, coalesce(a.article_id, b.article_id) AS article_id,
              a.norm AS a_norm, b.norm AS b_norm FROM cfn a FULL OUTER JOIN ctn b
              ON a.customer_id = b.customer_id AND a.article_id = b.article_id),
wr AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rank <= {K}),
wsz AS (SELECT customer_id, count(*) AS n_truth FROM truth_val_b GROUP BY 1),
whits AS (SELECT r.weight, r.customer_id, r.rank,
                 row_number() OVER (PARTITION BY r.weight, r.customer_id ORDER BY r.rank) AS hs
          FROM wr r JOIN truth_val_b v ON r.customer_id = v.customer_id AND r.article_id = v.article_id),
wpu AS (SELECT w.weight, u.customer_id,
               coalesce((SELECT sum(1.0 / log2(h.rank + 1)) FROM whits h WHERE h.weight = w.weight AND h.customer_id = u.customer_id), 0)
                 / list_sum(list_transform(range(1, least(u.n_truth, {K}) + 1), lambda r: 1.0 / log2(r + 1))) AS ndcg,
               coalesce((SELECT sum(h.hs / h.rank) FROM whits h WHERE h.weight = w.weight AND h.customer_id = u.customer_id), 0)
                 / least(u.n_truth, {K}) AS ap,
               CASE WHEN EXISTS (SELECT 1 FROM whits h WHERE h.weight = w.weight AND h.customer_id = u.customer_id) THEN 1.0 ELSE 0.0 END AS hit
        FROM (SELECT DISTINCT weight FROM wr) w CROSS JOIN (SELECT * FROM wsz WHERE customer_id IN (SELECT customer_id FROM wr)) u),
wm AS (SELECT weight, avg(ndcg) AS ndcg_at_k, avg(ap) AS map_at_k, avg(hit) AS hit_rate_at_k FROM wpu GROUP BY weight)"""


@register("tune_hybrid_weight", with_ctes("""
SELECT CAST(weight AS DOUBLE) AS weight, round(ndcg_at_k, 6) AS ndcg_at_k, round(map_at_k, 6) AS map_at_k, round(hit_rate_at_k, 6) AS hit_rate_at_k,
       weight = (SELECT weight FROM wm ORDER BY round(ndcg_at_k, 12) DESC, round(map_at_k, 12) DESC, round(hit_rate_at_k, 12) DESC, weight LIMIT 1) AS is_best
FROM wm""", *CANDS_DEPS, extra=CANDS + "," + _tune_sql()))
def q_tune_hybrid_weight(spark, d):
    from tastebud.plans.evaluations import tune_hybrid_weight
    f = Frames(spark, d)
    cf, ct = _cands(f)
    out = tune_hybrid_weight(cf, ct, f.truth("val"), WEIGHTS, K)
    return out.select("weight", *[r6(m).alias(m) for m in E.METRICS], "is_best")


# --- cold start on the order adapter (it has users new in the test weeks) ------
def _dev(f: Frames):
    return f.train.unionByName(f.val)


def _cold_models(f: Frames):
    dev = _dev(f)
    # rec_cold_start refuses limits beyond MAX_LIMIT, so rankings cut there answer every request exactly
    segs = P.segment_rankings(dev, f.customers, 50, top_n=MAX_LIMIT)
    cats = P.category_rankings(dev, f.items, top_n=MAX_LIMIT)
    pop = P.popularity(dev)
    return dev, segs, cats, pop


def _cold_requests(f: Frames, dev):
    known = dev.select("customer_id").distinct()
    catalog = dev.select("article_id").distinct()
    cold = (f.test.join(known, "customer_id", "left_anti").join(catalog, "article_id", "left_semi")
            .select("customer_id", "article_id").distinct())
    users = cold.groupBy("customer_id").agg(F.min("article_id").alias("article_id"))
    prof = (users.join(f.customers.select("customer_id", "age", "club_member_status"), "customer_id", "left")
            .join(f.items.select("article_id", "product_group_name"), "article_id", "left"))
    base = prof.select(F.lit(K).alias("limit"), "age", "club_member_status",
                       F.lit(None).cast("string").alias("preferred_product_group"), "customer_id")
    category = prof.select(F.concat(F.col("customer_id"), F.lit(":category")).alias("request_id"), F.lit(K).alias("limit"), "age",
                           "club_member_status", F.col("product_group_name").alias("preferred_product_group"), "customer_id",
                           F.lit(False).alias("use_demographics"))
    demo = base.select(F.concat(F.col("customer_id"), F.lit(":demographic")).alias("request_id"), "*",
                       F.lit(True).alias("use_demographics"))
    glob = base.select(F.concat(F.col("customer_id"), F.lit(":global")).alias("request_id"), "*",
                       F.lit(False).alias("use_demographics"))
    return demo.unionByName(glob).unionByName(category), cold


COLD = f"""
dev AS (SELECT * FROM train_a UNION ALL SELECT * FROM val_a),
segs AS ({_SEG_SQL.format(ev="dev", m=50)}),
cats AS (SELECT product_group_name, rank, article_id, score FROM (
  SELECT c.product_group_name, p.article_id, p.score,
         row_number() OVER (PARTITION BY c.product_group_name ORDER BY p.score DESC, p.article_id) AS rank
  FROM (SELECT article_id, CAST(count(*) AS DOUBLE) AS score FROM dev GROUP BY article_id) p
  LEFT JOIN (SELECT article_id, lower(coalesce(product_group_name, '')) AS product_group_name FROM items) c USING (article_id)
  WHERE c.product_group_name IS NOT NULL AND c.product_group_name <> '')),
dpop AS (SELECT article_id, score, row_number() OVER (ORDER BY score DESC, article_id) AS pop_rank
         FROM (SELECT article_id, CAST(count(*) AS DOUBLE) AS score FROM dev GROUP BY article_id)),
cold AS (SELECT DISTINCT customer_id, article_id FROM test_a
         WHERE customer_id NOT IN (SELECT customer_id FROM dev) AND article_id IN (SELECT article_id FROM dev)),
creq AS (SELECT u.customer_id, {sql_age_band('c.age')} AS age_band,
                lower(coalesce(c.club_member_status, 'none')) AS status, lower(trim(i.product_group_name)) AS category
         FROM (SELECT customer_id, min(article_id) AS article_id FROM cold GROUP BY customer_id) u
         LEFT JOIN customers c USING (customer_id) LEFT JOIN items i USING (article_id)),
reqs AS (SELECT customer_id || ':demographic' AS request_id, customer_id, age_band, status, NULL AS category, true AS use_demo FROM creq
         UNION ALL SELECT customer_id || ':global', customer_id, age_band, status, NULL, false FROM creq
         UNION ALL SELECT customer_id || ':category', customer_id, age_band, status, category, false FROM creq),
strat AS (SELECT r.*, CASE WHEN r.use_demo AND EXISTS (SELECT 1 FROM segs s WHERE s.age_band = r.age_band AND s.club_member_status = r.status)
                        THEN 'demographic_popularity'
                        WHEN r.category IN (SELECT product_group_name FROM cats) THEN 'category_popularity'
                        ELSE 'global_popularity' END AS strategy FROM reqs r),
cs AS (SELECT s.request_id, s.strategy,
              CASE WHEN s.strategy = 'demographic_popularity' THEN 'Popular with shoppers in age band ' || s.age_band || ' and membership ' || s.status || '.'
                   ELSE 'Popular products across all shoppers.' END AS explanation,
              x.rank, x.article_id, x.score
       FROM strat s JOIN segs x ON s.strategy = 'demographic_popularity' AND x.age_band = s.age_band
                              AND x.club_member_status = s.status AND x.rank <= {K}
       UNION ALL
       SELECT s.request_id, s.strategy, 'Popular products across all shoppers.', p.pop_rank, p.article_id, p.score
       FROM strat s JOIN dpop p ON s.strategy = 'global_popularity' AND p.pop_rank <= {K}
       UNION ALL
       SELECT s.request_id, s.strategy, 'Popular products in ' || s.category || '.', c.rank, c.article_id, c.score
       FROM strat s JOIN cats c ON s.strategy = 'category_popularity' AND c.product_group_name = s.category AND c.rank <= {K}),
csu AS (SELECT CASE WHEN request_id LIKE '%:global' THEN 'global_popularity' ELSE 'demographic_fallback' END AS model, *
        FROM cs WHERE request_id NOT LIKE '%:category')"""
COLD_DEPS = ("train_a", "val_a", "test_a", "items", "customers")


@register("rec_cold_start", with_ctes("SELECT request_id, strategy, explanation, rank, article_id, score FROM cs",
                                      *COLD_DEPS, extra=COLD))
def q_rec_cold_start(spark, d):
    f = Frames(spark, d, adapter="orders")
    dev, segs, cats, pop = _cold_models(f)
    reqs, _ = _cold_requests(f, dev)
    return CS.rec_cold_start(reqs.drop("customer_id"), segs, cats, pop)


_COLD_USERS = f"""
cpu AS (SELECT r.model, sz.customer_id,
         coalesce(sum(CASE WHEN v.article_id IS NOT NULL THEN 1.0 / log2(r.rank + 1) END), 0)
           / list_sum(list_transform(range(1, least(sz.n_truth, {K}) + 1), lambda q: 1.0 / log2(q + 1))) AS ndcg_at_k,
         coalesce(sum(CASE WHEN v.article_id IS NOT NULL THEN h.hs / r.rank END), 0) / least(sz.n_truth, {K}) AS map_at_k,
         CAST(CASE WHEN count(v.article_id) > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS hit_rate_at_k
  FROM csu r JOIN (SELECT customer_id, count(*) AS n_truth FROM cold GROUP BY 1) sz
       ON sz.customer_id = split_part(r.request_id, ':', 1)
  LEFT JOIN cold v ON v.customer_id = sz.customer_id AND v.article_id = r.article_id
  LEFT JOIN (SELECT r2.request_id, r2.rank, row_number() OVER (PARTITION BY r2.request_id ORDER BY r2.rank) AS hs
             FROM cs r2 JOIN cold v2 ON v2.customer_id = split_part(r2.request_id, ':', 1) AND v2.article_id = r2.article_id) h
       ON h.request_id = r.request_id AND h.rank = r.rank
  GROUP BY r.model, r.request_id, sz.customer_id, sz.n_truth)"""


@register("eval_cold_start", with_ctes("""
SELECT * FROM (SELECT model, count(*) AS users_evaluated, round(avg(ndcg_at_k), 6) AS ndcg_at_k, round(avg(map_at_k), 6) AS map_at_k,
       round(avg(hit_rate_at_k), 6) AS hit_rate_at_k FROM cpu GROUP BY model)
JOIN (SELECT model, round(count(DISTINCT article_id) / (SELECT count(*) FROM dpop), 6) AS catalog_coverage_at_k FROM csu GROUP BY model) USING (model)
JOIN (SELECT model, """ + ", ".join(f"round(quantile_cont({m}, {q}), 6) AS {m}_ci95_{side}" for m in E.METRICS
                                    for side, q in (("lower", 0.025), ("upper", 0.975))) + """
      FROM means GROUP BY model) USING (model)""", *COLD_DEPS, extra=COLD + "," + _COLD_USERS + "," + bootstrap_sql("cpu", "model", 42, 1000)))
def q_eval_cold_start(spark, d):
    from tastebud.plans.evaluations import eval_cold_start
    f = Frames(spark, d, adapter="orders")
    reqs, cold = _cold_requests(f, _dev(f))
    out = eval_cold_start(f, _cold_models(f), (reqs.where(~F.col("request_id").endswith(":category")), cold), K)
    bounds = [f"{m}_ci95_{side}" for m in E.METRICS for side in ("lower", "upper")]
    return out.select("model", "users_evaluated", *[r6(m).alias(m) for m in (*E.METRICS, "catalog_coverage_at_k", *bounds)])


@register("cold_start_examples", with_ctes(f"""
SELECT 'demographics' AS "case", 'demographic_popularity' AS strategy,
       'Popular with shoppers in age band ' || age_band || ' and membership ' || club_member_status || '.' AS explanation, rank, article_id
FROM segs WHERE rank <= {K} AND (age_band, club_member_status) = (
  SELECT (age_band, club_member_status) FROM segs WHERE age_band IN ('16-24', '25-34', '35-49', '50+') ORDER BY 1 LIMIT 1)
UNION ALL SELECT 'category', 'category_popularity', 'Popular products in ' || product_group_name || '.', rank, article_id
FROM cats WHERE rank <= {K} AND product_group_name = (SELECT min(product_group_name) FROM cats)
UNION ALL SELECT 'session', 'session_content', 'Based on products viewed this session.', range, NULL FROM range(1, {K + 1})
UNION ALL SELECT 'no_context', 'global_popularity', 'Popular products across all shoppers.', pop_rank, article_id FROM dpop WHERE pop_rank <= {K}""",
                                           *COLD_DEPS, extra=COLD))
def q_cold_start_examples(spark, d):
    """The report's four example requests; the items of the session, which factors rank, are left to pytest."""
    from tastebud.plans.evaluations import cold_start_examples, content_model
    f = Frames(spark, d, adapter="orders")
    out = cold_start_examples(_cold_models(f), content_model(f), K)
    return out.select(F.col("request_id").alias("case"), "strategy", "explanation", "rank",
                      F.when(F.col("strategy") != "session_content", F.col("article_id")).alias("article_id"))


# --- factor models (numpy-checked in tests; rows-only here) --------------------
def _users(f: Frames):
    return f.truth("val").select("customer_id").distinct()


@register("truncated_svd")
def q_truncated_svd(spark, d):
    from tastebud.plans.evaluations import cf_model
    m = cf_model(Frames(spark, d))
    return spark.createDataFrame([(i + 1, float(s)) for i, s in enumerate(m.sigma)], "component long, singular_value double")


@register("cf_factors")
def q_cf_factors(spark, d):
    from tastebud.operators.factors import project_rows
    from tastebud.plans.evaluations import cf_model
    m = cf_model(Frames(spark, d))
    return project_rows(m.rows.withColumnRenamed("customer_id", "row"), m.factors.withColumnRenamed("item_idx", "col")) \
        .withColumnRenamed("row", "customer_id")


@register("content_item_factors")
def q_content_item_factors(spark, d):
    from tastebud.plans.evaluations import content_model
    return M.item_vectors(content_model(Frames(spark, d)))


@register("content_user_profile")
def q_content_user_profile(spark, d):
    from tastebud.operators.factors import project_rows
    from tastebud.plans.evaluations import content_model
    m = content_model(Frames(spark, d))
    return project_rows(m.rows.withColumnRenamed("customer_id", "row"), m.item_factors.withColumnRenamed("item_idx", "col"),
                        normalize=True).withColumnRenamed("row", "customer_id")


@register("rec_cf")
def q_rec_cf(spark, d):
    from tastebud.plans.evaluations import cf_model
    f = Frames(spark, d)
    return M.rec_cf(cf_model(f), f.clean.select("customer_id").distinct(), K)


# Given item vectors: ``embeddings``, whose vec_id is the article key.
GIVEN = """
gvec AS (SELECT article_id, pos, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY article_id)), 0) AS x FROM (
  SELECT CAST(vec_id AS VARCHAR) AS article_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)),
gtaste AS (SELECT customer_id, pos, sum(n * x) AS x FROM (
  SELECT customer_id, article_id, ln(1 + count(*)) AS n FROM train_b GROUP BY 1, 2) JOIN gvec USING (article_id) GROUP BY 1, 2),
gpairs AS (SELECT t.customer_id, v.article_id, sum(t.x * v.x) AS score FROM gtaste t JOIN gvec v USING (pos) GROUP BY 1, 2)"""


def _given_vectors(f: Frames):
    """(item_idx, article_id, vec): the given vectors at unit length, numbered in id order."""
    from tastebud.functions.index import dense_index
    from tastebud.operators.similar import normalize_vectors
    from tastebud.sources.tables import load_table
    e = normalize_vectors(load_table(f.spark, f.sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = e.select(F.col("vec_id").cast("string").alias("article_id"), F.col("embedding").alias("vec"))
    return dense_index(rows, [F.col("article_id")], "item_idx")


@register("cross_score", with_ctes(f"""
SELECT customer_id, rank, article_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 9) DESC, article_id) AS rank FROM gpairs p
  WHERE NOT EXISTS (SELECT 1 FROM seen_b s WHERE s.customer_id = p.customer_id AND s.article_id = p.article_id)) WHERE rank <= {K}""",
                                   "train_b", "seen_b", extra=GIVEN))
def q_cross_score(spark, d):
    """Every training user against every given item vector: taste = weighted sum of the history's vectors, unseen top 12."""
    from tastebud.operators.confidence import interaction_confidence
    from tastebud.operators.factors import csr_rows, top_k_scores
    f = Frames(spark, d)
    vectors = _given_vectors(f).persist()
    known = interaction_confidence(f.train).join(vectors.select("article_id", "item_idx"), "article_id")
    rows = csr_rows(known, "customer_id", "item_idx", "weight").withColumnRenamed("row", "customer_id")
    top = top_k_scores(rows, vectors.select("item_idx", "vec"), K, mode="raw", digits=9)
    return top.join(vectors.select("item_idx", "article_id"), "item_idx").select("customer_id", "rank", "article_id", r6("score").alias("score"))


@register("rec_content")
def q_rec_content(spark, d):
    from tastebud.plans.evaluations import content_model
    f = Frames(spark, d)
    return M.rec_content(content_model(f), f.clean.select("customer_id").distinct(), K)


@register("rec_content_fresh")
def q_rec_content_fresh(spark, d):
    from tastebud.plans.evaluations import content_model
    f = Frames(spark, d)
    return M.rec_content_fresh(content_model(f, "train", "catalog"), _users(f), K)


@register("rec_session")
def q_rec_session(spark, d):
    """Sessions = each test-week user's items in time order, scored as anonymous sessions."""
    from tastebud.plans.evaluations import content_model
    f = Frames(spark, d)
    sess = (f.test.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("event_ts", "article_id"))).alias("s"))
            .select(F.col("customer_id").alias("request_id"), F.col("s.article_id").alias("session_article_ids")))
    return M.rec_session(content_model(f, "train", "catalog"), sess, K)


@register("evidence_item")
def q_evidence_item(spark, d):
    from tastebud.operators.serving import evidence_item
    from tastebud.plans.evaluations import cf_model, content_model
    f = Frames(spark, d)
    ct = content_model(f)
    recs = M.rec_cf(cf_model(f), _users(f), K)
    return evidence_item(recs, f.seen, M.item_vectors(ct))


@register("self_join_history", with_ctes("""
SELECT customer_id, article_id, evidence_id, round(sim, 6) AS sim FROM (
  SELECT r.customer_id, r.article_id, h.article_id AS evidence_id, d.sim,
         row_number() OVER (PARTITION BY r.customer_id, r.article_id ORDER BY round(d.sim, 12) DESC, h.article_id) AS n
  FROM recs r JOIN seen_b h USING (customer_id)
  JOIN (SELECT a.article_id, b.article_id AS other, sum(a.x * b.x) AS sim FROM gvec a JOIN gvec b USING (pos) GROUP BY 1, 2) d
    ON d.article_id = r.article_id AND d.other = h.article_id) WHERE n = 1""",
                                         "truth_val_b", "pop_b", "seen_b", "train_b", extra=GIVEN.split(",\ngtaste")[0] + ",\n"
                                         + "tusers AS (SELECT DISTINCT customer_id FROM truth_val_b),\nrecs AS ("
                                         + REC_POP_SQL.format(users="tusers", pop="pop_b", seen="seen_b", k=K) + ")"))
def q_self_join_history(spark, d):
    """History x popular recommendations per user (k bounded): the history item whose given vector is nearest."""
    from tastebud.operators.serving import evidence_item
    f = Frames(spark, d)
    recs = P.rec_popularity(f.pop, f.seen, _users(f), K)
    out = evidence_item(recs, f.seen, _given_vectors(f).select("article_id", "vec"))
    return out.select("customer_id", "article_id", "evidence_id", r6("sim").alias("sim"))


@register("route_requests")
def q_route_requests(spark, d):
    """Every customer of the order adapter as a request: known -> hybrid, unknown -> cascade."""
    from tastebud.operators.serving import route_requests
    from tastebud.plans.evaluations import cf_model, content_model
    f = Frames(spark, d, adapter="orders")
    cf, ct = cf_model(f), content_model(f)
    dev, segs, cats, pop = _cold_models(f)
    some = F.element_at(F.array(F.lit(5), F.lit(10), F.lit(20)), (F.pmod(F.crc32("customer_id"), F.lit(3)) + 1).cast("int"))
    reqs = f.customers.select(F.col("customer_id").alias("request_id"), F.col("customer_id").alias("user_id"),
                              some.alias("limit"), "age", "club_member_status",
                              F.lit(None).cast("string").alias("preferred_product_group"),
                              F.lit(True).alias("use_demographics"))

    def candidates(users, n):
        return M.rec_cf(cf, users, n), M.rec_content(ct, users, n)

    def cold(rq):
        return CS.rec_cold_start(rq.drop("user_id"), segs, cats, pop)

    return route_requests(reqs, cf.rows.select("customer_id"), candidates, cold, WEIGHT)


def stored_models(f: Frames, n_components: int = 64, seed: int = 42) -> str:
    """The folder of the models of the processed store, fitted, tuned and published as one version where there is none yet."""
    from tastebud.plans.evaluations import cf_model, content_model, tune_hybrid_weight
    from tastebud.sources import versions as V
    base = f"{f.store}-models-{n_components}-{seed}"  # the store's name is a digest of its input
    at = V.current(f.spark, base)
    if at is not None:
        return at
    version, cf, ct, users = V.new_version(base), cf_model(f), content_model(f), _users(f)
    out = V.folder(base, version)
    M.save_model(cf, f"{out}/collaborative")
    M.save_model(ct, f"{out}/content")
    tuned = tune_hybrid_weight(M.rec_cf(cf, users, CAND_K), M.rec_content(ct, users, CAND_K), f.truth("val"), WEIGHTS, K)
    best = tuned.where("is_best").first()["weight"]
    f.spark.createDataFrame([(float(best), n_components, seed)], "best_weight double, n_components int, seed int").write.parquet(f"{out}/config")
    return V.publish(f.spark, base, version, [*[f"collaborative/{t}" for t in (*M.CF_TABLES, "sigma")],
                                              *[f"content/{t}" for t in M.CONTENT_TABLES], "config"])


@register("model_tables")
def q_model_tables(spark, d):
    """Both fitted models and the tuned weight, stored once per input and found again by any session; ranks with what was read."""
    f = Frames(spark, d)
    out = stored_models(f)
    cf, ct = M.load_cf(spark, f"{out}/collaborative"), M.load_content(spark, f"{out}/content")
    weight = spark.read.parquet(f"{out}/config").first()["best_weight"]
    users = _users(f)
    return M.rec_hybrid(M.rec_cf(cf, users, CAND_K), M.rec_content(ct, users, CAND_K), weight, K) \
        .select("customer_id", "rank", "article_id", "score")


_STORED = """
SELECT 'interactions_train' AS "table", count(*) AS n_rows FROM train_b
UNION ALL SELECT 'interactions_val', count(*) FROM val_b
UNION ALL SELECT 'interactions_test', count(*) FROM test_b
UNION ALL SELECT 'interactions_clean', count(*) FROM clean_b
UNION ALL SELECT 'items_clean', count(*) FROM items
UNION ALL SELECT 'customers_clean', count(*) FROM customers
UNION ALL SELECT 'customer_map', count(DISTINCT customer_id) FROM train_b
UNION ALL SELECT 'item_map', count(DISTINCT article_id) FROM train_b
UNION ALL SELECT 'popularity', count(*) FROM pop_b
UNION ALL SELECT 'seen', count(*) FROM seen_b
UNION ALL SELECT 'preprocess_summary', 1"""
_STORED_DEPS = ("clean_b", "items", "customers", "train_b", "val_b", "test_b", "pop_b", "seen_b")


def _table_counts(spark, out):
    from tastebud.plans.preprocess import read_processed
    from tastebud.sources.sinks import PROCESSED_TABLES, SPLIT_TABLES
    return reduce(lambda a, b: a.unionByName(b), [
        read_processed(spark, out, n).agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n_rows"))
        for n in (*SPLIT_TABLES, *PROCESSED_TABLES)])


@register("sink_processed", with_ctes(_STORED, *_STORED_DEPS))
def q_sink_processed(spark, d):
    """The processed tables of the current version, with their row counts."""
    return _table_counts(spark, Frames(spark, d).store)


@register("preprocess_summary", with_ctes("""
SELECT (SELECT count(*) FROM raw_b) AS interactions_raw_rows, (SELECT count(*) FROM train_b) AS interactions_train_rows,
       (SELECT count(*) FROM val_b) AS interactions_val_rows, (SELECT count(*) FROM test_b) AS interactions_test_rows,
       (SELECT count(*) FROM clean_b) AS interactions_clean_rows,
       (SELECT count(*) FROM labelled_b WHERE split IS NOT NULL AND reject_reason = 'missing') AS interactions_dropped_missing,
       (SELECT count(*) FROM labelled_b WHERE split IS NOT NULL AND reject_reason = 'invalid_price') AS interactions_dropped_invalid_price,
       CAST(0 AS BIGINT) AS interactions_deduplicated,
       (SELECT count(*) FROM labelled_b WHERE split IS NOT NULL AND reject_reason = 'orphan') AS interactions_dropped_orphan_items,
       (SELECT count(*) FROM items_raw) AS items_raw_rows, (SELECT count(*) FROM items) AS items_clean_rows,
       (SELECT count(*) FROM items WHERE has_image) AS items_with_images,
       (SELECT count(*) FROM customers_raw) AS customers_raw_rows, (SELECT count(*) FROM customers) AS customers_clean_rows""",
                                         "raw_b", "clean_b", "train_b", "val_b", "test_b", "labelled_b", "items_raw", "items",
                                         "customers_raw", "customers"))
def q_preprocess_summary(spark, d):
    """The counters that the preprocess stage published with its tables."""
    return Frames(spark, d)._read("preprocess_summary")


@register("sink_skip_if_present", with_ctes(
    f"""SELECT "table", n_rows, true AS first_run, false AS second_run, true AS forced_run FROM ({_STORED})""", *_STORED_DEPS))
def q_sink_skip_if_present(spark, d):
    """A run into an empty folder writes every table, a second one is skipped, a forced one writes again."""
    from tastebud.plans.preprocess import run_preprocess
    from tastebud.session import checkpoint_dir
    f = Frames(spark, d)
    out = f"{checkpoint_dir(spark)}/processed-{uuid.uuid4().hex}"
    run = lambda force: run_preprocess(spark, f.raw_transactions, f.raw_items, f.raw_customers, out, force)
    first, second, forced = run(False), run(False), run(True)
    return _table_counts(spark, out).select(
        "*", F.lit(first).alias("first_run"), F.lit(second).alias("second_run"), F.lit(forced).alias("forced_run"))


@register("eval_baseline")
def q_eval_baseline(spark, d):
    from tastebud.plans.evaluations import eval_baseline
    return eval_baseline(Frames(spark, d), K)


@register("eval_hybrid")
def q_eval_hybrid(spark, d):
    from tastebud.plans.evaluations import eval_hybrid
    return eval_hybrid(Frames(spark, d), K)


@register("eval_final")
def q_eval_final(spark, d):
    from tastebud.plans.evaluations import eval_final
    return eval_final(Frames(spark, d), K)


@register("eval_policy")
def q_eval_policy(spark, d):
    from tastebud.plans.evaluations import eval_policy
    return eval_policy(Frames(spark, d), K)
