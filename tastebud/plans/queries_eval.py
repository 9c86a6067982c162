"""Metrics, coverage, bootstrap intervals, expected clicks and lift (SQL-checked)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastebud.functions.numeric import r6
from tastebud.operators import evaluate as E
from tastebud.operators import policy as PO
from tastebud.operators import popularity as P
from tastebud.operators.stats import metrics_long
from tastebud.plans.frames import K, Frames
from tastebud.plans.oracle import with_ctes
from tastebud.plans.queries_rank import REC_POP_SQL
from tastebud.plans.registry import register

# popularity recommendations for the validation truth users, adapter B
_RECS = {
    "tusers": "SELECT DISTINCT customer_id FROM truth_val_b",
    "recs": REC_POP_SQL.format(users="tusers", pop="pop_b", seen="seen_b", k=K),
    "top": """SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY r) AS rank
              FROM (SELECT customer_id, article_id, min(rank) AS r FROM recs GROUP BY 1, 2)""",
    "sizes": "SELECT customer_id, count(*) AS n_truth FROM truth_val_b GROUP BY 1",
    "evusers": "SELECT DISTINCT r.customer_id, s.n_truth FROM recs r JOIN sizes s USING (customer_id)",
    "hits": """SELECT t.customer_id, t.rank, row_number() OVER (PARTITION BY t.customer_id ORDER BY t.rank) AS hs
               FROM top t JOIN truth_val_b v ON t.customer_id = v.customer_id AND t.article_id = v.article_id
               WHERE t.rank <= 12""",
    "hagg": """SELECT customer_id, sum(1.0 / log2(rank + 1)) AS dcg, sum(hs / rank) AS prec, count(*) AS nh
               FROM hits GROUP BY 1""",
    "per_user": """SELECT u.customer_id,
          coalesce(h.dcg, 0) / list_sum(list_transform(range(1, least(u.n_truth, 12) + 1), lambda r: 1.0 / log2(r + 1))) AS ndcg_at_k,
          coalesce(h.prec, 0) / least(u.n_truth, 12) AS map_at_k,
          CAST(CASE WHEN coalesce(h.nh, 0) > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS hit_rate_at_k
        FROM evusers u LEFT JOIN hagg h USING (customer_id)""",
}
_RECS_EXTRA = ",\n".join(f"{k} AS ({v})" for k, v in _RECS.items())
_RECS_DEPS = ("truth_val_b", "pop_b", "seen_b")


def _pop_recs(f: Frames):
    users = f.truth("val").select("customer_id").distinct()
    return P.rec_popularity(f.pop, f.seen, users, K)


@register("per_user_metrics", with_ctes("""
SELECT customer_id, round(ndcg_at_k, 6) AS ndcg_at_k, round(map_at_k, 6) AS map_at_k, round(hit_rate_at_k, 6) AS hit_rate_at_k
FROM per_user""", *_RECS_DEPS, extra=_RECS_EXTRA))
def q_per_user_metrics(spark, d):
    f = Frames(spark, d)
    pu = E.per_user_metrics(_pop_recs(f), f.truth("val"), K)
    return pu.select("customer_id", *[r6(m).alias(m) for m in E.METRICS])


@register("evaluate_rankings", with_ctes("""
SELECT CAST(12 AS BIGINT) AS k, count(*) AS users_evaluated, round(coalesce(avg(ndcg_at_k), 0), 6) AS ndcg_at_k,
       round(coalesce(avg(map_at_k), 0), 6) AS map_at_k, round(coalesce(avg(hit_rate_at_k), 0), 6) AS hit_rate_at_k
FROM per_user""", *_RECS_DEPS, extra=_RECS_EXTRA))
def q_evaluate_rankings(spark, d):
    f = Frames(spark, d)
    ev = E.evaluate_rankings(_pop_recs(f), f.truth("val"), K)
    return ev.select("k", "users_evaluated", *[r6(m).alias(m) for m in E.METRICS])


for _m in E.METRICS:
    _name = {"ndcg_at_k": "ndcg", "map_at_k": "map_ap", "hit_rate_at_k": "hit_rate"}[_m]

    def _mk(metric):
        def fn(spark, d):
            f = Frames(spark, d)
            ev = E.evaluate_rankings(_pop_recs(f), f.truth("val"), K)
            return ev.select(r6(metric).alias(metric))
        return fn

    register(_name, with_ctes(f"SELECT round(coalesce(avg({_m}), 0), 6) AS {_m} FROM per_user",
                              *_RECS_DEPS, extra=_RECS_EXTRA))(_mk(_m))


@register("eval_inner", with_ctes("SELECT customer_id FROM evusers", *_RECS_DEPS, extra=_RECS_EXTRA))
def q_eval_inner(spark, d):
    f = Frames(spark, d)
    recs = _pop_recs(f)
    return recs.select("customer_id").distinct().join(f.truth("val").select("customer_id").distinct(), "customer_id")


@register("dedupe_topk", with_ctes("""
SELECT customer_id, rank, article_id FROM (
  SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY r) AS rank
  FROM (SELECT customer_id, article_id, min(rank) AS r FROM (
          SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY event_ts, article_id) AS rank
          FROM train_b) GROUP BY 1, 2))
WHERE rank <= 12""", "train_b"))
def q_dedupe_topk(spark, d):
    from pyspark.sql import Window
    f = Frames(spark, d)
    hist = f.train.withColumn("rank", F.row_number().over(
        Window.partitionBy("customer_id").orderBy("event_ts", "article_id")))
    return E.dedupe_topk(hist, K)


@register("catalog_coverage", with_ctes("""
SELECT round(count(DISTINCT article_id) / (SELECT count(DISTINCT article_id) FROM items), 6) AS catalog_coverage_at_k
FROM top WHERE rank <= 12""", "items", *_RECS_DEPS, extra=_RECS_EXTRA))
def q_catalog_coverage(spark, d):
    f = Frames(spark, d)
    size = f.items.select(F.count_distinct("article_id")).scalar()
    cov = E.catalog_coverage(_pop_recs(f), size, K)
    return cov.select(r6("catalog_coverage_at_k").alias("catalog_coverage_at_k"))


def random_policy_sql(users: str, items: str, seen: str, k: int, seed: int = 42, p: str = "") -> tuple[str, str]:
    """(extra CTEs, body) of the random policy: per-user affine order over dense item indices.

    ``p`` prefixes the CTE names so two policies can share one query.
    """
    h = "CAST(('0x' || substr(md5('" + str(seed) + "|' || u.customer_id || '|{t}'), 1, 8)) AS BIGINT)"
    extra = f"""
{p}ix AS (SELECT article_id, row_number() OVER (ORDER BY article_id) - 1 AS x FROM (SELECT DISTINCT article_id FROM {items})),
{p}nn AS (SELECT count(*) AS n FROM {p}ix),
{p}cand AS (SELECT c FROM range(2, (SELECT 2 * n + 3 FROM {p}nn)) t(c) WHERE c >= (SELECT n FROM {p}nn)),
{p}pp AS (SELECT min(c) AS p FROM {p}cand cc WHERE NOT EXISTS (SELECT 1 FROM range(2, 100000) dd(d) WHERE d * d <= cc.c AND cc.c % d = 0)),
{p}rp AS (SELECT customer_id, rank, article_id, score FROM (
  SELECT u.customer_id, i.article_id, CAST(1.0 AS DOUBLE) AS score,
         row_number() OVER (PARTITION BY u.customer_id ORDER BY ((1 + {h.format(t='a')} % (pp.p - 1)) * i.x + {h.format(t='b')} % pp.p) % pp.p) AS rank
  FROM (SELECT DISTINCT customer_id FROM {users}) u CROSS JOIN {p}ix i CROSS JOIN {p}pp pp
  WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.customer_id = u.customer_id AND s.article_id = i.article_id))
  WHERE rank <= {k})"""
    return extra, f"SELECT customer_id, rank, article_id, score FROM {p}rp"


_RP_CAT = random_policy_sql("truth_val_b", "items", "seen_b", K)


@register("fresh_metrics", with_ctes("""
SELECT round(CASE WHEN (SELECT count(*) FROM fr) > 0 THEN
          (SELECT count(DISTINCT r.article_id) FROM rp r JOIN fr USING (article_id)) / (SELECT count(*) FROM fr) ELSE 0 END, 6) AS fresh_coverage_at_k,
       round(avg(CASE WHEN n > 0 THEN nf / n ELSE 0.0 END), 6) AS fresh_share_at_k,
       round(avg(CASE WHEN nf > 0 THEN 1.0 ELSE 0.0 END), 6) AS users_with_fresh_hit_at_k
FROM pu""", "items", "train_b", "truth_val_b", "seen_b", extra=_RP_CAT[0] + """,
fr AS (SELECT DISTINCT article_id FROM items WHERE article_id NOT IN (SELECT article_id FROM train_b)),
pu AS (SELECT u.customer_id, count(r.article_id) AS n, count(f.article_id) AS nf
       FROM (SELECT DISTINCT customer_id FROM truth_val_b) u LEFT JOIN rp r USING (customer_id)
       LEFT JOIN fr f ON r.article_id = f.article_id GROUP BY u.customer_id)"""))
def q_fresh_metrics(spark, d):
    f = Frames(spark, d)
    users = f.truth("val").select("customer_id").distinct()
    recs = PO.random_policy(f.items, f.seen, users, K, seed=42)
    m = E.fresh_metrics(recs, f.fresh_items, K, rec_users=users)
    return m.select(*[r6(c).alias(c) for c in m.columns])


def bootstrap_sql(source: str, key: str | None, seed: int, samples: int) -> str:
    """CTE ``means``: weighted metric means per sample (and ``key``) of ``source``'s users, by the same counters."""
    keys = f"{key}, b" if key else "b"
    cases = " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(E.POISSON))
    return f"""
counters AS (SELECT *, ((('0x' || substr(md5(customer_id), 1, 8))::UBIGINT * {E.USER_STEP}) % 4294967296
    + (b::UBIGINT * {E.SAMPLE_STEP}) % 4294967296 + {seed * E.SEED_STEP % 2**32}) % 4294967296 AS x0
  FROM {source}, (SELECT range AS b FROM range(0, {samples}))),
mixed_1 AS (SELECT *, (xor(x0, x0 >> 16) * {E.MIX_1}) % 4294967296 AS x1 FROM counters),
mixed_2 AS (SELECT *, (xor(x1, x1 >> 15) * {E.MIX_2}) % 4294967296 AS x2 FROM mixed_1),
draws AS (SELECT *, xor(x2, x2 >> 16) / 4294967296.0 AS u FROM mixed_2),
weighted AS (SELECT *, CASE {cases} ELSE {len(E.POISSON)} END AS w FROM draws),
means AS (SELECT {keys}, sum(ndcg_at_k * w) / sum(w) AS ndcg_at_k, sum(map_at_k * w) / sum(w) AS map_at_k,
                 sum(hit_rate_at_k * w) / sum(w) AS hit_rate_at_k FROM weighted WHERE w > 0 GROUP BY {keys})"""


@register("bootstrap_ci", with_ctes("""
SELECT metric, round(lower, 6) AS lower, round(upper, 6) AS upper FROM (
  SELECT 'ndcg_at_k' AS metric, quantile_cont(ndcg_at_k, 0.025) AS lower, quantile_cont(ndcg_at_k, 0.975) AS upper FROM means
  UNION ALL SELECT 'map_at_k', quantile_cont(map_at_k, 0.025), quantile_cont(map_at_k, 0.975) FROM means
  UNION ALL SELECT 'hit_rate_at_k', quantile_cont(hit_rate_at_k, 0.025), quantile_cont(hit_rate_at_k, 0.975) FROM means)""",
                                    *_RECS_DEPS, extra=_RECS_EXTRA + "," + bootstrap_sql("per_user", None, 42, 1000)))
def q_bootstrap_ci(spark, d):
    f = Frames(spark, d)
    pu = E.per_user_metrics(_pop_recs(f), f.truth("val"), K)
    ci = E.bootstrap_ci(pu, samples=1000, confidence=0.95, seed=42)
    return ci.select("metric", r6("lower").alias("lower"), r6("upper").alias("upper"))


def click_sql(recs: str, rnd: bool = True) -> str:
    def R(x: str) -> str:
        return f"round({x}, 6)" if rnd else x
    return f"""
SELECT CAST(sum(impressions) AS BIGINT) AS impressions, {R('sum(clicks)')} AS expected_clicks,
       {R('sum(rclicks)')} AS expected_relevant_clicks, count(*) AS sessions,
       {R('sum(clicks) / greatest(sum(impressions), 1)')} AS click_through_rate,
       {R('sum(rclicks) / greatest(sum(impressions), 1)')} AS relevant_click_through_rate,
       {R('sum(clicks) / greatest(count(*), 1)')} AS avg_clicks_per_session,
       {R('sum(pc) / greatest(count(*), 1)')} AS sessions_with_click_rate,
       {R('sum(prc) / greatest(count(*), 1)')} AS sessions_with_relevant_click_rate
FROM (SELECT customer_id, count(*) AS impressions, sum(p) AS clicks, sum(CASE WHEN rel THEN p ELSE 0 END) AS rclicks,
             1 - CASE WHEN max(p) >= 1 THEN 0 ELSE exp(sum(ln(1 - p))) END AS pc,
             1 - CASE WHEN max(CASE WHEN rel THEN p ELSE 0 END) >= 1 THEN 0
                      ELSE exp(sum(ln(1 - CASE WHEN rel THEN p ELSE 0 END))) END AS prc
      FROM (SELECT r.customer_id, v.article_id IS NOT NULL AS rel,
                   least(greatest(CASE WHEN v.article_id IS NOT NULL THEN 0.35 ELSE 0.01 END / log2(r.rank + 1), 0), 1) AS p
            FROM {recs} r LEFT JOIN truth_val_b v ON r.customer_id = v.customer_id AND r.article_id = v.article_id
            WHERE r.customer_id IN (SELECT customer_id FROM truth_val_b))
      GROUP BY customer_id)"""


@register("policy_expected_clicks", with_ctes(click_sql("recs"), *_RECS_DEPS, extra=_RECS_EXTRA))
def q_policy_expected_clicks(spark, d):
    f = Frames(spark, d)
    out = PO.expected_clicks(_pop_recs(f), f.truth("val"))
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_RP_TRAIN = random_policy_sql("truth_val_b", "train_b", "seen_b", K)


@register("policy_lift", with_ctes("""
SELECT metric, round(CASE WHEN base_v = 0 THEN (CASE WHEN new_v > 0 THEN 'inf'::DOUBLE ELSE 0.0 END)
                          ELSE (new_v - base_v) / base_v END, 6) AS lift FROM (
  SELECT 'click_through_rate_lift' AS metric, rs.click_through_rate AS base_v, hs.click_through_rate AS new_v FROM rsim rs, hsim hs UNION ALL
  SELECT 'relevant_click_through_rate_lift', rs.relevant_click_through_rate, hs.relevant_click_through_rate FROM rsim rs, hsim hs UNION ALL
  SELECT 'sessions_with_relevant_click_rate_lift', rs.sessions_with_relevant_click_rate, hs.sessions_with_relevant_click_rate FROM rsim rs, hsim hs UNION ALL
  SELECT 'avg_clicks_per_session_lift', rs.avg_clicks_per_session, hs.avg_clicks_per_session FROM rsim rs, hsim hs)""",
                                   "train_b", *_RECS_DEPS,
                                   extra=_RECS_EXTRA + "," + _RP_TRAIN[0] + ",\nrsim AS (" +
                                   click_sql("rp", False) + "),\nhsim AS (" +
                                   click_sql("recs", False) + ")"))
def q_policy_lift(spark, d):
    f = Frames(spark, d)
    users = f.truth("val").select("customer_id").distinct()
    base = PO.expected_clicks(PO.random_policy(f.train_items, f.seen, users, K), f.truth("val"))
    pers = PO.expected_clicks(_pop_recs(f), f.truth("val"))
    out = PO.policy_lift(base, pers)
    return out.select("metric", r6("lift").alias("lift"))


@register("metrics_long", with_ctes("""
SELECT 'popularity.' || metric AS name, round(value, 6) AS value FROM (
  UNPIVOT (SELECT coalesce(avg(ndcg_at_k), 0) AS ndcg_at_k, coalesce(avg(map_at_k), 0) AS map_at_k,
                  coalesce(avg(hit_rate_at_k), 0) AS hit_rate_at_k FROM per_user)
  ON ndcg_at_k, map_at_k, hit_rate_at_k INTO NAME metric VALUE value)""", *_RECS_DEPS, extra=_RECS_EXTRA))
def q_metrics_long(spark, d):
    f = Frames(spark, d)
    ev = E.evaluate_rankings(_pop_recs(f), f.truth("val"), K).select(F.lit("popularity").alias("model"), "*")
    out = metrics_long(ev)
    return out.select("name", r6("value").alias("value"))


_RP_TEST = random_policy_sql("truth_test_b", "train_b", "seen_b", K)


@register("random_policy", with_ctes(_RP_TEST[1], "truth_test_b", "train_b", "seen_b", extra=_RP_TEST[0]))
def q_random_policy(spark, d):
    f = Frames(spark, d)
    return PO.random_policy(f.train_items, f.seen, f.truth("test").select("customer_id").distinct(), K, seed=42)
