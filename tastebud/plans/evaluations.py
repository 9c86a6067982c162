"""End-to-end evaluations composed from the operators (the reference's stages).

Fitted models are cached per (application, version of the processed store, fit
set) so a report that needs the same SVD twice fits it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastebud.operators import coldstart as CS
from tastebud.operators import evaluate as E
from tastebud.operators import models as M
from tastebud.operators import policy as PO
from tastebud.operators import popularity as P
from tastebud.functions.index import dealt
from tastebud.functions.numeric import uniform
from tastebud.operators.sample import first_n_users, sample_users
from tastebud.plans.frames import Frames

_MODELS: dict[tuple, object] = {}


def cached(f: Frames, name: str, build):
    key = (f.spark.sparkContext.applicationId, f.store, name)
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


def cf_model(f: Frames, fit: str = "train") -> M.CFModel:
    data = f.train if fit == "train" else f.train.unionByName(f.val)
    return cached(f, f"cf:{fit}", lambda: M.fit_cf(data, 64, 42))


def content_model(f: Frames, fit: str = "train", candidates: str = "train") -> M.ContentModel:
    data = f.train if fit == "train" else f.train.unionByName(f.val)
    cands = data.select("article_id").distinct() if candidates == "train" else None
    return cached(f, f"content:{fit}:{candidates}", lambda: M.fit_content(data, f.items, cands, 64, 20_000, 42))


def tune_hybrid_weight(cf: DataFrame, ct: DataFrame, truth: DataFrame, weights, k: int) -> DataFrame:
    """Score the candidate blend once per weight (weights exploded, not re-ranked per call);
    best = lexicographic max of (ndcg, map, hit); the first weight wins ties."""
    if not weights or any(not 0.0 <= w <= 1.0 for w in weights):
        raise ValueError("weights must be non-empty and within [0, 1]")
    a = M.minmax(cf).select("customer_id", "article_id", F.col("norm").alias("a"))
    b = M.minmax(ct).select("customer_id", "article_id", F.col("norm").alias("b"))
    fo = a.join(b, ["customer_id", "article_id"], "full")
    ex = fo.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(float(w)).alias("weight"))
                                           for i, w in enumerate(weights)])).alias("w"))
    ex = ex.select("customer_id", "article_id", "w.pos", "w.weight",
                   (F.col("w.weight") * F.coalesce("a", F.lit(0.0)) + (1 - F.col("w.weight")) * F.coalesce("b", F.lit(0.0))).alias("score"))
    w = Window.partitionBy("pos", "customer_id").orderBy(F.desc(F.round("score", 12)), F.asc("article_id"))
    ranked = ex.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    keyed = ranked.select(F.concat_ws("|", F.col("pos").cast("string"), "customer_id").alias("customer_id"),
                          "rank", "article_id")
    tk = (truth.select("customer_id", "article_id")
          .select(F.explode(F.array(*[F.lit(str(i)) for i in range(len(weights))])).alias("pos"), "customer_id", "article_id")
          .select(F.concat_ws("|", "pos", "customer_id").alias("customer_id"), "article_id"))
    pu = E.per_user_metrics(keyed, tk, k).withColumn("pos", F.split("customer_id", r"\|")[0].cast("int"))
    m = pu.groupBy("pos").agg(*[F.avg(x).alias(x) for x in E.METRICS])
    wt = F.create_map(*[v for i, x in enumerate(weights) for v in (F.lit(i), F.lit(float(x)))])
    best = Window.orderBy(*[F.desc(F.round(x, 12)) for x in E.METRICS], F.asc("pos"))  # float noise is not a win
    return (m.withColumn("weight", wt[F.col("pos")]).withColumn("_b", F.row_number().over(best))  # <= len(weights) rows
            .select("weight", *E.METRICS, (F.col("_b") == 1).alias("is_best")))


def eval_cold_start(f: Frames, models, requests, k: int, samples: int = 1000, seed: int = 42) -> DataFrame:
    """Global popularity vs demographic fallback for users new in the test weeks, with bootstrap bounds."""
    dev, segs, cats, pop = models
    reqs, cold = requests
    recs = CS.rec_cold_start(reqs.drop("customer_id"), segs, cats, pop)
    recs = recs.select(F.split("request_id", ":")[0].alias("customer_id"),
                       F.when(F.col("request_id").endswith(":global"), F.lit("global_popularity"))
                       .otherwise(F.lit("demographic_fallback")).alias("model"), "rank", "article_id")
    recs = M._ckpt(recs)  # the cascade is planned and run once for both models
    size = pop.select(F.count(F.lit(1))).scalar()  # the catalog that can be recommended
    out = None
    for model in ("global_popularity", "demographic_fallback"):
        r = recs.where(F.col("model") == model)
        covered = E.catalog_coverage(r, size, k).scalar()
        ev = E.evaluate_rankings(r, cold, k).select(F.lit(model).alias("model"), "*",
                                                    covered.alias("catalog_coverage_at_k"))
        out = ev if out is None else out.unionByName(ev)
    per_user = [E.per_user_metrics(recs.where(F.col("model") == m), cold, k).withColumn("model", F.lit(m))
                for m in ("global_popularity", "demographic_fallback")]
    means = E.resampled_means(per_user[0].unionByName(per_user[1]), ["model"], samples, seed)
    bounds = means.groupBy("model").agg(*[x for m in E.METRICS for x in (
        F.percentile(m, 0.025).alias(f"{m}_ci95_lower"), F.percentile(m, 0.975).alias(f"{m}_ci95_upper"))])
    return out.join(bounds, "model", "left")


# Cases of the cold-start report (fixed values): an age of each band.
BAND_AGES = {"16-24": 20, "25-34": 30, "35-49": 40, "50+": 55}


def cold_start_examples(models, content, k: int) -> DataFrame:
    """What the cascade answers in four situations: demographics, category, session, no context.

    The first segment with an age, the first category and the first content item
    (each in order) stand for the requests, which all run through the cascade.
    """
    dev, segs, cats, pop = models
    band = segs.where(F.col("age_band").isin(*BAND_AGES)).agg(F.min(F.struct("age_band", "club_member_status"))).scalar()
    age = F.create_map(*[x for b, a in BAND_AGES.items() for x in (F.lit(b), F.lit(a))])[band["age_band"]]
    category = cats.agg(F.min("product_group_name")).scalar()
    none = F.lit(None).cast("string")
    case = F.col("request_id")
    reqs = dev.sparkSession.createDataFrame([(c,) for c in ("demographics", "category", "session", "no_context")], "request_id string").select(
        "request_id", F.lit(k).alias("limit"), F.when(case == "demographics", age).alias("age"),
        F.when(case == "demographics", band["club_member_status"]).alias("club_member_status"),
        F.when(case == "category", category).otherwise(none).alias("preferred_product_group"), (case == "demographics").alias("use_demographics"))
    first = content.cat_map.agg(F.min("article_id").alias("a"))
    sessions = first.select(F.lit("session").alias("request_id"), F.array("a").alias("session_article_ids"))
    return CS.rec_cold_start(reqs, segs, cats, pop, M.rec_session(content, sessions, k))


def _metrics_row(name: str, recs: DataFrame, truth: DataFrame, k: int, users: DataFrame) -> DataFrame:
    return E.evaluate_rankings(recs, truth, k, rec_users=users).select(F.lit(name).alias("model"), "*")


def eval_baseline(f: Frames, k: int = 12, max_eval_users: int = 0) -> DataFrame:
    """Popularity and CF on validation: all warm users, or the first N in id order."""
    cf = cf_model(f)
    truth = P.ground_truth(f.val, cf.rows.select("customer_id"), cf.item_map.select("article_id"), cf.seen)
    users = first_n_users(truth, max_eval_users)
    t = truth.join(users, "customer_id", "left_semi")
    pop = P.rec_popularity(cf.pop, cf.seen, users, k)
    return _metrics_row("popularity", pop, t, k, users).unionByName(
        _metrics_row("collaborative_svd", M.rec_cf(cf, users, k), t, k, users))


def _hybrid_parts(f: Frames, users: DataFrame, k: int, fit: str, candidates: str):
    cf = cf_model(f, fit)
    ct = content_model(f, fit, candidates)
    ck = k * 10
    # candidate lists feed tuning, blending and metrics: materialise each once
    return cf, ct, M._ckpt(M.rec_cf(cf, users, ck)), M._ckpt(M.rec_content(ct, users, ck))


def eval_hybrid(f: Frames, k: int = 12, max_eval_users: int = 0, weights=(0.25, 0.5, 0.75)) -> DataFrame:
    """Three single models plus the validation-tuned hybrid, on validation users."""
    cf = cf_model(f)
    truth = P.ground_truth(f.val, cf.rows.select("customer_id"), cf.item_map.select("article_id"), cf.seen)
    users = sample_users(truth, max_eval_users, 42)
    t = truth.join(users, "customer_id", "left_semi")
    cf, ct, cfc, ctc = _hybrid_parts(f, users, k, "train", "train")
    tuning = tune_hybrid_weight(cfc, ctc, t, weights, k)
    best = tuning.where("is_best").select("weight").first()[0]
    hy = M.rec_hybrid(cfc, ctc, best, k)
    pop = P.rec_popularity(cf.pop, cf.seen, users, k)
    out = _metrics_row("popularity", pop, t, k, users)
    for name, recs in (("collaborative_svd", M.rec_cf(cf, users, k, cfc)), ("content_tfidf", M.rec_content(ct, users, k, ctc)),
                       (f"hybrid_cf_{best:.2f}", hy)):
        out = out.unionByName(_metrics_row(name, recs, t, k, users))
    return out


def eval_final(f: Frames, k: int = 12, max_eval_users: int = 0, weight: float = 0.75,
               min_fresh: int = 1, samples: int = 1000) -> DataFrame:
    """Refit on train + validation, frozen weight, test once: metrics, coverage, CI, fresh metrics (long)."""
    cf = cf_model(f, "dev")
    truth = P.ground_truth(f.test, cf.rows.select("customer_id"), cf.item_map.select("article_id"), cf.seen)
    users = sample_users(truth, max_eval_users, 42)
    t = truth.join(users, "customer_id", "left_semi")
    cf, ct, cfc, ctc = _hybrid_parts(f, users, k, "dev", "catalog")
    hy = M.rec_hybrid(cfc, ctc, weight, k).select("customer_id", "rank", "article_id", "score")
    fresh_c = M.rec_content_fresh(ct, users, k * 10)
    hy = M.fresh_quota(hy, fresh_c, ct.fresh_items, min_fresh, k)
    catalog_size = f.items.select(F.count_distinct("article_id")).scalar()
    models = {"popularity": P.rec_popularity(cf.pop, cf.seen, users, k), "collaborative_svd": M.rec_cf(cf, users, k, cfc),
              "content_tfidf": M.rec_content(ct, users, k, ctc), "hybrid_frozen": hy}
    long = None
    for name, recs in models.items():
        part = recs.select(F.lit(name).alias("model"), "customer_id", "rank", "article_id")
        long = part if long is None else long.unionByName(part)
    return grouped_report(M._ckpt(long), t, users, ct.fresh_items, catalog_size, k, samples)


def grouped_report(recs: DataFrame, truth: DataFrame, users: DataFrame, fresh: DataFrame, catalog_size,
                   k: int, samples: int = 1000, seed: int = 42) -> DataFrame:
    """Metrics, coverage, fresh metrics and bootstrap CIs for every model in one pass each.

    ``recs`` carries a ``model`` column; users are keyed as model|customer so
    the single-model operators run once over all models.
    """
    names = [r[0] for r in recs.select("model").distinct().collect()]  # a handful of model names
    tag = F.explode(F.array(*[F.lit(n) for n in names])).alias("model")
    key = lambda: F.concat_ws("|", "model", "customer_id").alias("customer_id")
    krecs = recs.select(key(), "rank", "article_id")
    ktruth = truth.select(tag, "customer_id", "article_id").select(key(), "article_id")
    kusers = users.select(tag, "customer_id").select(key())
    split_model = F.split("customer_id", r"\|")
    pu = E.per_user_metrics(krecs, ktruth, k, kusers).select(
        split_model[0].alias("model"), split_model[1].alias("customer_id"), *E.METRICS)
    pu = M._ckpt(pu)
    ev = pu.groupBy("model").agg(F.count(F.lit(1)).cast("double").alias("users_evaluated"),
                                 *[F.avg(m).alias(m) for m in E.METRICS])
    top = E.dedupe_topk(krecs, k).select(split_model[0].alias("model"), split_model[1].alias("customer_id"), "article_id")
    fr = dealt(fresh.select("article_id").distinct().withColumn("_f", F.lit(1)), "shuffle_hash")
    n_fresh = fr.select(F.count(F.lit(1))).scalar()
    tagged = top.join(fr, "article_id", "left")
    cov = tagged.groupBy("model").agg(
        (F.count_distinct("article_id") / (catalog_size if not isinstance(catalog_size, (int, float)) else F.lit(float(catalog_size)))).alias("catalog_coverage_at_k"),
        (F.count_distinct(F.when(F.col("_f") == 1, F.col("article_id"))) / F.greatest(n_fresh, F.lit(1))).alias("fresh_coverage_at_k"))
    per = tagged.groupBy("model", "customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_f", F.lit(0))).alias("nf"))
    all_users = users.select(tag, "customer_id")
    per = all_users.join(per, ["model", "customer_id"], "left")
    fm = per.groupBy("model").agg(
        F.avg(F.when(F.coalesce("n", F.lit(0)) > 0, F.col("nf") / F.col("n")).otherwise(0.0)).alias("fresh_share_at_k"),
        F.avg(F.when(F.coalesce("nf", F.lit(0)) > 0, 1.0).otherwise(0.0)).alias("users_with_fresh_hit_at_k"))
    wide = ev.join(cov, "model", "left").join(fm, "model", "left")
    cols = [c for c in wide.columns if c != "model"]
    long = wide.select("model", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["model"], cols, "metric", "value")
    ci = grouped_bootstrap(pu, samples, 0.95, seed)
    return long.unionByName(ci)


def grouped_bootstrap(pu: DataFrame, samples: int, confidence: float, seed: int) -> DataFrame:
    """Bootstrap CIs for all models at once: the same resampled users for every model."""
    means = E.resampled_means(pu, ["model"], samples, seed)
    tail = (1.0 - confidence) / 2.0
    q = means.groupBy("model").agg(*[F.percentile(m, F.array(F.lit(tail), F.lit(1.0 - tail))).alias(m) for m in E.METRICS])
    return q.select("model", F.explode(F.array(*[x for m in E.METRICS for x in (
        F.struct(F.lit(f"{m}_ci95_lower").alias("metric"), F.col(m)[0].alias("value")),
        F.struct(F.lit(f"{m}_ci95_upper").alias("metric"), F.col(m)[1].alias("value")))])).alias("x")) \
        .select("model", "x.metric", "x.value")


def eval_policy(f: Frames, k: int = 12, max_eval_users: int = 0, baseline: str = "popularity",
                weights=(0.25, 0.5, 0.75)) -> DataFrame:
    """Tune on validation, compare baseline vs hybrid on test in expected clicks, with lifts."""
    if baseline not in ("popularity", "random"):
        raise ValueError("baseline_policy must be either 'popularity' or 'random'")
    cf = cf_model(f)
    vt = P.ground_truth(f.val, cf.rows.select("customer_id"), cf.item_map.select("article_id"), cf.seen)
    vu = sample_users(vt, max_eval_users, 42)
    _, ct, cfc, ctc = _hybrid_parts(f, vu, k, "train", "train")
    best = tune_hybrid_weight(cfc, ctc, vt.join(vu, "customer_id", "left_semi"), weights, k) \
        .where("is_best").select("weight").first()[0]
    tt = P.ground_truth(f.test, cf.rows.select("customer_id"), cf.item_map.select("article_id"), cf.seen)
    tu = sample_users(tt, max_eval_users, 42)
    t = tt.join(tu, "customer_id", "left_semi")
    base = (P.rec_popularity(cf.pop, cf.seen, tu, k) if baseline == "popularity"
            else PO.random_policy(cf.item_map.select("article_id"), cf.seen, tu, k, 42))
    hy = M.rec_hybrid(M.rec_cf(cf, tu, k * 10), M.rec_content(ct, tu, k * 10), best, k)
    b, h = PO.expected_clicks(base, t), PO.expected_clicks(hy, t)
    lifts = PO.policy_lift(b, h).select(F.lit("lift").alias("policy"), "metric", F.col("lift").alias("value"))
    out = lifts
    for name, df in (("baseline", b), ("personalized_hybrid", h)):
        cols = df.columns
        out = out.unionByName(df.select(*[F.col(c).cast("double").alias(c) for c in cols])
                              .unpivot([], cols, "metric", "value").select(F.lit(name).alias("policy"), "metric", "value"))
    return out
