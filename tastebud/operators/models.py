"""Fitted recommenders as Spark plans over factor tables.

* ``CFModel``: SVD of the log-confidence user x item matrix; score = (A V) Vᵀ.
* ``ContentModel``: SVD of catalog TF-IDF, L2-normalised item factors, user
  profiles = normalised confidence-weighted centroids.
* hybrid blend, per-user min-max, fresh-item quota and per-item components
  are DataFrame operators over candidate tables ``(customer_id, rank, article_id, score)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastebud.functions.index import dealt, dense_index
from tastebud.operators import factors as FX
from tastebud.operators import popularity as P
from tastebud.operators.confidence import confidence
from tastebud.operators.tfidf import catalog_prepare, tfidf


def _ckpt(df: DataFrame) -> DataFrame:
    """Materialise a table reused by several passes; lineage is cut in the shared checkpoint folder."""
    from tastebud.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)  # the configured shared folder (a scratch one only in local mode)
    return df.checkpoint(eager=True)


@dataclass
class CFModel:
    item_map: DataFrame      # (article_id, item_idx) over sorted training items
    rows: DataFrame          # (customer_id, cols, vals) log-confidence rows
    factors: DataFrame       # (item_idx, vec) right singular vectors
    sigma: list[float]
    pop: DataFrame
    seen: DataFrame


def fit_cf(train: DataFrame, n_components: int = 64, seed: int = 42,
           half_life_days: float | None = None) -> CFModel:
    frame = train.select(*[c for c in ("customer_id", "article_id", "event_ts") if c in train.columns]).dropna(
        subset=["customer_id", "article_id"])
    conf = confidence(frame, half_life_days)
    item_map = _ckpt(dense_index(conf.select("article_id").distinct(), [F.col("article_id")], "item_idx"))
    n_items = item_map.count()
    rows = FX.csr_rows(conf.join(dealt(item_map, rows=n_items), "article_id"), "customer_id", "item_idx", "weight")
    rows = _ckpt(rows.withColumnRenamed("row", "customer_id"))
    V, s = FX.truncated_svd(rows.withColumnRenamed("customer_id", "row"), n_items, n_components, seed)
    return CFModel(item_map, rows, V.withColumnRenamed("col", "item_idx"), s.tolist(), P.popularity(frame),
                   P.seen_pairs(frame))


def _with_ids(scored: DataFrame, item_map: DataFrame, idx: str = "item_idx") -> DataFrame:
    return scored.join(dealt(item_map), scored.item_idx == item_map[idx]).select(
        "customer_id", "rank", "article_id", "score")


def rec_cf(model: CFModel, users: DataFrame, k: int, ranked: DataFrame | None = None) -> DataFrame:
    """Top-k unseen by factor score; unknown users fall back to popularity.

    ``ranked`` are lists of at least k that this function gave for the same model
    and users: their first k are the answer, and no search is run again.
    """
    if ranked is not None:
        return ranked.where(F.col("rank") <= k)
    u = users.select("customer_id").distinct()
    known = model.rows.join(u, "customer_id", "left_semi")
    scored = FX.top_k_scores(known, model.factors, k, mode="raw")
    unknown = u.join(model.rows.select("customer_id"), "customer_id", "left_anti")
    fallback = P.rec_popularity(model.pop, model.seen, unknown, k)
    return _with_ids(scored, model.item_map).unionByName(fallback)


@dataclass
class ContentModel:
    cat_map: DataFrame       # (article_id, item_idx) over the prepared catalog
    item_factors: DataFrame  # (item_idx, vec) of the whole catalog, L2-normalised
    rows: DataFrame          # (customer_id, cols, vals) confidence over catalog items
    fresh_items: DataFrame   # (article_id) catalog items without training rows
    pop: DataFrame
    seen: DataFrame


def fit_content(train: DataFrame, items: DataFrame, candidates: DataFrame | None = None, n_components: int = 64,
                max_features: int = 20_000, seed: int = 42, half_life_days: float | None = None) -> ContentModel:
    cat = catalog_prepare(items, candidates)
    cat_map = _ckpt(dense_index(cat.select("article_id"), [F.col("article_id")], "item_idx"))
    n_cat = cat_map.count()
    if n_cat < 2:
        raise ValueError("At least two catalog items are required")
    w = tfidf(cat, max_features, sublinear=True, unique=True)
    terms = dense_index(w.select("term").distinct(), [F.col("term")], "term_idx")
    n_terms = terms.count()
    docs = FX.csr_rows(w.join(terms, "term").join(dealt(cat_map, rows=n_cat), "article_id"), "item_idx", "term_idx", "weight")
    docs = _ckpt(docs)
    V, s = FX.truncated_svd(docs, n_terms, n_components, seed, n_rows=n_cat)
    # an item without a term keeps the zero vector
    projected = dealt(FX.project_rows(docs, V, normalize=True).withColumnRenamed("row", "item_idx"), rows=n_cat)
    item_f = FX.stored(cat_map.select("item_idx").join(projected, "item_idx", "left").select(
        "item_idx", F.coalesce("vec", F.array_repeat(F.lit(0.0), len(s))).alias("vec")), "items")
    frame = train.select(*[c for c in ("customer_id", "article_id", "event_ts") if c in train.columns]).dropna(
        subset=["customer_id", "article_id"]).join(dealt(cat_map.select("article_id"), rows=n_cat), "article_id", "left_semi")
    conf = confidence(frame, half_life_days)
    rows = FX.csr_rows(conf.join(dealt(cat_map, rows=n_cat), "article_id"), "customer_id", "item_idx", "weight")
    rows = _ckpt(rows.withColumnRenamed("row", "customer_id"))
    trained = dealt(frame.select("article_id").distinct(), "shuffle_hash", n_cat)
    fresh_items = cat_map.select("article_id").join(trained, "article_id", "left_anti")
    return ContentModel(cat_map, item_f, rows, fresh_items, P.popularity(frame), P.seen_pairs(frame))


def rec_content(model: ContentModel, users: DataFrame, k: int, ranked: DataFrame | None = None) -> DataFrame:
    """Top-k unseen by content; unknown users fall back to popularity; ``ranked`` as in ``rec_cf``."""
    if ranked is not None:
        return ranked.where(F.col("rank") <= k)
    u = users.select("customer_id").distinct()
    known = model.rows.join(u, "customer_id", "left_semi")
    scored = FX.top_k_scores(known, model.item_factors, k, mode="profile")
    unknown = u.join(model.rows.select("customer_id"), "customer_id", "left_anti")
    return _with_ids(scored, model.cat_map).unionByName(P.rec_popularity(model.pop, model.seen, unknown, k))


def rec_content_fresh(model: ContentModel, users: DataFrame, k: int) -> DataFrame:
    """Top-k among fresh catalog items only; unknown users (or no fresh items) -> none."""
    known = model.rows.join(users.select("customer_id").distinct(), "customer_id", "left_semi")
    fresh = model.cat_map.join(dealt(model.fresh_items), "article_id", "left_semi").select("item_idx")
    return _with_ids(FX.top_k_scores(known, model.item_factors, k, mode="profile", allowed=fresh), model.cat_map)


def rec_session(model: ContentModel, sessions: DataFrame, k: int) -> DataFrame:
    """Anonymous sessions ``(request_id, session_article_ids)``: normalised mean of the
    session item factors (duplicates count, unknown ids skipped), session items excluded."""
    ex = sessions.select(F.col("request_id").cast("string").alias("customer_id"),
                         F.posexplode("session_article_ids").alias("pos", "article_id"))
    j = ex.join(dealt(model.cat_map), "article_id")
    rows = j.groupBy("customer_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col("item_idx").cast("int").alias("c")))).alias("e"))
    rows = rows.select("customer_id", F.col("e.c").alias("cols"),
                       F.transform(F.col("e.c"), lambda _: F.lit(1.0)).alias("vals"))
    scored = FX.top_k_scores(rows, model.item_factors, k, mode="profile")  # a mean normalises like a sum
    return _with_ids(scored, model.cat_map).withColumnRenamed("customer_id", "request_id")


def item_vectors(model: ContentModel) -> DataFrame:
    """(item_idx, article_id, vec) of the catalog."""
    return dealt(model.cat_map).join(model.item_factors, "item_idx")


# --- persistence ------------------------------------------------------------
CF_TABLES = ("item_map", "rows", "factors", "pop", "seen")
CONTENT_TABLES = ("cat_map", "item_factors", "rows", "fresh_items", "pop", "seen")


def save_model(model: CFModel | ContentModel, path: str) -> None:
    """Every table of a fitted model as Parquet below ``path``, which must be new."""
    names = CF_TABLES if isinstance(model, CFModel) else CONTENT_TABLES
    for n in names:
        getattr(model, n).write.parquet(f"{path}/{n}")
    if isinstance(model, CFModel):
        model.rows.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(model.sigma)],
                                                "component long, sigma double").write.parquet(f"{path}/sigma")


def load_cf(spark: SparkSession, path: str) -> CFModel:
    t = {n: spark.read.parquet(f"{path}/{n}") for n in CF_TABLES}
    sigma = [r.sigma for r in spark.read.parquet(f"{path}/sigma").orderBy("component").collect()]  # one per component
    return CFModel(sigma=sigma, **t)


def load_content(spark: SparkSession, path: str) -> ContentModel:
    return ContentModel(**{n: spark.read.parquet(f"{path}/{n}") for n in CONTENT_TABLES})


# --- hybrid ---------------------------------------------------------------
def minmax(cands: DataFrame, col: str = "score", out: str = "norm") -> DataFrame:
    """Per-user (x - min) / (max - min); all-equal lists map to 1.0."""
    w = Window.partitionBy("customer_id")
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return cands.withColumn(out, F.when(hi == lo, F.lit(1.0)).otherwise((F.col(col) - lo) / (hi - lo)))


def blend(cf: DataFrame, content: DataFrame, weight: float) -> DataFrame:
    """Full outer join of normalised candidate lists; a missing side scores 0."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("collaborative_weight must be between zero and one")
    a = minmax(cf).select("customer_id", "article_id", F.col("norm").alias("cf"))
    b = minmax(content).select("customer_id", "article_id", F.col("norm").alias("ct"))
    j = a.join(b, ["customer_id", "article_id"], "full")
    cfc = F.lit(weight) * F.coalesce("cf", F.lit(0.0))
    ctc = F.lit(1.0 - weight) * F.coalesce("ct", F.lit(0.0))
    return j.select("customer_id", "article_id", (cfc + ctc).alias("score"),
                    cfc.alias("collaborative_contribution"), ctc.alias("content_contribution"))


def rank_top(scored: DataFrame, k: int, tie_digits: int = 12) -> DataFrame:
    w = Window.partitionBy("customer_id").orderBy(F.desc(F.round("score", tie_digits)), F.asc("article_id"))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def rec_hybrid(cf_cands: DataFrame, content_cands: DataFrame, weight: float, k: int) -> DataFrame:
    """Blend each side's top candidates (already cut to k x multiplier), keep top k."""
    return rank_top(blend(cf_cands, content_cands, weight), k)


def fresh_quota(output: DataFrame, fresh_cands: DataFrame, fresh_items: DataFrame, min_fresh: int, k: int) -> DataFrame:
    """Guarantee ``min(min_fresh, k)`` fresh items in each top-k list.

    Missing fresh items are the best fresh candidates (raw content score)
    not already listed; as many non-fresh items leave from the tail; the list
    is re-sorted by the mixed scores and cut to k. No additions -> unchanged.
    """
    need_total = min(min_fresh, k)
    if need_total <= 0:
        return output
    fr = dealt(fresh_items.select("article_id").distinct().withColumn("_fresh", F.lit(True)))
    out = output.join(fr, "article_id", "left").withColumn("_fresh", F.coalesce("_fresh", F.lit(False)))
    nf = out.groupBy("customer_id").agg(F.count_if("_fresh").alias("_nf"))
    need = nf.select("customer_id", (F.lit(need_total) - F.col("_nf")).alias("_need")).where(F.col("_need") > 0)
    add = (fresh_cands.join(need, "customer_id")
           .join(out.select("customer_id", "article_id"), ["customer_id", "article_id"], "left_anti"))
    wa = Window.partitionBy("customer_id").orderBy(F.desc("score"), F.asc("article_id"))
    add = add.withColumn("_r", F.row_number().over(wa)).where(F.col("_r") <= F.col("_need"))
    n_add = add.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_nadd"))
    wr = Window.partitionBy("customer_id", "_fresh").orderBy(F.desc("rank"))
    kept = (out.join(n_add, "customer_id", "left").withColumn("_rev", F.row_number().over(wr))
            .where(F.col("_fresh") | F.col("_nadd").isNull() | (F.col("_rev") > F.col("_nadd"))))
    merged = kept.select("customer_id", "article_id", "score").unionByName(add.select("customer_id", "article_id", "score"))
    return rank_top(merged, k).select("customer_id", "rank", "article_id", "score")
