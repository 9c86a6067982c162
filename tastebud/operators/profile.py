"""Exploratory profiling of the interaction log and master tables.

Every profile is one or two distributed aggregates; column profiles unpivot
to (column, value) and aggregate twice, so no column is pulled to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastebud.functions.quantiles import quantiles_of, value_counts


def _n(df: DataFrame) -> Column:
    return df.select(F.count(F.lit(1))).scalar()


def recent_window(tx: DataFrame, months: int = 6, n: int = 0, ts: str = "t_dat") -> DataFrame:
    """Rows with ``ts >= max - months``; with n > 0 the first n by date (the EDA sample)."""
    mx = tx.select(F.max(ts)).scalar()
    cut = mx - F.make_ym_interval(F.lit(0), F.lit(months))
    w = tx.where(F.col(ts) >= cut)
    return w.orderBy(ts, "customer_id", "article_id").limit(n) if n > 0 else w


def quality_report(tx: DataFrame) -> DataFrame:
    """Nine data-quality counters with their percentage of the sample."""
    n = _n(tx)
    distinct = tx.distinct().select(F.count(F.lit(1))).scalar()
    wide = tx.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("t_dat").isNull()).alias("missing_t_dat"),
        F.count_if(F.col("customer_id").isNull()).alias("missing_customer_id"),
        F.count_if(F.col("article_id").isNull()).alias("missing_article_id"),
        F.count_if(F.col("price").isNull()).alias("missing_price"),
        F.count_if(F.col("sales_channel_id").isNull()).alias("missing_sales_channel_id"),
        (F.count(F.lit(1)) - distinct).alias("duplicate_rows"),
        F.count_if(F.coalesce(F.col("price"), F.lit(-1.0)) <= 0).alias("non_positive_price"),
        F.count_if(~F.coalesce(F.col("sales_channel_id").isin(1, 2), F.lit(False))).alias("invalid_sales_channel"))
    names = ["rows", "missing_t_dat", "missing_customer_id", "missing_article_id", "missing_price",
             "missing_sales_channel_id", "duplicate_rows", "non_positive_price", "invalid_sales_channel"]
    long = wide.select(*[F.col(c).cast("long").alias(c) for c in names]).unpivot([], names, "metric", "count")
    pct = F.when(n > 0, F.lit(100.0) * F.col("count") / n)
    return long.select("metric", "count", pct.alias("pct_of_sample"))


def id_profile(tx: DataFrame, customers: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct ids in the sample and rows whose id is absent from the master table."""
    cu = tx.join(customers.select("customer_id").distinct(), "customer_id", "left_anti")
    ar = tx.join(items.select("article_id").distinct(), "article_id", "left_anti")
    row = tx.agg(F.count_distinct("customer_id").alias("unique_customers_in_sample"),
                 F.count_distinct("article_id").alias("unique_articles_in_sample")).select(
        "*", _n(cu).alias("customer_ids_not_in_customers"), _n(ar).alias("article_ids_not_in_articles"))
    names = ["unique_customers_in_sample", "unique_articles_in_sample",
             "customer_ids_not_in_customers", "article_ids_not_in_articles"]
    return row.unpivot([], names, "metric", "value")


def monthly_activity(tx: DataFrame, ts: str = "t_dat") -> DataFrame:
    return tx.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("transactions"))


# Advice texts of the preprocessing rule table, in rule order.
ACTIONS = [
    ("missing_t_dat", "Drop rows with invalid or missing t_dat."),
    ("missing_customer_id", "Drop rows with missing customer_id."),
    ("missing_article_id", "Drop rows with missing article_id."),
    ("price", "Coerce price to numeric and remove rows where price <= 0 or missing."),
    ("invalid_sales_channel", "Restrict sales_channel_id to expected values {1, 2}; mark others invalid."),
    ("article_orphans", "Drop transactions with article_id not found in articles metadata."),
    ("customer_orphans", "Handle transactions with customer_id missing from customers table (drop or map to unknown)."),
]
NO_ACTION = "No critical issues found in this sample. Keep current preprocessing and add assert-based checks."


def preprocessing_actions(quality: DataFrame, ids: DataFrame) -> DataFrame:
    """Advice rows fired by counters; one default row when nothing fires."""
    def qv(metric: str) -> Column:
        return quality.where(F.col("metric") == metric).select("count").scalar()

    def iv(metric: str) -> Column:
        return ids.where(F.col("metric") == metric).select("value").scalar()

    j = quality.sparkSession.range(1)
    conds = {
        "missing_t_dat": qv("missing_t_dat") > 0,
        "missing_customer_id": qv("missing_customer_id") > 0,
        "missing_article_id": qv("missing_article_id") > 0,
        "price": (qv("missing_price") > 0) | (qv("non_positive_price") > 0),
        "invalid_sales_channel": qv("invalid_sales_channel") > 0,
        "article_orphans": iv("article_ids_not_in_articles") > 0,
        "customer_orphans": iv("customer_ids_not_in_customers") > 0,
    }
    rows = j.select(F.explode(F.array(*[
        F.struct(F.lit(pos).cast("long").alias("position"),
                 F.when(conds[key], F.lit(text)).alias("preprocessing_actions"))
        for pos, (key, text) in enumerate(ACTIONS)])).alias("a")).select("a.*")
    rows = rows.where(F.col("preprocessing_actions").isNotNull())
    any_fired = conds["missing_t_dat"]
    for c in list(conds.values())[1:]:
        any_fired = any_fired | c
    default = j.where(~any_fired).select(F.lit(0).cast("long").alias("position"),
                                         F.lit(NO_ACTION).alias("preprocessing_actions"))
    return rows.unionByName(default)


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: dtype, missing, missing %, unique, unique %, top value (<=50 chars), top freq.

    Top-value ties go to the smallest value (the reference's tie order is
    insertion order). Percentages are rounded to 2 decimals.
    """
    cols = df.columns
    n = _n(df)
    dtypes = dict(df.dtypes)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x")).select("x.*")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq"))
    per_col = counts.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("freq")).otherwise(0)).alias("missing"),
        F.count_if(F.col("value").isNotNull()).alias("unique"),
        F.max(F.when(F.col("value").isNotNull(), F.col("freq"))).alias("top_freq"))
    top = (counts.where(F.col("value").isNotNull()).join(per_col.select("column", "top_freq"), "column")
           .where(F.col("freq") == F.col("top_freq")).groupBy("column").agg(F.min("value").alias("top_value")))
    dtype_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(dtypes[c]))])
    out = per_col.join(top, "column", "left")
    return out.select(
        "column", dtype_map[F.col("column")].alias("dtype"),
        F.col("missing").cast("long").alias("missing"),
        F.round(F.lit(100.0) * F.col("missing") / n, 2).alias("missing_pct"),
        F.col("unique").cast("long").alias("unique"),
        F.round(F.lit(100.0) * F.col("unique") / n, 2).alias("unique_pct"),
        F.substring(F.coalesce("top_value", F.lit("None")), 1, 50).alias("top_value"),
        F.coalesce(F.col("top_freq"), F.lit(0)).cast("long").alias("top_freq"))


def profile_subset(master: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Profile only master rows whose key appears in the sample."""
    return column_profile(master.join(sample.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi"))


def high_missing(profile: DataFrame, threshold: float = 20.0) -> DataFrame:
    return profile.where(F.col("missing_pct") > threshold).select("column", "missing", "missing_pct")


def numeric_describe(df: DataFrame) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear), max per numeric column; 2 decimals.

    One scan counts the distinct values of all columns; every figure comes from
    these counts, quartiles by their positions (``quantiles_of``).
    """
    kinds = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType)
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in num])).alias("cell")
    counts = value_counts(df.select(cells).select("cell.*"), ["column"], "x")
    x, c = F.col("x"), F.col("c")
    sums = counts.groupBy("column").agg(F.sum("c").alias("n"), (F.sum(x * c) / F.sum("c")).alias("mean"),
                                        F.min("x").alias("min"), F.max("x").alias("max"))
    # Second moments about the mean; one row per column joins.
    spread = (counts.join(F.broadcast(sums.select("column", "mean")), "column").groupBy("column")
              .agg(F.sum(c * (x - F.col("mean")) * (x - F.col("mean"))).alias("square")))
    parts = sums.join(spread, "column").join(quantiles_of(counts, ["column"], "x", [0.25, 0.5, 0.75]).drop("n"), "column")
    every = df.sparkSession.createDataFrame([(name,) for name in num], "column string")
    std = F.sqrt(F.col("square") / F.nullif(F.col("n") - 1, F.lit(0)))
    return every.join(parts, "column", "left").select(
        "column", F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("count"), F.round("mean", 2).alias("mean"), F.round(std, 2).alias("std"),
        F.round("min", 2).alias("min"), *[F.round(F.col("q")[i], 2).alias(p) for i, p in enumerate(("p25", "p50", "p75"))],
        F.round("max", 2).alias("max"))


def count_summary(counts: DataFrame, entity: str) -> DataFrame:
    """entities, mean, median, p90, p95, p99, max of a per-entity count column ``n``."""
    a = counts.agg(
        F.count(F.lit(1)).cast("double").alias(entity), F.round(F.avg("n"), 2).alias("mean"),
        F.round(F.percentile("n", 0.5), 2).alias("median"), F.round(F.percentile("n", 0.9), 2).alias("p90"),
        F.round(F.percentile("n", 0.95), 2).alias("p95"), F.round(F.percentile("n", 0.99), 2).alias("p99"),
        F.max("n").cast("double").alias("max"))
    names = [entity, "mean", "median", "p90", "p95", "p99", "max"]
    return a.unpivot([], names, "metric", "value")


def activity_counts(tx: DataFrame, key: str) -> DataFrame:
    return tx.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


BIN_EDGES = [0, 1, 2, 5, 10, 20]


def count_bins(counts: DataFrame, label: str) -> DataFrame:
    """Right-closed bins [0,1], (1,2], (2,5], (5,10], (10,20], (20,max]; empty bins kept."""
    spark = counts.sparkSession
    mx = counts.select(F.max("n")).scalar()
    labels = ["[0, 1]", "(1, 2]", "(2, 5]", "(5, 10]", "(10, 20]", "(20, max]"]
    bins = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "bin_order int, bin string")
    n = F.col("n")
    which = (F.when(n <= 1, 0).when(n <= 2, 1).when(n <= 5, 2).when(n <= 10, 3).when(n <= 20, 4).otherwise(5))
    agg = counts.groupBy(which.alias("bin_order")).agg(F.count(F.lit(1)).alias(label))
    total = _n(counts)
    out = bins.join(F.broadcast(agg), "bin_order", "left").select(
        F.col("bin_order").cast("long").alias("bin_order"),
        F.when(F.col("bin_order") == 5, F.concat(F.lit("(20, "), mx.cast("string"), F.lit("]"))).otherwise(F.col("bin")).alias("bin"),
        F.coalesce(F.col(label), F.lit(0)).cast("long").alias(label))
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col(label) / total, 2))


def matrix_sparsity(tx: DataFrame) -> DataFrame:
    """Density uses *rows* (not distinct pairs) over users x items cells."""
    a = tx.agg(F.count(F.lit(1)).alias("n_interactions"), F.count_distinct("customer_id").alias("n_users"),
               F.count_distinct("article_id").alias("n_items"))
    cells = F.col("n_users") * F.col("n_items")
    density = F.when(cells > 0, F.col("n_interactions") / cells).otherwise(F.lit(0.0))
    return a.select("*", cells.alias("matrix_size"), F.round(density, 8).alias("density"),
                    F.round(F.lit(1.0) - density, 8).alias("sparsity"))


def cold_start_risk(tx: DataFrame, days: int = 7, ts: str = "t_dat") -> DataFrame:
    """Hold out the last ``days``: how many test users / items are new?"""
    cut = tx.select(F.max(ts)).scalar() - F.make_dt_interval(F.lit(days))
    tr = tx.where(F.col(ts) <= cut)
    te = tx.where(F.col(ts) > cut)
    te_users = te.select("customer_id").where(F.col("customer_id").isNotNull()).distinct()
    te_items = te.select("article_id").where(F.col("article_id").isNotNull()).distinct()
    new_u = te_users.join(tr.select("customer_id").distinct(), "customer_id", "left_anti")
    new_i = te_items.join(tr.select("article_id").distinct(), "article_id", "left_anti")
    spark = tx.sparkSession
    row = spark.range(1).select(
        _n(tr).alias("train_rows"), _n(te).alias("test_rows"), _n(te_users).alias("test_unique_users"),
        _n(te_items).alias("test_unique_items"), _n(new_u).alias("new_users_in_test"),
        _n(new_i).alias("new_items_in_test"))
    row = row.select("*",
                     F.round(F.lit(100.0) * F.col("new_users_in_test") / F.greatest(F.col("test_unique_users"), F.lit(1)), 2)
                     .alias("new_user_rate_pct"),
                     F.round(F.lit(100.0) * F.col("new_items_in_test") / F.greatest(F.col("test_unique_items"), F.lit(1)), 2)
                     .alias("new_item_rate_pct"))
    names = row.columns
    return row.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", "value")


# Modelling insight texts, in rule order.
INSIGHTS = [
    ("User activity is heavy-tailed; include popularity priors and cap very heavy-user influence.",
     "User activity is relatively balanced; collaborative signals should generalize more evenly."),
    ("Item popularity is heavy-tailed; combine personalized retrieval with popularity backfill.",
     "Item popularity is less concentrated; broader candidate exploration is viable."),
    ("Interaction matrix is extremely sparse; favor retrieval + ranking over dense neighborhood methods.",
     "Sparsity is moderate; matrix/neighborhood methods are more feasible."),
    ("User cold-start exists in holdout; include customer-feature and popularity fallback logic.", None),
    ("Item cold-start exists in holdout; include content-based item features (`item_text`/metadata).", None),
]


def modeling_insights(tx: DataFrame, days: int = 7) -> DataFrame:
    """Threshold rules over p95 activity, sparsity and cold-start counts -> advice rows."""
    users = activity_counts(tx, "customer_id")
    items = activity_counts(tx, "article_id")
    p95u = users.select(F.percentile("n", 0.95)).scalar()
    p95i = items.select(F.percentile("n", 0.95)).scalar()
    sp = matrix_sparsity(tx).select("sparsity").scalar()
    risk = cold_start_risk(tx, days)
    nu = risk.where(F.col("metric") == "new_users_in_test").select("value").scalar()
    ni = risk.where(F.col("metric") == "new_items_in_test").select("value").scalar()
    conds = [p95u > 10, p95i > 10, sp > 0.99, nu > 0, ni > 0]
    spark = tx.sparkSession
    arr = []
    for pos, (cond, (yes, no)) in enumerate(zip(conds, INSIGHTS)):
        text = F.when(cond, F.lit(yes))
        if no is not None:
            text = text.otherwise(F.lit(no))
        arr.append(F.struct(F.lit(pos).cast("long").alias("position"), text.alias("eda_insight_for_modeling")))
    return (spark.range(1).select(F.explode(F.array(*arr)).alias("x")).select("x.*")
            .where(F.col("eda_insight_for_modeling").isNotNull()))


def retrieval_tables(tx: DataFrame, items: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Narrow retrieval tables; transactions: valid rows only, exact duplicates dropped."""
    rtx = (tx.select("customer_id", "article_id", "t_dat", "price", "sales_channel_id")
           .dropna(subset=["customer_id", "article_id", "t_dat", "price"])
           .where((F.col("price") > 0) & F.col("sales_channel_id").isin(1, 2)).distinct())
    ritems = items.select("article_id", "prod_name", "product_type_name", "product_group_name", "department_name",
                          "section_name", "garment_group_name", "detail_desc")
    rcust = customers.select("customer_id", "age", "fashion_news_frequency", "club_member_status")
    spark = tx.sparkSession
    summary = None
    for name, df in (("retrieval_tx", rtx), ("retrieval_items", ritems), ("retrieval_customers", rcust)):
        part = spark.range(1).select(F.lit(name).alias("table"), _n(df).alias("rows"),
                                     F.lit(", ".join(df.columns)).alias("columns"))
        summary = part if summary is None else summary.unionByName(part)
    return rtx, ritems, rcust, summary
