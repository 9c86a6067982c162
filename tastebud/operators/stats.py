"""Pipeline counters and the flattening of metric reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pipeline_stats(raw: DataFrame, labelled: DataFrame, raw_items: DataFrame, items: DataFrame,
                   raw_customers: DataFrame, customers: DataFrame) -> DataFrame:
    """The 14 preprocessing counters as one row.

    Interaction counters come from one aggregate over the labelled frame;
    drop counters cover only rows inside the split window. Deduplication never
    happens (repeat purchases are kept), so that counter is always 0.
    """
    in_window = F.col("split").isNotNull()
    kept = in_window & F.col("reject_reason").isNull()
    lab = labelled.agg(
        F.count_if(kept & (F.col("split") == "train")).alias("interactions_train_rows"),
        F.count_if(kept & (F.col("split") == "val")).alias("interactions_val_rows"),
        F.count_if(kept & (F.col("split") == "test")).alias("interactions_test_rows"),
        F.count_if(kept).alias("interactions_clean_rows"),
        F.count_if(in_window & (F.col("reject_reason") == "missing")).alias("interactions_dropped_missing"),
        F.count_if(in_window & (F.col("reject_reason") == "invalid_price")).alias("interactions_dropped_invalid_price"),
        F.lit(0).cast("long").alias("interactions_deduplicated"),
        F.count_if(in_window & (F.col("reject_reason") == "orphan")).alias("interactions_dropped_orphan_items"))
    scalar = lambda df: df.select(F.count(F.lit(1))).scalar()
    return lab.select(
        scalar(raw).alias("interactions_raw_rows"), "*",
        scalar(raw_items).alias("items_raw_rows"),
        scalar(items).alias("items_clean_rows"),
        items.select(F.count_if(F.col("has_image"))).scalar().alias("items_with_images"),
        scalar(raw_customers).alias("customers_raw_rows"),
        scalar(customers).alias("customers_clean_rows"))


def metrics_long(report: DataFrame, prefix_col: str = "model", drop: tuple[str, ...] = ("k", "users_evaluated"),
                 finite_only: bool = False) -> DataFrame:
    """Flatten wide metric rows to (name, value) with ``name = <prefix>.<metric>``.

    ``report`` has one row per model with a ``model`` column and numeric
    metric columns. ``k`` and ``users_evaluated`` are dropped; the policy
    variant also drops non-finite values.
    """
    metric_cols = [c for c in report.columns if c != prefix_col and c not in drop]
    typed = report.select(prefix_col, *[F.col(c).cast("double").alias(c) for c in metric_cols])
    long = typed.unpivot([prefix_col], metric_cols, "metric", "value")
    out = long.select(F.concat_ws(".", prefix_col, "metric").alias("name"), F.col("value").cast("double").alias("value"))
    if finite_only:
        out = out.where(~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))
    return out
