"""Shared plan fragments for one data directory (lazy; nothing is computed here)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastebud.operators import clean as C
from tastebud.operators import popularity as P
from tastebud.sources import adapters as A  # noqa: F401

K = 12


class Frames:
    """Lazily built DataFrames over one test-data directory.

    ``adapter='events'`` (B, default) or ``'orders'`` (A) picks the
    transaction source; items and customers come from ``part``/``customer``.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, adapter: str = "events"):
        self.spark, self.sf_dir, self.adapter = spark, sf_dir, adapter

    # raw inputs -------------------------------------------------------
    @cached_property
    def raw_transactions(self) -> DataFrame:
        if self.adapter == "orders":
            return A.order_transactions(self.spark, self.sf_dir)
        return A.events_transactions(self.spark, self.sf_dir)

    @cached_property
    def raw_items(self) -> DataFrame:
        return A.articles(self.spark, self.sf_dir)

    @cached_property
    def raw_customers(self) -> DataFrame:
        return A.customers(self.spark, self.sf_dir)

    # processed (written once by the preprocess stage, then read) ------
    @cached_property
    def store(self) -> str:
        from tastebud.plans.preprocess import run_preprocess
        from tastebud.sources.sinks import processed_dir
        from tastebud.plans.preprocess import is_ready
        out = processed_dir(self.spark, self.sf_dir, self.adapter)
        if not is_ready(self.spark, out):
            run_preprocess(self.spark, self.raw_transactions, self.raw_items, self.raw_customers, out)
        return out

    def _read(self, name: str) -> DataFrame:
        from tastebud.plans.preprocess import read_processed
        return read_processed(self.spark, self.store, name)

    @cached_property
    def items(self) -> DataFrame:
        return self._read("items_clean")

    @cached_property
    def customers(self) -> DataFrame:
        return self._read("customers_clean")

    @cached_property
    def labelled(self) -> DataFrame:
        """Labelled raw rows (split + reject reason), computed from raw on demand."""
        return C.labelled_interactions(self.raw_transactions, self.items)

    @cached_property
    def clean(self) -> DataFrame:
        return self._read("interactions_clean")

    def split(self, name: str) -> DataFrame:
        return self.clean.where(F.col("split") == name)

    @cached_property
    def train(self) -> DataFrame:
        return self.split("train")

    @cached_property
    def val(self) -> DataFrame:
        return self.split("val")

    @cached_property
    def test(self) -> DataFrame:
        return self.split("test")

    @cached_property
    def user_map(self) -> DataFrame:
        return self._read("customer_map")

    @cached_property
    def item_map(self) -> DataFrame:
        return self._read("item_map")

    # models -----------------------------------------------------------
    @cached_property
    def pop(self) -> DataFrame:
        return self._read("popularity")

    @cached_property
    def seen(self) -> DataFrame:
        return self._read("seen")

    @cached_property
    def train_users(self) -> DataFrame:
        return self.user_map.select("customer_id")

    @cached_property
    def train_items(self) -> DataFrame:
        return self.item_map.select("article_id")

    def truth(self, split: str = "val") -> DataFrame:
        return P.ground_truth(self.split(split), self.train_users, self.train_items, self.seen)

    @cached_property
    def fresh_items(self) -> DataFrame:
        """Catalog items without a training row."""
        return (self.items.select("article_id").distinct()
                .join(self.train_items, "article_id", "left_anti"))
