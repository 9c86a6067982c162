"""Popularity, seen sets, unseen top-k, segment and category rankings, ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastebud.functions.index import dense_index, rank_within
from tastebud.functions.numeric import age_band
from tastebud.session import stored


def _check_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be greater than zero")


def popularity(interactions: DataFrame) -> DataFrame:
    """Rows per article as ``score``; ``pop_rank`` 1.. by score desc, article_id asc.

    The count is a partial+final hash aggregate; the global rank is a
    distributed dense index, not a single-partition window.
    """
    counts = (interactions.select("article_id").where(F.col("article_id").isNotNull())
              .groupBy("article_id").agg(F.count(F.lit(1)).cast("double").alias("score")))
    return dense_index(counts, [F.desc("score"), F.asc("article_id")], "pop_rank", start=1)


def seen_pairs(interactions: DataFrame) -> DataFrame:
    """Distinct (customer_id, article_id) a user already interacted with."""
    return interactions.select("customer_id", "article_id").dropna().distinct()


def rec_popularity(pop: DataFrame, seen: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """Top-k unseen popular items per user; unknown users get the global top-k.

    Never forms users x catalog. For a user whose seen items sit at popularity
    ranks s_1 < s_2 < ..., the unseen ranks between s_i and s_(i+1) have unseen
    position r - i, so each gap contributes ranks s_i+1 .. min(s_(i+1)-1, k+i).
    A sentinel s_0 = 0 gives the first gap. Only per-user seen rows (at most
    the catalog size) are windowed; output is at most k rows per user. Gaps reach
    at most rank k + the longest history: the ranking so far goes along as one
    array (``ranking``), so that no join meets all users on a few hot ranks.
    """
    _check_k(k)
    n_items = pop.select(F.max("pop_rank")).scalar()
    ranks = pop.select("article_id", F.col("pop_rank").alias("s"))
    targets = users.select("customer_id").distinct()
    marks = (seen.join(ranks, "article_id").select("customer_id", "s")
             .join(targets, "customer_id", "left_semi")
             .unionByName(targets.select("customer_id", F.lit(0).cast("long").alias("s"))))
    w = Window.partitionBy("customer_id").orderBy("s")
    marks = (marks.withColumn("i", F.row_number().over(w) - 1)
             .withColumn("nxt", F.lead("s", 1).over(w)))
    lo = F.col("s") + 1
    hi = F.least(F.coalesce(F.col("nxt"), n_items + 1) - 1, F.lit(k) + F.col("i"))
    gaps = stored(marks.where(lo <= hi).select("customer_id", "i", lo.alias("lo"), hi.alias("hi")), "gaps")
    reach = gaps.agg(F.max("hi")).first()[0] or 0
    rows = gaps.select("customer_id", "i", F.explode(F.sequence("lo", "hi")).alias("pop_rank"))
    rank = (F.col("pop_rank") - F.col("i")).cast("long").alias("rank")
    if reach > RANKING_ITEMS:  # a history beyond the bound of the array: joined by rank
        return rows.join(pop, "pop_rank").select("customer_id", rank, "article_id", "score")
    item = F.get(ranking(pop, reach), (F.col("pop_rank") - 1).cast("int"))
    return rows.select("customer_id", rank, item["article_id"].alias("article_id"), item["score"].alias("score"))


RANKING_ITEMS = 100_000  # items of a ranking that goes along as a value: a few MB


def ranking(pop: DataFrame, n: int) -> Column:
    """The first ``n`` items of the popularity ranking as one array value of (article_id, score)."""
    first = pop.where(F.col("pop_rank") <= n).agg(F.array_sort(F.collect_list(F.struct("pop_rank", "article_id", "score"))).alias("r"))
    return first.select(F.transform("r", lambda x: F.struct(x["article_id"].alias("article_id"), x["score"].alias("score")))).scalar()


def global_top(pop: DataFrame, k: int) -> DataFrame:
    _check_k(k)
    return pop.where(F.col("pop_rank") <= k).select(
        F.col("pop_rank").alias("rank"), "article_id", "score")


def segment_rankings(events: DataFrame, customers: DataFrame, min_segment_events: int = 50,
                     top_n: int | None = None) -> DataFrame:
    """Popularity within (age_band, membership) segments with enough *events*.

    Ties by article_id asc (the reference's order is unstable there).
    """
    ev = events.select(F.col("customer_id").cast("string"), F.col("article_id").cast("string")).dropna()
    prof = customers.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        age_band("age").alias("age_band"),
        F.lower(F.coalesce(F.col("club_member_status").cast("string"), F.lit("none"))).alias("club_member_status"))
    j = ev.join(prof, "customer_id", "left").select(
        F.coalesce("age_band", F.lit("unknown")).alias("age_band"),
        F.coalesce("club_member_status", F.lit("none")).alias("club_member_status"),
        "article_id")
    counts = j.groupBy("age_band", "club_member_status", "article_id").agg(F.count(F.lit(1)).alias("n"))
    segment = ["age_band", "club_member_status"]
    # Totals are a plain aggregate, one row per segment; ranks come without a sort of a whole segment in one task.
    large = j.groupBy(*segment).agg(F.count(F.lit(1)).alias("seg_events")).where(F.col("seg_events") >= min_segment_events)
    ranked = rank_within(counts.join(large.select(*segment), segment, "left_semi"), segment, [F.desc("n"), F.asc("article_id")], top_n=top_n)
    return ranked.select("age_band", "club_member_status", "rank", "article_id",
                         F.col("n").cast("double").alias("score"))


def category_rankings(events: DataFrame, items: DataFrame, top_n: int | None = None) -> DataFrame:
    """Popularity within lower-cased product group; empty group skipped."""
    counts = (events.select(F.col("article_id").cast("string")).dropna()
              .groupBy("article_id").agg(F.count(F.lit(1)).cast("double").alias("score")))
    cat = items.select(F.col("article_id").cast("string"),
                       F.lower(F.coalesce(F.col("product_group_name").cast("string"), F.lit(""))).alias("product_group_name"))
    j = counts.join(cat, "article_id", "left").where(F.col("product_group_name").isNotNull() & (F.col("product_group_name") != ""))
    ranked = rank_within(j, ["product_group_name"], [F.desc("score"), F.asc("article_id")], top_n=top_n)
    return ranked.select("product_group_name", "rank", "article_id", "score")


def ground_truth(holdout: DataFrame, known_users: DataFrame, known_items: DataFrame,
                 seen: DataFrame | None = None) -> DataFrame:
    """Distinct warm (user, item) holdout pairs minus training pairs (long form)."""
    pairs = (holdout.select(F.col("customer_id").cast("string"), F.col("article_id").cast("string")).dropna()
             .join(known_users.select("customer_id").distinct(), "customer_id", "left_semi")
             .join(known_items.select("article_id").distinct(), "article_id", "left_semi"))
    if seen is not None:
        pairs = pairs.join(seen, ["customer_id", "article_id"], "left_anti")
    return pairs.distinct()
