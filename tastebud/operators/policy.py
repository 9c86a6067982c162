"""Policy comparison: random baseline, expected clicks under position bias, lift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastebud.functions.index import dense_index


def _hash32(seed: int, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def _next_prime(n: int) -> int:
    c = max(2, n)
    while any(c % d == 0 for d in range(2, int(c ** 0.5) + 1)):
        c += 1
    return c


def _mod_inverse(a: Column, p: int) -> Column:
    """a^(p-2) mod p by square-and-multiply over 31 bits (products stay < 2^62)."""
    e = p - 2
    init = F.struct(F.lit(1).cast("long").alias("r"), a.cast("long").alias("b"))
    step = lambda acc, i: F.struct(
        F.when((F.lit(e).cast("double") / F.pow(F.lit(2.0), i)).cast("long") % 2 == 1, acc["r"] * acc["b"] % p).otherwise(acc["r"]).alias("r"),
        (acc["b"] * acc["b"] % p).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), init, step, lambda acc: acc["r"])


def random_policy(items: DataFrame, seen: DataFrame, users: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k unseen items per user in a per-user pseudo-random order, score 1.0.

    Items get dense indices x in [0, n). For user u the order is the key
    (a_u * x + b_u) mod p with p the smallest prime >= n, a permutation of
    [0, p). Keys are walked from 0 upward exactly like ``rec_popularity``
    walks popularity ranks: keys of seen items and of the p - n phantom
    indices are gaps, so work per user is k + |seen_u| + (p - n), never the
    catalog size. Key -> item uses the modular inverse of a_u.
    """
    if k <= 0:
        raise ValueError("k must be greater than zero")
    idx = dense_index(items.select("article_id").distinct(), [F.col("article_id")], "x")
    n = idx.count()
    p = _next_prime(n)
    u = users.select("customer_id").distinct()
    u = u.select("customer_id",
                 (F.lit(1) + _hash32(seed, F.col("customer_id"), F.lit("a")) % (p - 1)).alias("a"),
                 (_hash32(seed, F.col("customer_id"), F.lit("b")) % p).alias("b"))
    u = u.withColumn("a_inv", _mod_inverse(F.col("a"), p))
    key = lambda x: (F.col("a") * x + F.col("b")) % p
    blocked_seen = (seen.join(idx, "article_id").join(u, "customer_id")
                    .select("customer_id", key(F.col("x")).alias("key")))
    # phantom indices n..p-1 (fewer than one prime gap) are gaps for every user
    blocked_ph = (u.select("customer_id", "a", "b", F.explode(F.sequence(F.lit(n), F.lit(p - 1))).alias("x"))
                  .select("customer_id", key(F.col("x")).alias("key"))) if p > n else None
    marks = blocked_seen if blocked_ph is None else blocked_seen.unionByName(blocked_ph)
    marks = marks.select("customer_id", (F.col("key") + 1).alias("s")).unionByName(
        u.select("customer_id", F.lit(0).cast("long").alias("s")))
    w = Window.partitionBy("customer_id").orderBy("s")
    marks = marks.withColumn("i", F.row_number().over(w) - 1).withColumn("nxt", F.lead("s", 1).over(w))
    lo = F.col("s") + 1
    hi = F.least(F.coalesce(F.col("nxt"), F.lit(p + 1)) - 1, F.lit(k) + F.col("i"))
    pos = marks.where(lo <= hi).select("customer_id", "i", F.explode(F.sequence(lo, hi)).alias("pos"))
    pos = pos.join(u, "customer_id").select(
        "customer_id", (F.col("pos") - F.col("i")).cast("long").alias("rank"),
        (F.col("a_inv") * (((F.col("pos") - 1 - F.col("b")) % p + p) % p) % p).alias("x"))
    return pos.join(idx, "x").select("customer_id", "rank", "article_id", F.lit(1.0).alias("score"))


def expected_clicks(recs: DataFrame, truth: DataFrame, relevant_base: float = 0.35,
                    irrelevant_base: float = 0.01) -> DataFrame:
    """Closed form of the position-biased click simulation (its expectation).

    p = clip(base / log2(rank + 1), 0, 1). Per session: E[clicks] = sum p,
    P(any click) = 1 - prod(1 - p). Sessions = users in both recs and truth.
    """
    users = recs.select("customer_id").distinct().join(truth.select("customer_id").distinct(), "customer_id")
    r = recs.join(users, "customer_id", "left_semi")
    t = truth.select("customer_id", "article_id").distinct().withColumn("_rel", F.lit(True))
    j = r.join(t, ["customer_id", "article_id"], "left")
    rel = F.coalesce(F.col("_rel"), F.lit(False))
    base = F.when(rel, F.lit(relevant_base)).otherwise(F.lit(irrelevant_base))
    p = F.least(F.greatest(base / F.log2(F.col("rank") + 1), F.lit(0.0)), F.lit(1.0))
    j = j.withColumn("p", p).withColumn("rel", rel)

    def none_prob(cond: Column) -> Column:
        q = F.when(cond, F.col("p")).otherwise(F.lit(0.0))
        return F.when(F.max(q) >= 1.0, F.lit(0.0)).otherwise(F.exp(F.sum(F.log1p(-q))))

    per = j.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("p").alias("clicks"),
        F.sum(F.when(F.col("rel"), F.col("p")).otherwise(0.0)).alias("relevant_clicks"),
        (F.lit(1.0) - none_prob(F.lit(True))).alias("p_click"),
        (F.lit(1.0) - none_prob(F.col("rel"))).alias("p_relevant_click"))
    a = per.agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
                F.sum("relevant_clicks").alias("relevant_clicks"), F.count(F.lit(1)).alias("sessions"),
                F.sum("p_click").alias("sessions_with_click"), F.sum("p_relevant_click").alias("sessions_with_relevant_click"))
    imp = F.greatest(F.col("impressions"), F.lit(1))
    ses = F.greatest(F.col("sessions"), F.lit(1))
    return a.select(
        F.coalesce("impressions", F.lit(0)).cast("long").alias("impressions"),
        F.coalesce("clicks", F.lit(0.0)).alias("expected_clicks"),
        F.coalesce("relevant_clicks", F.lit(0.0)).alias("expected_relevant_clicks"),
        F.col("sessions").cast("long").alias("sessions"),
        F.coalesce(F.col("clicks") / imp, F.lit(0.0)).alias("click_through_rate"),
        F.coalesce(F.col("relevant_clicks") / imp, F.lit(0.0)).alias("relevant_click_through_rate"),
        F.coalesce(F.col("clicks") / ses, F.lit(0.0)).alias("avg_clicks_per_session"),
        F.coalesce(F.col("sessions_with_click") / ses, F.lit(0.0)).alias("sessions_with_click_rate"),
        F.coalesce(F.col("sessions_with_relevant_click") / ses, F.lit(0.0)).alias("sessions_with_relevant_click_rate"))


LIFT_METRICS = ("click_through_rate", "relevant_click_through_rate",
                "sessions_with_relevant_click_rate", "avg_clicks_per_session")


def lift(new: Column, base: Column) -> Column:
    """(new - base) / base; base 0 -> +inf if new > 0 else 0 (no ANSI division error)."""
    return (F.when(base == 0, F.when(new > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
            .otherwise((new - base) / base))


def policy_lift(baseline: DataFrame, personalized: DataFrame) -> DataFrame:
    """Four lifts from two one-row outcome tables, as (metric, lift) rows.

    The two rows are unioned and folded by one conditional aggregate, so each
    outcome plan runs once (no scalar subquery per metric, no join).
    """
    cols = list(LIFT_METRICS)
    both = (baseline.select(F.lit(0).alias("_who"), *cols)
            .unionByName(personalized.select(F.lit(1).alias("_who"), *cols)))
    wide = both.agg(*[F.max(F.when(F.col("_who") == w, F.col(m))).alias(f"{m}_{w}") for m in cols for w in (0, 1)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f"{m}_lift").alias("metric"), lift(F.col(f"{m}_1"), F.col(f"{m}_0")).alias("lift"))
        for m in cols])).alias("x")).select("x.*")
