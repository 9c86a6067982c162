"""Pruned lookups, counted quantiles, hot keys: against brute force, with one key that holds most rows."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastebud.functions.index import rank_within
from tastebud.functions.quantiles import exact_quantiles
from tastebud.operators import coldstart, evaluate, intent, popularity, similar
from tastebud.operators.profile import numeric_describe


# --- neighbours by terms ---------------------------------------------------
def _weights(rng, docs, vocabulary):
    rows = []
    for d in range(docs):
        terms = {0, 1, *(int(min(rng.expovariate(0.02), vocabulary - 1)) for _ in range(8))}  # terms 0 and 1 are in every document
        raw = {t: (0.05 if t < 2 else 1.0) * rng.uniform(0.5, 1.5) for t in terms}
        norm = sum(x * x for x in raw.values()) ** 0.5
        rows += [(f"d{d:04d}", f"t{t:03d}", x / norm) for t, x in raw.items()]
    return rows


@pytest.mark.parametrize("postings", [similar.POSTINGS, 7])
def test_neighbours_by_terms_equal_brute_force(spark, monkeypatch, postings):
    monkeypatch.setattr(similar, "POSTINGS", postings)
    rng = random.Random(6)
    rows = _weights(rng, 300, 120)
    w = spark.createDataFrame(rows, "article_id string, term string, weight double")
    ids = sorted({r[0] for r in rows})
    asked = spark.createDataFrame([(i,) for i in ids[::6]] + [("unknown",)], "article_id string")
    cat = spark.createDataFrame([(i, i) for i in ids], "article_id string, item_text string")
    got = {(r.query_article_id, r.rank): (r.article_id, r.score) for r in similar.similar_tfidf(w, cat, asked, 4).collect()}
    terms = sorted({r[1] for r in rows})
    m = np.zeros((len(ids), len(terms)))
    for d, t, x in rows:
        m[ids.index(d), terms.index(t)] = x
    for i in ids[::6]:
        s = np.round(m[ids.index(i)] @ m.T, 9)
        order = [j for j in np.lexsort((np.arange(len(ids)), -s)) if ids[j] != i][:4]
        assert [got[i, r + 1][0] for r in range(4)] == [ids[j] for j in order]
    found, _ = similar.survivors(w, asked, 4)
    assert found.count() < 0.5 * 50 * 299  # every document shares terms 0 and 1 with every query


# --- names -----------------------------------------------------------------
def _plain_name(q, names, measure, least):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b), 1)

    ratio = lev if measure == "levenshtein" else (lambda a, b: SequenceMatcher(None, a, b).ratio())
    best = None
    for art, name in names:
        n = (name or "").strip().lower()
        tier = 0 if n == q else 1 if q in n else 2
        score = 1.0 if tier == 0 else ratio(q, n)
        key = (tier, -round(score, 9), art)
        if best is None or key < best[0]:
            best = (key, art, tier, score)
    if best[2] == 2 and best[3] < least:
        return None, "no_match", 0.0
    return best[1], ("exact", "contains", "fuzzy")[best[2]], best[3]


@pytest.mark.parametrize("measure", ["levenshtein", "sequence"])
def test_names_equal_brute_force(spark, measure):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("aabcdé") for _ in range(rng.randint(1, 5)))
    names = [(f"a{i:03d}", " ".join(word() for _ in range(rng.randint(1, 3)))) for i in range(60)] + [("a900", None), ("a901", " Blue Shirt ")]
    asked = {n for _, n in names[:6]} | {" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(40)}
    asked |= {"", "b", "blue", "blue shrit", "zzzz", "x" * 200, "ab" * 40}
    items = spark.createDataFrame(names, "article_id string, prod_name string")
    q = spark.createDataFrame([(x,) for x in asked], "query_name string")
    got = {r.query_name: (r.article_id, r.match_type, r.name_match_score) for r in similar.resolve_name(q, items, measure=measure).collect()}
    assert set(got) == asked
    for x in asked:
        art, kind, score = _plain_name(x.strip().lower(), names, measure, 0.35)
        assert got[x][:2] == (art, kind) and got[x][2] == pytest.approx(score), x
    assert {k for _, k, _ in got.values()} == {"exact", "contains", "fuzzy", "no_match"}


# --- group names -----------------------------------------------------------
@pytest.mark.parametrize("max_bytes", [intent.NAME_BYTES, 400])
def test_group_names_with_a_common_prefix(spark, max_bytes):
    names = [f"Brand number {i}" for i in range(200)] + ["brand", "BRAND", "Ärmel"]
    groups = spark.createDataFrame([(n,) for n in names] + [("",), (None,)], "product_group_name string")
    texts = [(1, "a brand number 19 please"), (2, "Brand Number 199!"), (3, "no name"), (4, None), (5, ""), (6, "BRAND"), (7, "ärmel und brand"),
             (8, "brand number 1 or brand number 12"), (9, "brand number 13 or brand number 12")]
    msgs = spark.createDataFrame(texts, "msg_id long, text string")
    got = {r.msg_id: r.product_group for r in intent.extract_product_group(msgs, groups, max_bytes=max_bytes).collect()}
    want = {}
    for i, t in texts:
        hits = [n for n in names if t is not None and n.lower() in t.lower()]
        want[i] = min(hits, key=lambda n: (-len(n), n), default=None)
    assert got == want


# --- quantiles -------------------------------------------------------------
def test_quantiles_by_counting_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in np.round(rng.normal(size=4000), 3)] + [(f"k{i % 7}", float(i % 13)) for i in range(300)]
    rows += [("one", 2.5), (None, 1.0), (None, 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(9)
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k].n == len(v) and got[k].q == pytest.approx(list(np.quantile(v, probs)))


def test_describe_in_one_scan(spark):
    rows = [(i, float(i) if i % 5 else None, "x", None) for i in range(101)]
    df = spark.createDataFrame(rows, "a long, b double, s string, c int")
    got = {r.column: r for r in numeric_describe(df).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"]["count"] == 0 and got["c"]["mean"] is None
    b = np.array([r[1] for r in rows if r[1] is not None])
    assert (got["a"]["mean"], got["a"]["p25"], got["a"]["p50"], got["a"]["max"]) == (50.0, 25.0, 50.0, 100.0)
    assert (got["b"]["count"], got["b"]["std"], got["b"]["p75"]) == (len(b), round(b.std(ddof=1), 2), round(np.quantile(b, 0.75), 2))


# --- hot keys --------------------------------------------------------------
@pytest.mark.parametrize("top_n", [None, 5])
def test_ranks_within_a_hot_segment(spark, top_n):
    rows = [("hot", i, (i * 7919) % 1000) for i in range(900)] + [(f"s{i % 4}", i, i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "seg string, id long, n long")
    got = sorted((r.seg, r["rank"], r.id) for r in rank_within(df, ["seg"], [F.desc("n"), F.asc("id")], top_n=top_n).collect())
    want = []
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1]))
        want += [(s, i + 1, r[1]) for i, r in enumerate(mine[:top_n])]
    assert got == sorted(want)


def test_ranking_as_a_value_equals_the_join(spark, monkeypatch):
    rng = random.Random(1)
    tx = spark.createDataFrame([(f"u{rng.randint(0, 20)}", f"i{min(int(rng.expovariate(0.1)), 39):02d}") for _ in range(400)],
                               "customer_id string, article_id string")
    pop, seen = popularity.popularity(tx), popularity.seen_pairs(tx)
    users = tx.select("customer_id").union(spark.createDataFrame([("new",)], "customer_id string"))
    one = sorted(tuple(r) for r in popularity.rec_popularity(pop, seen, users, 6).collect())
    monkeypatch.setattr(popularity, "RANKING_ITEMS", 0)
    assert one == sorted(tuple(r) for r in popularity.rec_popularity(pop, seen, users, 6).collect()) and len(one) > 60


def test_a_bad_limit_rejects_one_request(spark):
    ranks = [(i, f"a{i}", 10.0 - i) for i in range(1, 6)]
    pop = spark.createDataFrame([(a, s, r) for r, a, s in ranks], "article_id string, score double, pop_rank long")
    seg = spark.createDataFrame([("25-34", "active", *r) for r in ranks], "age_band string, club_member_status string, rank long, article_id string, score double")
    cat = spark.createDataFrame([("bags", *r) for r in ranks], "product_group_name string, rank long, article_id string, score double")
    reqs = spark.createDataFrame([("good", 3, 30, "ACTIVE", None, None), ("zero", 0, 30, "ACTIVE", None, None), ("none", None, 30, "ACTIVE", None, None),
                                  ("many", 101, None, None, "Bags ", None), ("cat", 2, None, None, " Bags", False), ("all", 100, None, None, None, None)],
                                 "request_id string, limit int, age int, club_member_status string, preferred_product_group string, use_demographics boolean")
    out = coldstart.rec_cold_start(reqs, seg, cat, pop).collect()
    kinds = {r.request_id: r.strategy for r in out}
    assert kinds == {"good": "demographic_popularity", "zero": "rejected", "none": "rejected", "many": "rejected",
                     "cat": "category_popularity", "all": "global_popularity"}
    assert sorted((r.request_id, r["rank"], r.article_id) for r in out if r.strategy != "rejected") == sorted(
        [("good", i, f"a{i}") for i in (1, 2, 3)] + [("cat", i, f"a{i}") for i in (1, 2)] + [("all", i, f"a{i}") for i in range(1, 6)])
    assert all(r["rank"] is None and r.article_id is None for r in out if r.strategy == "rejected")


# --- bootstrap -------------------------------------------------------------
def test_weights_are_poisson_and_independent():
    users = np.random.default_rng(0).integers(0, 2**32, 3000)
    w = evaluate.poisson_weights(users, 200, 42)
    assert w.shape == (3000, 200) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25
    assert not np.array_equal(w, evaluate.poisson_weights(users, 200, 43))


def test_resampled_means_do_not_depend_on_partitions(spark):
    rows = [(m, f"u{i}", i / 50, i % 3 / 2, float(i % 2)) for m in ("a", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "model string, customer_id string, ndcg_at_k double, map_at_k double, hit_rate_at_k double")
    one = {(r.model, r.b): r.ndcg_at_k for r in evaluate.resampled_means(df.coalesce(1), ["model"], 30, 3).collect()}
    many = {(r.model, r.b): r.ndcg_at_k for r in evaluate.resampled_means(df.repartition(7), ["model"], 30, 3).collect()}
    assert len(one) == 60 and one == pytest.approx(many)
    assert all(one["a", b] == pytest.approx(one["b", b]) for b in range(30))  # the same users in every model
