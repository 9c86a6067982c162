"""Item-to-item similarity (TF-IDF cosine, exact dense inner product) and name lookup."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastebud.functions.index import dealt
from tastebud.operators.vectorsearch import BLOCK_ROWS, build_index, top_products
from tastebud.session import stored

TIE_DIGITS = 9  # scores are ranked after rounding so engines with other summation orders agree


def _top_n(scored: DataFrame, n: int, key: str = "query_article_id", cand: str = "article_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", TIE_DIGITS)), F.asc(cand))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


SEED_DOCS = 50  # documents per wanted neighbour that the first terms of a query should reach
POSTINGS = 65_536  # of one part of a term's list
FEW_TERMS = 50_000  # query terms that go along to the lists: a few MB


def query_terms(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_article_id, term, qw, impact, remains, reached, parts) for the terms of every query, by falling impact.

    ``impact`` is the most a term can add to any score (the query's weight times
    the greatest weight in the term's list), ``remains`` the sum of the impacts
    from this term on, ``reached`` the documents in the lists before it, ``parts``
    the number of parts in which the list is held.
    """
    lists = weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("most"))
    q = queries.select(F.col("article_id").alias("query_article_id")).distinct()
    rows = (dealt(weights).join(q, weights.article_id == q.query_article_id)
            .select("query_article_id", "term", F.col("weight").alias("qw")).join(lists, "term"))
    by = Window.partitionBy("query_article_id").orderBy(F.desc("impact"), F.asc("term"))
    return rows.withColumn("impact", F.col("qw") * F.col("most")).select(
        "query_article_id", "term", "qw", "impact",
        F.sum("impact").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("remains"),
        F.coalesce(F.sum("df").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("reached"),
        F.ceil(F.col("df") / POSTINGS).cast("int").alias("parts"))


def partial_scores(terms: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_article_id, article_id, score) over the given query terms alone; long lists meet their queries in parts.

    Few query terms go along to the lists, which stay where they are.
    """
    pair = F.col("article_id") != F.col("query_article_id")
    score = F.sum(F.col("qw") * F.col("weight")).alias("score")
    if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        few = F.broadcast(terms.select("query_article_id", "term", "qw"))
        return weights.join(few, "term").where(pair).groupBy("query_article_id", "article_id").agg(score)
    held = weights.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / POSTINGS).cast("int").alias("parts"))
    lists = (weights.join(held, "term").select(
        "term", "article_id", "weight", F.pmod(F.xxhash64("article_id"), F.col("parts")).cast("int").alias("part")))
    asked = terms.select("query_article_id", "term", "qw", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return asked.join(dealt(lists), ["term", "part"]).where(pair).groupBy("query_article_id", "article_id").agg(score)


def pair_scores(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_article_id, article_id, score) of every query article and every other one that shares a term with it."""
    return partial_scores(stored(query_terms(weights, queries), "terms"), weights)


def survivors(weights: DataFrame, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(candidates with their score so far, the terms that still may add to it) of every query.

    The n-th best score over a query's first terms is a floor. Terms from where on
    all impacts together stay below it can bring no document in by themselves: only
    the lists before are read, and a document they find stays only if it can
    still reach the floor.
    """
    terms = stored(query_terms(weights, queries), "terms")
    first = partial_scores(terms.where(F.col("reached") < SEED_DOCS * n), weights)
    by = Window.partitionBy("query_article_id").orderBy(F.desc("score"))
    floor = (first.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n).where(F.col("_r") == n)
             .select("query_article_id", (F.col("score") * (1 - 1e-9) - 2 * 10.0 ** -TIE_DIGITS).alias("floor")))
    known = stored(terms.join(floor, "query_article_id", "left"), "floors")
    needed = F.col("floor").isNull() | (F.col("remains") >= F.col("floor"))
    rest = known.where(~needed)
    most = rest.groupBy("query_article_id").agg(F.max("remains").alias("rest"))
    floors = known.groupBy("query_article_id").agg(F.max("floor").alias("floor")).join(most, "query_article_id", "left")
    found = partial_scores(known.where(needed), weights).join(floors, "query_article_id").where(
        F.col("floor").isNull() | (F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor")))
    return found.select("query_article_id", "article_id", "score"), rest.select("query_article_id", "term", "qw")


def similar_tfidf(weights: DataFrame, catalog: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """Top-n cosine neighbours of each query article (self excluded; unknown -> none).

    Exact, with term bounds (MaxScore): frequent terms of little weight only
    complete the scores of documents that can still enter a list (``survivors``),
    looked up in the document's own terms. Documents are never paired with each other.
    """
    found, rest = survivors(weights, queries, n)
    asked = rest.groupBy("query_article_id").agg(F.collect_list(F.struct("term", "qw")).alias("rest"))  # terms of one article
    found = found.join(asked, "query_article_id", "left")
    own = weights.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("own"))
    done = found.where(F.col("rest").isNull()).select("query_article_id", "article_id", "score")
    open_ = found.where(F.col("rest").isNotNull()).join(dealt(own), "article_id")
    added = F.aggregate(F.transform("rest", lambda x: x["qw"] * F.coalesce(F.try_element_at("own", x["term"]), F.lit(0.0))),
                        F.lit(0.0), lambda a, x: a + x)
    pairs = done.unionByName(open_.select("query_article_id", "article_id", (F.col("score") + added).alias("score")))
    top = _top_n(pairs, n)
    text = dealt(catalog.select("article_id", "item_text"))
    return (top.join(text, "article_id")
            .join(text.select(F.col("article_id").alias("query_article_id"), F.col("item_text").alias("query_item_text")),
                  "query_article_id")
            .select("query_article_id", "query_item_text", "rank", "score", "article_id", "item_text"))


def normalize_vectors(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """L2-normalise array vectors (a zero vector stays zero)."""
    v = F.transform(F.col(col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    # bound once: inside the lambda over the values the norm would be formed again for each of them
    both = F.transform(F.array(F.struct(v.alias("v"), norm.alias("norm"))), lambda s: F.when(
        s["norm"] > 0, F.transform(s["v"], lambda x: x / s["norm"])).otherwise(s["v"]))
    return vectors.withColumn(col, F.get(both, F.lit(0)))


def _by_vector(rows: DataFrame, key: str, col: str) -> DataFrame:
    """``rows`` with ``same``, a 128-bit hash of the vector: equal vectors are searched once."""
    return rows.select(F.col(key).alias("key"), F.col(col).alias("vec"),
                       F.struct(F.xxhash64(F.lit(0), col).alias("a"), F.xxhash64(F.lit(1), col).alias("b")).alias("same"))


def similar_embeddings(vectors: DataFrame, queries: DataFrame, n: int = 5, id_col: str = "vec_id",
                       col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact inner-product top-n over L2-normalised vectors, self excluded, by a metric index.

    Distinct vectors are indexed under their smallest id and searched once for
    n + 1 others (``vectorsearch``); a vector that a third of the rows share is one
    entry with its n + 1 smallest ids, all that any list can hold. Every query
    then takes the list of its vector, without itself.
    """
    def units(rows: DataFrame) -> DataFrame:  # written once, as several steps read them
        return stored(_by_vector(normalize_vectors(rows.select(id_col, col), col), id_col, col).where(F.col("vec").isNotNull()), "units")

    corpus = units(vectors)
    wanted = corpus if queries is vectors else units(queries)
    distinct = corpus.groupBy("same").agg(F.min("key").alias("id"), F.first("vec").alias("vec"))
    asked = wanted.groupBy("same").agg(F.min("key").alias("query_id"), F.first("vec").alias("vec"))
    top = top_products(build_index(distinct, block_rows=block_rows), asked, n + 1, digits=TIE_DIGITS).withColumnRenamed("id", "first")
    few = Window.partitionBy("same").orderBy("key")
    bearers = (corpus.select("same", "key").withColumn("place", F.row_number().over(few)).where(F.col("place") <= n + 1)
               .join(distinct.select("same", F.col("id").alias("first")), "same").select("first", F.col("key").alias("id")))
    listed = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", TIE_DIGITS)), F.asc("id"))
    lists = (top.join(bearers, "first").withColumn("place", F.row_number().over(listed)).where(F.col("place") <= n + 1)
             .select(F.col("query_id").alias("head"), "id", "score"))
    heads = wanted.select("same", F.col("key").alias("query_id")).join(
        asked.select("same", F.col("query_id").alias("head")), "same")
    others = heads.join(lists, "head").where(F.col("id") != F.col("query_id"))
    return others.withColumn("rank", F.row_number().over(listed).cast("long")).where(F.col("rank") <= n) \
        .select("query_id", "rank", "score", F.col("id").alias(id_col))


# Shares of equality that fuzzy names are searched for, one after the other, with the length of the grams.
TIERS = ((0.7, 2), (0.0, 1))  # the last goes down to the least score asked for


def _grams(text: Column, size: int) -> Column:
    """The grams of a text as an array of (gram, occurrence), so that equal arrays of grams are equal multisets."""
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))),
                        lambda i: F.substring(text, i, F.lit(size)))
    sorted_ = F.array_sort(chars)
    return F.when(F.length(text) >= size, sorted_).otherwise(F.array().cast("array<string>"))


def gram_rows(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, len, gram, nth): the ``size``-grams of every text, each with its number among equal ones."""
    grams = rows.select(key, F.length(text).alias("len"), F.explode(_grams(F.col(text), size)).alias("gram"))
    counted = grams.groupBy(key, "len", "gram").agg(F.count(F.lit(1)).cast("int").alias("times"))
    return counted.select(key, "len", "gram", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))


def least_shared(length: Column, share: float, size: int, measure: str) -> Column:
    """The least number of grams that a text of this length shares with any name of at least ``share``.

    Levenshtein: k <= (1 - share) * L edits change at most k * size of the
    L - size + 1 grams of the longer text. Sequence ratio 2 M / (m + n): the M
    matching characters are shared, and no text is shorter than share / (2 - share)
    of the other.
    """
    if measure == "sequence":
        return F.greatest(F.ceil(length * (share / (2 - share)) - 1e-9), F.lit(1))
    return F.greatest(F.ceil(length * (1 - size * (1 - share)) - (size - 1) - 1e-9), F.lit(1))


def fuzzy_pairs(asked: DataFrame, names: DataFrame, share: float, size: int, measure: str = "levenshtein") -> DataFrame:
    """Candidate pairs (q_id, n_id): every pair of at least ``share``, and few others.

    Texts that share at least t grams share one of the rarest (all but t - 1) of
    either; only these are joined, together with the bound on lengths.
    """
    names_rows, asked_rows = gram_rows(names, "n_id", "name_norm", size), gram_rows(asked, "q_id", "q", size)
    held = names_rows.groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("held"))

    def rarest(rows, key):
        by = Window.partitionBy(key).orderBy(F.coalesce("held", F.lit(0)), "gram", "nth")
        total = F.count(F.lit(1)).over(Window.partitionBy(key))
        placed = (rows.join(held, ["gram", "nth"], "left").withColumn("place", F.row_number().over(by)).withColumn("all", total))
        return placed.where((F.col("place") <= F.col("all") - least_shared(F.col("len"), share, size, measure) + 1) & F.col("held").isNotNull())

    least = share if measure == "levenshtein" else share / (2 - share)
    left = rarest(asked_rows, "q_id").select("gram", "nth", "q_id", F.col("len").alias("q_len"))
    right = rarest(names_rows, "n_id").select("gram", "nth", "n_id", F.col("len").alias("n_len"))
    near = F.least("q_len", "n_len") >= F.greatest("q_len", "n_len") * least - 1e-9
    return left.join(right, ["gram", "nth"]).where(near).select("q_id", "n_id").distinct()


def containing_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(q_id, n_id): the names that hold a query as it stands, found by its rarest trigram (or whole, if shorter)."""
    def windows(text, size):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))),
                                            lambda i: F.substring(text, i, F.lit(size))))

    lists = names.select("n_id", "name_norm", F.explode(F.array_distinct(F.flatten(F.array(
        *[windows(F.col("name_norm"), k) for k in (1, 2, 3)])))).alias("gram"))
    held = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    size = F.least(F.length("q"), F.lit(3))
    own = asked.where(F.col("q") != "").select("q_id", "q", F.explode(windows(F.col("q"), size)).alias("gram")).join(held, "gram", "left")
    by = Window.partitionBy("q_id").orderBy(F.coalesce("held", F.lit(0)), "gram")
    best = own.withColumn("place", F.row_number().over(by)).where((F.col("place") <= 1) & F.col("held").isNotNull())
    found = best.select("q_id", "q", "gram").join(lists, "gram").where(F.col("name_norm").contains(F.col("q")))
    return found.select("q_id", "n_id")


def _levenshtein_ratio(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, found longest first (difflib's ratio)."""
    out, matcher, of = [], SequenceMatcher(None), None
    for x, y in zip(a, b, strict=True):
        if y != of:
            matcher.set_seq2(y)
            of = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype=float)


def resolve_name(queries: DataFrame, items: DataFrame, min_score: float = 0.35, measure: str = "levenshtein") -> DataFrame:
    """Name -> article: exact (1.0), else contains, else fuzzy; below ``min_score`` -> no_match.

    ``measure`` is ``levenshtein`` (1 - distance / longer length) or ``sequence``
    (difflib's ratio). Ties go to the smallest article id. Exact names are found by
    equality, names that hold the query by its rarest trigram, similar ones by
    shared grams: first those of at least 0.7, and only for queries that have none
    those down to ``min_score``. Every tier holds all pairs of its share, so the
    best of the first tier that has any is the best of all. No query meets every
    name, nothing passes through the driver.
    """
    if measure not in ("levenshtein", "sequence"):
        raise ValueError("measure must be levenshtein or sequence")
    if min_score <= 0:
        raise ValueError("min_score must be positive")
    ratio = _levenshtein_ratio if measure == "levenshtein" else sequence_ratio
    named = items.select("article_id", "prod_name", F.lower(F.trim(F.coalesce("prod_name", F.lit("")))).alias("name_norm"))
    dict_ = stored(named.groupBy("name_norm").agg(F.min_by(F.struct("article_id", "prod_name"),
                                                           F.struct("article_id", "prod_name")).alias("x"))
                   .select("name_norm", "x.*").withColumn("n_id", F.monotonically_increasing_id()), "names")
    q = stored(queries.select("query_name").distinct().withColumn("q", F.lower(F.trim("query_name")))
               .withColumn("q_id", F.monotonically_increasing_id()), "asked")

    def best(pairs, tier):
        scored = (pairs.join(q.select("q_id", "q"), "q_id").join(dict_, "n_id")
                  .select("q_id", "article_id", "prod_name", ratio(F.col("q"), F.col("name_norm")).alias("score")))
        order = F.struct((-F.round("score", TIE_DIGITS)).alias("neg"), "article_id")
        return scored.groupBy("q_id").agg(F.min_by(F.struct("article_id", "prod_name", "score"), order).alias("b")).select(
            "q_id", F.lit(tier).alias("match_type"), "b.*")

    exact = q.join(dict_, q["q"] == dict_["name_norm"]).select(
        "q_id", F.lit("exact").alias("match_type"), "article_id", "prod_name", F.lit(1.0).alias("score"))
    found = stored(exact, "exact")
    rest = q.join(found, "q_id", "left_anti")
    found = found.unionByName(stored(best(containing_names(rest, dict_), "contains"), "contains"))
    # An empty query is contained in every name and like none: it gets the first article.
    first = dict_.agg(F.min(F.struct("article_id", "prod_name"))).scalar()
    found = found.unionByName(rest.where(F.col("q") == "").select("q_id", F.lit("contains").alias("match_type"), first["article_id"].alias("article_id"),
                                                                  first["prod_name"].alias("prod_name"), F.lit(0.0).alias("score")))
    for share, size in TIERS:
        share = max(share, min_score) if size > 1 else min_score
        rest = q.join(found, "q_id", "left_anti").where(F.length("q") > 2 * (size - 1))
        tier = best(fuzzy_pairs(rest, dict_, share, size if measure == "levenshtein" else 1, measure), "fuzzy")
        found = found.unionByName(stored(tier.where(F.round("score", TIE_DIGITS) >= share), "fuzzy"))
    return q.join(found, "q_id", "left").select(
        "query_name", "article_id", "prod_name", F.coalesce("match_type", F.lit("no_match")).alias("match_type"),
        F.coalesce("score", F.lit(0.0)).alias("name_match_score"))
