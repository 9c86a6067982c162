"""Catalog text search: every query token must name the product type or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastebud.functions.index import dealt
from tastebud.functions.text import alpha_tokens

# The search stop-word list (60 words), in the reference's order.
SEARCH_STOPWORDS = [
    "i", "me", "my", "want", "need", "find", "show", "give", "recommend",
    "a", "an", "the", "some", "please", "product", "products", "item", "items",
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "under", "below", "above", "over", "less", "than", "more", "budget",
    "price", "cheap", "expensive", "affordable", "max", "maximum",
    "up", "to", "within", "for", "with", "or", "and", "in", "at", "of",
    "is", "are", "have", "has", "can", "do", "not", "no",
]


def search_tokens(queries: DataFrame, col: str = "query") -> DataFrame:
    """(query_id, token) for tokens [a-z]+ longer than one letter and not stop words."""
    sw = F.array(*[F.lit(w) for w in SEARCH_STOPWORDS])
    toks = F.filter(alpha_tokens(col), lambda t: (F.length(t) > 1) & ~F.array_contains(sw, t))
    return queries.select("query_id", F.explode(F.array_distinct(toks)).alias("token"))


def search_catalog(queries: DataFrame, items: DataFrame, popularity: DataFrame, limit: int,
                   prices: DataFrame | None = None, budget_col: str | None = None) -> DataFrame:
    """Catalog products matching *all* tokens of each query, by popularity desc, id asc.

    A token matches when a word of the lower-cased "product_type_name
    product_group_name" equals it, its plural, or (for tokens > 3 letters ending
    in s) its singular, so tokens meet the words of the distinct taxonomy strings
    by equality. Queries with no usable token get no rows. Queries of the same
    tokens are matched once. A taxonomy's items are cut to the first ``limit`` of
    each price band before they meet the tokens, and a token set's to the first
    ``limit`` of each band: budgets take a band as a whole or leave it, so no later
    item can be among a query's first ``limit``.
    """
    said = (search_tokens(queries).where(F.col("query_id").isNotNull())
            .groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("tokens")))
    toks = said.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    tax = items.select("article_id", F.lower(F.concat_ws(" ", F.coalesce("product_type_name", F.lit("")),
                                                       F.coalesce("product_group_name", F.lit("")))).alias("taxonomy"))
    taxa = tax.select("taxonomy").distinct()
    words = taxa.select("taxonomy", F.explode(F.array_distinct(
        F.regexp_extract_all("taxonomy", F.lit(r"([\p{L}\p{N}_]+)")))).alias("word"))
    singular = F.when(F.col("token").endswith("s") & (F.length("token") > 3),
                      F.expr("substring(token, 1, length(token) - 1)")).otherwise(F.col("token"))
    forms = toks.select("token").distinct().select(
        "token", F.explode(F.array_distinct(F.array("token", F.concat("token", F.lit("s")), singular))).alias("word"))
    matched = forms.join(words, "word").select("token", "taxonomy").distinct()
    hits = (toks.join(matched, "token").groupBy("tokens", "taxonomy").agg(F.count(F.lit(1)).alias("n_hit"))
            .where(F.col("n_hit") == F.size("tokens")).select("tokens", "taxonomy"))
    scored = tax.join(dealt(popularity.select("article_id", "score"), "shuffle_hash"), "article_id", "left") \
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = F.desc("score"), F.asc("article_id")
    budgeted = prices is not None and budget_col is not None
    if budgeted:
        scored = price_bands(scored.join(dealt(prices, "shuffle_hash"), "article_id", "left")
                             .withColumn("price_k", F.coalesce("price_k", F.lit(0))), queries, budget_col)
    else:
        scored = scored.withColumn("_band", F.lit(None).cast("double"))

    def first(rows, key):
        by = Window.partitionBy(key, "_band").orderBy(*order)
        return rows.withColumn("_place", F.row_number().over(by)).where(F.col("_place") <= limit).drop("_place")

    offered = first(hits.join(first(scored, "taxonomy"), "taxonomy"), "tokens").drop("taxonomy", "_band")
    cands = said.join(offered, "tokens").drop("tokens")
    if budgeted:
        cands = (cands.join(queries.select("query_id", budget_col), "query_id")
                 .where(F.col(budget_col).isNull() | (F.col("price_k") <= F.col(budget_col))))
    w = Window.partitionBy("query_id").orderBy(*order)
    return (cands.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)
            .select("query_id", "rank", "article_id", "score"))


BANDS = 1000  # distinct budgets up to which prices are taken together


def price_bands(priced: DataFrame, queries: DataFrame, col: str) -> DataFrame:
    """Add ``_band``: the least budget asked that covers the price, null beyond all; the price itself where budgets are many."""
    own = queries.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("b")).distinct().limit(BANDS + 1)
    asked = own.agg(F.array_sort(F.collect_list("b")).alias("a")).scalar()
    within = F.array_min(F.filter("_asked", lambda b: b >= F.col("price_k")))
    return priced.withColumn("_asked", asked).withColumn(
        "_band", F.when(F.size("_asked") > BANDS, F.col("price_k").cast("double")).otherwise(within)).drop("_asked")


# Strategy, texts and signal of catalog answers.
SEARCH_STRATEGY = "catalog_text_search"
SEARCH_SIGNAL = "catalog_text_match"


def search_responses(queries: DataFrame, ranked: DataFrame, items: DataFrame, prices: DataFrame, budget_col: str | None = None) -> DataFrame:
    """The answer to every query with a usable token: its products with labels and reasons, or one row that says none matches.

    ``ranked`` is ``search_catalog``'s (query_id, rank, article_id, score). A
    repeated article speaks by its first name. Queries without a usable token get
    no answer.
    """
    said = F.regexp_replace(F.coalesce("query", F.lit("")), r"^\s+|\s+$", "")
    budget = F.col(budget_col).cast("double") if budget_col else F.lit(None).cast("double")
    asked = (queries.select("query_id", said.alias("said"), budget.alias("budget"))
             .join(search_tokens(queries).select("query_id").distinct(), "query_id", "left_semi"))
    product = F.struct(F.col("prod_name").alias("product_name"), F.col("product_group_name").alias("product_group"),
                       F.coalesce(F.nullif(F.col("item_text"), F.lit("")), F.col("detail_desc")).alias("description"), "image_path")
    named = items.groupBy("article_id").agg(F.min(product).alias("p")).select("article_id", "p.*")
    note = F.when(F.col("budget").isNotNull(), F.concat(F.lit(" under $"), F.col("budget").cast("long").cast("string"))).otherwise(F.lit(""))
    quoted = F.concat(F.lit("\u201c"), F.col("said"), F.lit("\u201d"))
    found = F.col("article_id").isNotNull()
    out = (asked.join(ranked, "query_id", "left").join(named, "article_id", "left").join(prices.select("article_id", "price_k"), "article_id", "left"))
    return out.select(
        "query_id", F.lit(SEARCH_STRATEGY).alias("strategy"),
        F.when(found, F.concat(F.lit("Popular catalog products matching "), quoted, note, F.lit(".")))
         .otherwise(F.concat(F.lit("No catalog product type matches "), quoted, F.lit("."))).alias("explanation"),
        "rank", "article_id", "score", "product_name", "product_group",
        F.when(F.col("price_k").isNotNull(), F.concat(F.lit("~$"), F.col("price_k").cast("string"))).alias("price_label"),
        "description", "image_path", F.when(found, F.concat(F.lit("Matches your request for "), quoted, F.lit("."))).alias("reason"),
        F.when(found, F.create_map(F.lit(SEARCH_SIGNAL), F.lit(1.0))).alias("signals"))
