"""TF-IDF over catalog text as long (article_id, term, weight) tables.

Formulas follow the usual smoothed definition: idf = ln((1 + N) / (1 + df)) + 1,
tf raw or sublinear (1 + ln tf), rows L2-normalised. Everything is a join or
aggregate; the vocabulary cap (``max_features``) is the only ordered limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastebud.functions.index import FEW_ROWS, dealt
from tastebud.functions.text import with_bigrams, word_tokens
from tastebud.session import stored


def catalog_prepare(items: DataFrame, candidates: DataFrame | None = None, min_items: int = 2) -> DataFrame:
    """Drop null ids, null text -> '', one row per article, optional candidate filter.

    The reference keeps the first row per id in file order; here the first
    row by (item_text) order, a deterministic stand-in.
    """
    cat = (items.where(F.col("article_id").isNotNull())
           .select(F.col("article_id").cast("string"), F.coalesce(F.col("item_text").cast("string"), F.lit("")).alias("item_text"))
           .groupBy("article_id").agg(F.min("item_text").alias("item_text")))
    if candidates is not None:
        cat = cat.join(dealt(candidates.select("article_id").distinct(), "shuffle_hash"), "article_id", "left_semi")
    return cat


# Spark ML's default English stop words (StopWordsRemover), in its order.
# Only entries of two or more word characters can ever equal a token.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd",
    "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've", "you've", "they've",
    "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's",
    "let's", "ought", "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
]


def stop_words() -> list[str]:
    return list(ENGLISH_STOP_WORDS)


def doc_terms(catalog: DataFrame, ngrams: bool = True, stop: list[str] | None = None, unique: bool = False) -> DataFrame:
    """(article_id, term, tf): unigrams (+ adjacent bigrams) counted per document.

    Stop words are removed *before* bigrams are formed. Terms are counted within
    their row, so no term of a document is shuffled. Rows that share an id (or have
    none) are one document: those alone are added up by key. ``unique`` says that
    there are none.
    """
    if unique:
        return _row_terms(catalog, ngrams, stop)
    ids = catalog.groupBy(F.col("article_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    shared = stored(ids.where(F.col("_n") > 1).select("_id"), "shared")
    n = shared.count()
    if not n:
        return _row_terms(catalog, ngrams, stop)
    shared = F.broadcast(shared) if n <= FEW_ROWS else shared.hint("shuffle_hash")
    same = F.col("article_id").eqNullSafe(F.col("_id"))
    summed = (_row_terms(catalog.join(shared, same, "left_semi"), ngrams, stop)
              .groupBy("article_id", "term").agg(F.sum("tf").alias("tf")))
    return _row_terms(catalog.join(shared, same, "left_anti"), ngrams, stop).unionByName(summed)


def _row_terms(rows: DataFrame, ngrams: bool, stop: list[str] | None) -> DataFrame:
    """(article_id, term, tf) of every row by itself: its terms in order, counted by the distance between first places."""
    toks = word_tokens("item_text")
    if stop:
        sw = F.array(*[F.lit(w) for w in stop])
        toks = F.filter(toks, lambda t: ~F.array_contains(sw, t))
    tokd = rows.select("article_id", toks.alias("_t"))  # tokenise once per document
    terms = with_bigrams(F.col("_t")) if ngrams else F.col("_t")
    listed = tokd.select("article_id", F.sort_array(terms).alias("_s"))
    place = F.when(F.size("_s") > 0, F.sequence(F.lit(1), F.size("_s")))
    first = F.filter(place, lambda i: (i == 1) | (F.get(F.col("_s"), i - 1) != F.get(F.col("_s"), i - 2)))
    firsts = listed.select("article_id", "_s", first.alias("_f"))
    counted = F.transform("_f", lambda i, j: F.struct(
        F.get(F.col("_s"), i - 1).alias("term"),
        (F.coalesce(F.get(F.col("_f"), j + 1), F.size("_s") + 1) - i).cast("long").alias("tf")))
    return firsts.select("article_id", F.inline(counted))


def vocabulary(terms: DataFrame, max_features: int) -> DataFrame:
    """Top ``max_features`` terms by corpus count; ties by term (total order)."""
    if max_features <= 0:
        raise ValueError("max_features must be positive")
    totals = terms.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    return totals.orderBy(F.desc("total"), F.asc("term")).limit(max_features)


def tfidf(catalog: DataFrame, max_features: int = 20_000, sublinear: bool = True, ngrams: bool = True,
          stop: list[str] | None = None, unique: bool = False) -> DataFrame:
    """(article_id, term, weight) with L2-normalised rows; ``unique`` as for ``doc_terms``.

    The vocabulary is at most ``max_features`` rows, so it is broadcast
    behind that fixed bound; documents stay partitioned.
    """
    terms = doc_terms(catalog, ngrams, stop, unique)
    n_docs = catalog.select(F.count(F.lit(1))).scalar()
    vocab = vocabulary(terms, max_features)
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    tf = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) if sublinear else F.col("tf").cast("double")
    w = terms.join(F.broadcast(vocab.select("term", "df")), "term").select("article_id", "term", (tf * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("article_id")))
    return w.select("article_id", "term", (F.col("w") / norm).alias("weight"))
