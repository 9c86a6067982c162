"""Text expressions shared by cleaning, TF-IDF and search (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c: Column | str) -> Column:
    """null -> '', lower-case, whitespace runs -> one space, trimmed.

    Spark's ``trim`` strips spaces only, so whitespace is collapsed to single
    spaces *first*; a leading tab therefore disappears too.
    """
    c = F.col(c) if isinstance(c, str) else c
    collapsed = F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", " ")
    return F.trim(collapsed)


def join_text(*cols: Column | str) -> Column:
    """Columns joined by one space, whitespace collapsed, trimmed."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " "))


def word_tokens(c: Column | str) -> Column:
    """Lower-cased runs of two or more Unicode word characters, in order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w{2,}"), 0)


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by adjacent bigrams ('a b'); ``tokens`` should be a column
    reference (an expression would be re-evaluated per element inside the lambda)."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, F.when(F.size(tokens) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def alpha_tokens(c: Column | str) -> Column:
    """Lower-cased runs of ASCII letters (catalog search tokens)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), 0)
