"""Cleaning, temporal split, reject reasons and dense id maps."""

from __future__ import annotations

from calendar import monthrange
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastebud.functions.index import dealt, dense_index, spread
from tastebud.functions.text import join_text, normalize_text
from tastebud.sources.tables import CATEGORY_COLUMNS

SPLITS = ("train", "val", "test")


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing whitespace of any kind (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def coerce_interactions(raw: DataFrame) -> DataFrame:
    """Typed interactions; a bad number or date becomes null, never an error."""
    t = raw.schema["t_dat"].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        ts = F.col("t_dat").cast("timestamp_ntz")
    else:
        ts = F.col("t_dat").cast("string").try_cast("timestamp_ntz")  # wall clock, no session zone
    return raw.select(
        normalize_text("customer_id").alias("customer_id"),
        strip_ws(F.col("article_id")).alias("article_id"),
        F.col("t_dat"),
        F.col("price").try_cast("double").alias("price"),
        F.col("sales_channel_id").try_cast("bigint").alias("sales_channel_id"),
        F.date_format(ts, "yyyy-MM-dd").alias("event_date"),
        ts.alias("event_ts"),
    )


def label_split(df: DataFrame, anchor: Column | None = None) -> DataFrame:
    """Add ``month_number``, ``week_of_month`` and ``split`` (train/val/test/null).

    The latest month over *all* parsed rows is month 6; train = months 1-5 plus
    weeks 1-2 of month 6, val = week 3, test = week 4; days 29-31 of month 6
    belong to no split. The maximum is a scalar subquery, evaluated once, unless
    ``anchor`` gives it.
    """
    mx = anchor if anchor is not None else df.select(F.max("event_ts")).scalar()
    ts = F.col("event_ts")
    month_number = F.lit(6) - ((F.year(mx) - F.year(ts)) * 12 + (F.month(mx) - F.month(ts)))
    week = F.floor((F.dayofmonth(ts) - 1) / 7).cast("int") + 1
    out = df.withColumn("month_number", month_number).withColumn("week_of_month", week)
    m, w = F.col("month_number"), F.col("week_of_month")
    split = (F.when(m.between(1, 5) | ((m == 6) & (w <= 2)), F.lit("train"))
             .when((m == 6) & (w == 3), F.lit("val"))
             .when((m == 6) & (w == 4), F.lit("test")))
    return out.withColumn("split", split)


def reject_reason(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """First failing check wins: missing -> invalid_price -> orphan; null = kept.

    The catalog's ids meet the rows by a shuffle at every size (``dealt``).
    """
    known = catalog.select(F.col("article_id").alias("_aid")).where(F.col("_aid").isNotNull()).distinct() \
        .withColumn("_known", F.lit(True))
    j = df.join(dealt(known, "shuffle_hash"), df.article_id == known._aid, "left")
    missing = (F.col("customer_id").isNull() | F.col("article_id").isNull() | F.col("event_ts").isNull()
               | F.col("price").isNull() | (F.col("customer_id") == "") | (F.col("article_id") == ""))
    reason = (F.when(missing, F.lit("missing"))
              .when(F.col("price") <= 0, F.lit("invalid_price"))
              .when(F.col("_known").isNull(), F.lit("orphan")))
    return j.withColumn("reject_reason", reason).drop("_aid", "_known")


def labelled_interactions(raw: DataFrame, catalog: DataFrame, anchor: Column | None = None) -> DataFrame:
    """coerce -> split label -> reject reason, in one plan (cache this once)."""
    return reject_reason(label_split(coerce_interactions(raw), anchor), catalog)


def split_anchor(raw: DataFrame) -> tuple[int, datetime | None]:
    """Rows of the raw log and its latest parsed date: one aggregate that reads the date column alone."""
    dates = coerce_interactions(raw.select("t_dat", *[F.lit(None).cast("string").alias(c) for c in
                                                      ("customer_id", "article_id", "price", "sales_channel_id")]))
    row = dates.agg(F.count(F.lit(1)).alias("n"), F.max("event_ts").alias("mx")).first()
    return row["n"], row["mx"]


def split_window(anchor: datetime) -> tuple[datetime, datetime]:
    """First moment of month 1 and first moment after day 28 of month 6: rows outside have no split."""
    first = anchor.year * 12 + anchor.month - 1 - 5
    return datetime(first // 12, first % 12 + 1, 1), datetime(anchor.year, anchor.month, 29) if _has_29(anchor) else datetime(
        (anchor.year * 12 + anchor.month) // 12, anchor.month % 12 + 1, 1)


def _has_29(day: datetime) -> bool:
    return monthrange(day.year, day.month)[1] >= 29


def in_window(raw: DataFrame, anchor: datetime) -> DataFrame:
    """Raw rows that can have a split. The literal range on a typed date column reaches the scan."""
    kind = raw.schema["t_dat"].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return raw  # text dates are parsed row by row
    start, end = (F.to_timestamp_ntz(F.lit(str(x))).cast(kind) for x in split_window(anchor))
    return raw.where((F.col("t_dat") >= start) & (F.col("t_dat") < end))


def windowed_interactions(raw: DataFrame, catalog: DataFrame, anchor: datetime | None) -> DataFrame:
    """``labelled_interactions`` of the rows with a split alone, read by a pushed date range."""
    if anchor is None:
        return labelled_interactions(raw, catalog).where(F.col("split").isNotNull())
    at = F.to_timestamp_ntz(F.lit(str(anchor)))
    return labelled_interactions(in_window(raw, anchor), catalog, at).where(F.col("split").isNotNull())


def kept_interactions(labelled: DataFrame, split: str | None = None) -> DataFrame:
    out = labelled.where(F.col("split").isNotNull() & F.col("reject_reason").isNull())
    if split is not None:
        out = out.where(F.col("split") == split)
    return out.drop("reject_reason", "month_number", "week_of_month")


def reject_counts(labelled: DataFrame) -> DataFrame:
    """Rows dropped per (split, reason); counters cover in-window rows only."""
    return (labelled.where(F.col("split").isNotNull() & F.col("reject_reason").isNotNull())
            .groupBy("split", "reject_reason").agg(F.count(F.lit(1)).alias("n_rows")))


def clean_items(raw_items: DataFrame, listing: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Strip ids, drop blank ids, normalise text, resolve images, build ``item_text``.

    Duplicate ids are *kept*, as in the reference. Where the number of ``rows`` is
    given they are spread over tasks of their own.
    """
    aid = strip_ws(F.col("article_id"))
    out = spread(raw_items, rows).withColumn("article_id", aid).where(F.col("article_id").isNotNull() & (F.col("article_id") != ""))
    out = out.select("article_id", *[normalize_text(c).alias(c) for c in CATEGORY_COLUMNS])
    if listing is not None:
        out = resolve_image_path(out, listing)
    else:
        out = out.withColumn("image_path", F.lit(None).cast("string"))
    return (out.withColumn("has_image", F.col("image_path").isNotNull())
            .withColumn("item_text", join_text(*CATEGORY_COLUMNS)))


def resolve_image_path(items: DataFrame, listing: DataFrame) -> DataFrame:
    """Prefer the id as is, then zero-padded to 10; ``.jpg`` before ``.png``.

    A listed path names the one id that it can belong to, so the listing becomes
    one narrow row per id and an item looks up its two forms: no candidate paths
    are made, sorted or grouped.
    """
    aid = F.col("article_id")

    def path(c: Column, ext: str | Column) -> Column:
        return F.concat(F.lit("images/"), F.substring(c, 1, 3), F.lit("/"), c, F.lit(ext) if isinstance(ext, str) else ext)

    # Between "images/" and the ending: up to three first characters of the id, a slash, the id.
    size = F.length("path") - len("images/") - 4
    name = F.when(size >= 7, size - 4).otherwise(F.floor((size - 1) / 2)).cast("int")
    known = (listing.select("path", F.substring(F.col("path"), F.length("path") - 3 - name, name).alias("_id"), F.right("path", F.lit(4)).alias("_ext"))
             .where(F.col("_ext").isin(".jpg", ".png") & (F.col("path") == path(F.col("_id"), F.col("_ext"))))
             .groupBy("_id").agg(F.min("_ext").alias("_ext")))
    plain = known.select(F.col("_id").alias("_plain"), F.col("_ext").alias("_plain_ext"))
    padded = known.select(F.col("_id").alias("_padded"), F.col("_ext").alias("_padded_ext"))
    out = (items.join(dealt(plain), aid == F.col("_plain"), "left")
           .join(dealt(padded), F.when(F.length(aid) < 10, F.lpad(aid, 10, "0")) == F.col("_padded"), "left"))
    return out.select(*items.columns, F.coalesce(path(F.col("_plain"), F.col("_plain_ext")),
                                                 path(F.col("_padded"), F.col("_padded_ext"))).alias("image_path"))


def clean_customers(raw_customers: DataFrame, rows: int | None = None) -> DataFrame:
    """Normalise ids; null age -> median over the whole raw table; '' status -> 'none'. ``rows`` as for ``clean_items``."""
    med = raw_customers.select(F.median(F.col("age").cast("double"))).scalar()
    status = normalize_text("club_member_status")
    return spread(raw_customers, rows).select(
        normalize_text("customer_id").alias("customer_id"),
        F.col("FN").cast("double").alias("FN"),
        F.col("Active").cast("double").alias("Active"),
        F.when(status == "", F.lit("none")).otherwise(status).alias("club_member_status"),
        F.col("fashion_news_frequency"),
        F.coalesce(F.col("age").cast("double"), med).alias("age"),
    )


def build_id_maps(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense 0-based indices over sorted distinct ids of the *training* rows only."""
    users = dense_index(train.select("customer_id").distinct(), [F.col("customer_id")], "user_idx")
    items = dense_index(train.select("article_id").distinct(), [F.col("article_id")], "item_idx")
    return users, items


def apply_id_maps(df: DataFrame, user_map: DataFrame, item_map: DataFrame) -> DataFrame:
    """Left joins; ids unseen in training get null indices."""
    return df.join(user_map, "customer_id", "left").join(item_map, "article_id", "left")
