"""Readers for raw tables: parquet with column pruning, CSV with required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Required raw columns of the three retail tables, in order.
REQUIRED_INTERACTION_COLUMNS = ["customer_id", "article_id", "t_dat", "price", "sales_channel_id"]
REQUIRED_ITEM_COLUMNS = [
    "article_id", "prod_name", "product_type_name", "product_group_name",
    "department_name", "section_name", "garment_group_name", "detail_desc",
]
REQUIRED_CUSTOMER_COLUMNS = ["customer_id", "FN", "Active", "club_member_status",
                             "fashion_news_frequency", "age"]
CATEGORY_COLUMNS = REQUIRED_ITEM_COLUMNS[1:]

# Raw CSVs are read with every column as text: ids keep leading zeros and bad
# numbers or dates are coerced later (``try_cast``), never raised at read time.


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def require_columns(df: DataFrame, columns: list[str], name: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns in {name}: {', '.join(missing)}")


def read_table(spark: SparkSession, path: str, required: list[str], name: str) -> DataFrame:
    """Read a headered CSV as text, check *all* required columns, project to them.

    The header of every file must name the columns of the first in its order;
    a file that doesn't ends the read with an error instead of shifted values.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    require_columns(df, required, name)
    return df.select(*required)


def read_interactions(df_or_path, spark: SparkSession | None = None,
                      want_recency: bool = False) -> tuple[DataFrame, bool]:
    """Chosen interaction columns with nulls dropped; ``event_ts`` only when asked and present."""
    df = spark.read.parquet(df_or_path) if isinstance(df_or_path, str) else df_or_path
    cols = ["customer_id", "article_id"]
    has_recency = want_recency and "event_ts" in df.columns
    if has_recency:
        cols.append("event_ts")
    return df.select(*cols).dropna(), has_recency


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
