"""Dense positions are exact when the payload is read, whatever the planner does with partitions."""

import pytest
from pyspark.sql import functions as F

from tastebud.functions.index import dense_index


@pytest.mark.parametrize("rows", [200_000, 1_000_000])
def test_dense_index_with_payload(spark, rows):
    df = spark.range(rows).select(F.md5(F.col("id").cast("string")).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = dense_index(df, [F.col("key")], "pos")
    n, distinct, lo, hi, length = out.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.min(F.length("payload"))).first()
    assert (n, distinct, lo, hi, length) == (rows, rows, 0, rows - 1, 64)
    pairs = out.where("pos < 50").orderBy("pos").select("key").collect()
    assert [r[0] for r in pairs] == [r[0] for r in df.orderBy("key").limit(50).select("key").collect()]


def test_dense_index_of_empty_table(spark):
    assert dense_index(spark.range(0).withColumnRenamed("id", "key"), [F.col("key")]).count() == 0
