from datetime import datetime

from pyspark.sql import functions as F

from tastebud.functions.text import normalize_text
from tastebud.operators import clean as C


def test_normalize_text(spark):
    df = spark.createDataFrame([("  Hello   World ",), (None,), ("",), ("\tTab\nLine",)], "t string")
    got = [r[0] for r in df.select(normalize_text("t")).collect()]
    assert got == ["hello world", "", "", "tab line"]


def test_clean_customers_median_and_status(spark):
    raw = spark.createDataFrame(
        [("A ", 1.0, None, "ACTIVE", "NONE", 20.0), ("b", None, 1.0, None, "x", None), ("c", None, None, " ", "y", 40.0)],
        "customer_id string, FN double, Active double, club_member_status string, fashion_news_frequency string, age double")
    out = {r.customer_id: r for r in C.clean_customers(raw).collect()}
    assert out["a"].club_member_status == "active"
    assert out["b"].club_member_status == "none" and out["c"].club_member_status == "none"
    assert out["b"].age == 30.0  # median of the whole raw table


def test_split_and_drop_counters(spark):
    items = spark.createDataFrame([("a1", "x"), ("a2", "y")], "article_id string, item_text string")
    rows = [
        ("u1", "a1", "2024-06-25", "5.0", "1"),   # test (week 4 of the last month)
        ("u1", "a1", "2024-06-25", "5.0", "1"),   # duplicate kept
        ("u2", "a2", "2024-06-16", "4.0", "2"),   # val
        ("u3", "a1", "2024-03-02", "3.0", "2"),   # train (earlier month)
        ("u4", "a1", "2024-06-03", "-1.0", "1"),  # train window, invalid price
        ("u5", "zz", "2024-06-04", "2.0", "1"),   # orphan
        ("u6", "a2", "2024-06-30", "2.0", "1"),   # day 30: no split
        ("u7", "a1", "2023-12-01", "2.0", "1"),   # month 0: outside the window
    ]
    raw = spark.createDataFrame(rows, "customer_id string, article_id string, t_dat string, price string, sales_channel_id string")
    lab = C.labelled_interactions(raw, items)
    kept = C.kept_interactions(lab)
    counts = {r.split: r["count"] for r in kept.groupBy("split").count().collect()}
    assert counts == {"test": 2, "val": 1, "train": 1}
    drops = {(r.split, r.reject_reason): r.n_rows for r in C.reject_counts(lab).collect()}
    assert drops == {("train", "invalid_price"): 1, ("train", "orphan"): 1}


def test_id_maps_use_training_only(spark):
    train = spark.createDataFrame([("u2", "b"), ("u1", "a")], "customer_id string, article_id string")
    val = spark.createDataFrame([("u3", "a"), ("u1", "c")], "customer_id string, article_id string")
    u, i = C.build_id_maps(train)
    assert sorted((r.customer_id, r.user_idx) for r in u.collect()) == [("u1", 0), ("u2", 1)]
    m = {(r.customer_id, r.article_id): (r.user_idx, r.item_idx) for r in C.apply_id_maps(val, u, i).collect()}
    assert m[("u3", "a")] == (None, 0) and m[("u1", "c")] == (0, None)


def test_temporal_split_timestamp_input(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 15, 3), ), (datetime(2024, 1, 29),)], "event_ts timestamp_ntz")
    got = [r.split for r in C.label_split(df).orderBy("event_ts").collect()]
    assert got == ["val", None]


def test_image_priority(spark):
    items = spark.createDataFrame([("12",), ("7",)], "article_id string")
    listing = spark.createDataFrame([("images/12/12.png",), ("images/000/0000000012.jpg",), ("images/7/7.jpg",)], "path string")
    got = {r.article_id: r.image_path for r in C.resolve_image_path(items, listing).collect()}
    assert got == {"12": "images/12/12.png", "7": "images/7/7.jpg"}
    assert F is not None


def test_dense_index_across_partitions(spark):
    import random
    from tastebud.functions.index import dense_index
    keys = [f"k{i:04d}" for i in range(997)]
    random.Random(3).shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(7)
    got = sorted((r.idx, r.key) for r in dense_index(df, [F.col("key")], "idx", start=1).collect())
    assert got == [(i + 1, k) for i, k in enumerate(sorted(keys))]


def test_sample_users_stable_under_repartition(spark):
    from tastebud.operators.sample import sample_users
    truth = spark.createDataFrame([(f"u{i}", "a") for i in range(200)], "customer_id string, article_id string")
    a = sorted(r[0] for r in sample_users(truth, 25, 42).collect())
    b = sorted(r[0] for r in sample_users(truth.repartition(11), 25, 42).collect())
    assert a == b and len(a) == 25


def _raw(spark, day):
    tx = spark.createDataFrame([(f"u{i}", f"a{i % 4}", datetime(2024, 6, 1 + i % day), float(i), 1) for i in range(60)],
                               "customer_id string, article_id string, t_dat timestamp, price double, sales_channel_id int")
    from tastebud.sources.tables import CATEGORY_COLUMNS
    items = spark.createDataFrame([(f"a{i}", *["x"] * len(CATEGORY_COLUMNS)) for i in range(5)],
                                  ", ".join(f"{c} string" for c in ("article_id", *CATEGORY_COLUMNS)))
    people = spark.createDataFrame([("u1", 1.0, None, "ACTIVE", "NONE", 20.0)],
                                   "customer_id string, FN double, Active double, club_member_status string, fashion_news_frequency string, age double")
    return tx, items, people


def test_a_run_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    import pytest
    from tastebud.plans import preprocess as S
    from tastebud.sources import versions as V
    base = str(tmp_path / "store")
    assert S.run_preprocess(spark, *_raw(spark, 28), base) and not S.run_preprocess(spark, *_raw(spark, 28), base)
    first = V.current(spark, base)
    before = sorted(map(tuple, S.read_processed(spark, base, "interactions_clean").select("customer_id", "article_id", "split").collect()))
    tables = iter(range(100))
    real = S.write_table

    def dies(df, path, **kw):
        if next(tables) == 4:
            raise RuntimeError("killed")
        real(df, path, **kw)

    monkeypatch.setattr(S, "write_table", dies)
    with pytest.raises(RuntimeError):
        S.run_preprocess(spark, *_raw(spark, 14), base, force=True)
    monkeypatch.setattr(S, "write_table", real)
    assert V.current(spark, base) == first and S.is_ready(spark, base)
    assert before == sorted(map(tuple, S.read_processed(spark, base, "interactions_clean").select("customer_id", "article_id", "split").collect()))
    assert S.run_preprocess(spark, *_raw(spark, 14), base, force=True)
    assert V.current(spark, base) != first and S.read_processed(spark, base, "interactions_val").count() == 0
    summary = S.read_processed(spark, base, "preprocess_summary").first()
    assert summary.interactions_raw_rows == 60 and summary.interactions_dropped_invalid_price == 1
    assert summary.interactions_clean_rows == summary.interactions_train_rows == 59


def test_versions_expire_and_need_all_tables(spark, tmp_path):
    import pytest
    from tastebud.sources import versions as V
    base = str(tmp_path / "v")
    assert V.current(spark, base) is None and V.manifest(spark, base) is None
    names = []
    for i in range(4):
        names.append(V.new_version(base))
        spark.range(i).write.parquet(f"{V.folder(base, names[-1])}/t")
        V.publish(spark, base, names[-1], ["t"])
    assert V.published(spark, base) == names[-2:] and V.current(spark, base) == V.folder(base, names[-1])
    assert [tuple(r) for r in V.manifest(spark, base).collect()] == [(names[-1], "t")]
    half = V.new_version(base)
    spark.range(1).write.parquet(f"{V.folder(base, half)}/t")
    with pytest.raises(ValueError):
        V.publish(spark, base, half, ["t", "u"])
    assert V.current(spark, base) == V.folder(base, names[-1])
    assert V.expire(spark, base, keep=1) == [names[-2]]  # the unfinished one is recent


def test_window_of_split_rows():
    assert C.split_window(datetime(2024, 6, 30, 5)) == (datetime(2024, 1, 1), datetime(2024, 6, 29))
    assert C.split_window(datetime(2023, 2, 28)) == (datetime(2022, 9, 1), datetime(2023, 3, 1))
    assert C.split_window(datetime(2024, 12, 1)) == (datetime(2024, 7, 1), datetime(2024, 12, 29))


def test_windowed_rows_are_the_labelled_rows_with_a_split(spark):
    tx, items, _ = _raw(spark, 30)
    old = tx.limit(5).withColumn("t_dat", F.lit(datetime(2023, 12, 31)))
    for kind in ("timestamp", "timestamp_ntz", "date", "string"):
        raw = tx.union(old).withColumn("t_dat", F.col("t_dat").cast(kind))
        n, anchor = C.split_anchor(raw)
        clean = C.clean_items(items)
        got = sorted(map(str, C.windowed_interactions(raw, clean, anchor).collect()))
        want = sorted(map(str, C.labelled_interactions(raw, clean).where("split is not null").collect()))
        assert n == 65 and got == want and len(got) == 56
    assert C.split_anchor(tx.limit(0)) == (0, None)
    assert C.windowed_interactions(tx.limit(0), C.clean_items(items), None).count() == 0


def test_no_order_row_is_left_out(spark):
    from tastebud.sources import adapters as A
    sf = "/root/testdata/sf0.001"
    raw = A.order_transactions(spark, sf)
    last = raw.agg(F.max("t_dat").alias("d"), F.last_day(F.max("t_dat")).alias("l")).first()
    assert str(last.d)[:10] == str(last.l)[:10]
    assert raw.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    splits = {r.split: r["count"] for r in C.label_split(C.coerce_interactions(raw)).groupBy("split").count().collect()}
    assert splits["val"] and splits["test"] and splits["train"]


def test_catalog_and_customers_are_cleaned_in_tasks_by_rows(spark, tmp_path, monkeypatch):
    """Small files of many rows: their text isn't cleaned by the one task that reads them."""
    from tastebud.functions import index as I
    from tastebud.plans import preprocess as S
    tx, items, people = (df.coalesce(1) for df in _raw(spark, 28))
    want = [sorted(map(str, c(df).collect())) for c, df in ((C.clean_items, items), (C.clean_customers, people))]
    monkeypatch.setattr(I, "SPREAD_ROWS", 2)
    base = str(tmp_path / "store")
    S.run_preprocess(spark, tx, items, people, base)
    for name, rows, files in (("items_clean", want[0], 3), ("customers_clean", want[1], 1)):
        got = S.read_processed(spark, base, name)
        assert sorted(map(str, got.collect())) == rows
        assert got.select(F.input_file_name()).distinct().count() == files


def test_order_lines_meet_orders_without_a_sort(spark, tmp_path):
    from tastebud.sources import adapters as A
    sf = str(tmp_path)
    day = "TIMESTAMP'2024-03-0{} 00:00:00'"
    orders = " union all ".join(f"select {k} o_orderkey, {c} o_custkey, {day.format(d)} o_orderdate"
                                for k, c, d in ((1, 7, 1), (2, 8, 2), (2, 9, 3), ("cast(null as int)", 5, 4), (4, 6, 5)))
    lines = " union all ".join(f"select {k} l_orderkey, {p} l_partkey, 6.0D l_extendedprice, 2.0D l_quantity, 'O' l_linestatus"
                               for k, p in ((1, 1), (1, 1), (2, 3), ("cast(null as int)", 4), (5, 5)))
    spark.sql(orders).write.parquet(f"{sf}/orders.parquet")
    spark.sql(lines).write.parquet(f"{sf}/lineitem.parquet")
    raw = A.order_transactions(spark, sf)
    got = sorted((r.customer_id, r.article_id, r.price) for r in raw.collect())
    assert got == [("7", "1", 3.0), ("7", "1", 3.0), ("8", "3", 3.0), ("9", "3", 3.0)]
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
