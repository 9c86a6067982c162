"""Decontamination, quality, near duplicates and the pipeline against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tastebud.llm import decontam, neardup, quality
from tastebud.llm.common import materialise
from tastebud.llm.queries import op6_decontaminate, op7_quality

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_wu_manber_equals_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        patterns = list({"".join(rng.choices("ab ", k=rng.randint(1, 90 if rng.random() < 0.2 else 9))).encode() for _ in range(rng.randint(1, 12))})
        data = "".join(rng.choices("ab ", k=rng.randint(0, 300))).encode()
        data += rng.choice(patterns) + data[:5]
        want = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(data)) if data.startswith(p, i))
        assert sorted(decontam.WuManber(patterns, block=rng.randint(1, 8)).find(data)) == want


def _fold(t):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("most", [decontam.MAX_PATTERN_BYTES, 400])
def test_hits_equal_brute_force(spark, documents, odd, most):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choices(["A", "b,", "c1", "é"], k=n))
    items = [(i, say(rng.randint(0, 25))) for i in range(12)] + [(3, "A b"), (50, None), (51, ""), (52, "word word word")]
    rows = [*odd, *((100 + i, say(rng.randint(0, 120))) for i in range(40)), (200, "X " + items[0][1] + "\n- y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.with_hits(documents(rows).withColumn("n", F.monotonically_increasing_id()), bench, out="found", max_pattern_bytes=most).collect()
    assert len(out) == len(rows)
    windows = {}
    for i, t in items:
        w = _fold(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    for r in out:
        w, hit, names = _fold(r["text"]), set(), set()
        for win, ids in windows.items() if len(w) < 1000 else ():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    names |= ids
        if len(w) >= 1000:  # the long text of one word again and again
            hit, names = set(range(len(w))), {"52"}
        got = r["found"]
        assert got["n_words"] == len(w) and got["items"] == sorted(names)
        assert {k for s in got["spans"] for k in range(s["start"], s["end"])} == hit
    assert all(r["f"]["items"] == [] for r in decontam.with_hits(documents(odd), bench.limit(0), out="f").collect())


def test_quality_on_held_out_labels(spark):
    rows = op7_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = {r["quality"]: r["kept"] for r in rows.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert seen[1] > 0.97 and seen[0] < 0.2
    accepted, sampled = rows.where("kept").count(), rows.where("sampled").count()
    assert sampled == accepted // 2 and rows.where("sampled and not kept").count() == 0
    assert rows.where("sampled").agg(F.min("gumbel_key")).first()[0] > rows.where("kept and not sampled").agg(F.max("gumbel_key")).first()[0]


def test_quality_odd_rows_and_missing_labels(spark, documents, odd):
    good = [(1000 + i, " ".join(random.Random(i).choices("the of and word text line".split(), k=40))) for i in range(60)]
    bad = [(2000 + i, "!! $$$ %%% " * (10 + i)) for i in range(60)]
    docs = documents(odd + good + bad)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(1000, 1), (None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    kept = {r["doc_id"]: r["k"] for r in docs.select("doc_id", model.accepts(model.scored(F.col("text"))).alias("k")).where("doc_id is not null").collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in bad) and kept[1] and kept[2]
    for none in (labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        assert docs.where(quality.fit(docs, none).accepts(quality.fit(docs, none).scored(F.col("text")))).count() == docs.count()


def test_kth_largest_with_ties(spark):
    rng = random.Random(3)
    for _ in range(6):
        values = [rng.choice([rng.gauss(0, 1), 1.0, 1e300, -5.0, 1.0 + 1e-15]) for _ in range(300)]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for k in (1, 7, 150, 299, 300, 400):
            assert quality.kth_largest(df, "v", k, bins=4) == sorted(values, reverse=True)[min(k, 300) - 1]
        assert quality.kth_largest(df, "v", 0) is None
    assert quality.kth_largest(df.limit(0), "v", 3) is None


def _brute_components(rows, size):
    def lower(t):
        return [w for w in re.split("[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]

    sets = []
    for _, t in rows:
        w = lower(t)
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    name = list(range(len(rows)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                name[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)))


def _copies(rng, vocabulary, n, length, most):
    base = rng.choices(vocabulary, k=length)
    out = [" ".join(base)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(length)] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, documents, odd, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)]
    for n, length, most in ((60, 80, 14), (40, 60, 8), (6, 30, 3), (5, 9, 1)):
        texts += _copies(rng, vocabulary, n, length, most)
    texts += [texts[3], texts[70].upper(), texts[70], "w1 w2", "w1  w2\n", "w1"]
    rows = list(enumerate(rng.sample(texts, len(texts)), start=100)) + odd
    got = neardup.near_duplicates(documents(rows), size=size).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == _brute_components(rows, size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_empty_table(spark, documents):
    assert neardup.near_duplicates(documents([])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(f"n{i:03}".encode(), f"n{i + 1:03}".encode()) for i in range(60)] + [(b"s0", f"s{i:03}".encode()) for i in range(1, 80)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")
    out = {bytes(r["node"]): bytes(r["comp"]) for r in neardup.components(spark, df).collect()}
    assert all(out[n] == b"n000" for n in out if n.startswith(b"n")) and len({c for n, c in out.items() if n.startswith(b"s")}) == 1
    assert len(out) == 61 + 80


def test_estimate_is_corrected_for_chance(spark):
    import numpy as np
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = []
    for common in (0, 300, 800, 1000):
        b = np.unique(np.concatenate([a[:common], np.arange(5001, 6001 - common, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)]))
        x, y = neardup.sketch(a)[2].tolist(), neardup.sketch(b)[2].tolist()
        rows.append((common / (2000 - common), *x, *y))
    names = ["want", *(f"x{i}" for i in range(8)), *(f"y{i}" for i in range(8))]
    df = spark.createDataFrame(rows, names)
    df = df.select("want", F.struct(*[F.col(f"x{i}").alias(s) for i, s in enumerate(neardup.SIGNATURE)]).alias("x"),
                   F.struct(*[F.col(f"y{i}").alias(s) for i, s in enumerate(neardup.SIGNATURE)]).alias("y"))
    for r in df.select("want", neardup.estimate("x", "y").alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"], abs=0.15)


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Clashing names, nulls and a repeated row.
    extra = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    now = docs.unionByName(docs.where("doc_id = 5")).unionByName(extra)
    for c in ("hits", "spans", "base", "decided_id", "digest", "main"):
        now = now.withColumn(c, F.lit(1))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == columns
        now = materialise(spark, out, name)
    assert now.where("doc_id = 5").count() <= 1
    leaked = {r["doc_id"] for r in op6_decontaminate(spark, SF).where("contaminated").collect()}
    left = {r["doc_id"] for r in now.collect()}
    assert not leaked & left
    assert now.where(F.col("text").rlike("[0-9a-f]{24,}")).count() == 0
    assert now.where(F.length("text") != F.col("n_chars")).count() == 0


def test_pipeline_run_on_the_small_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_near_duplicates_of_rows_that_share_an_id(spark, documents):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(30):  # two copies with a null id or one of two ids beside the one that names the component
        a, b, c = _copies(rng, vocabulary, 2, 60, 3)
        rows += [(100 + i, a), (None, b), (1000 + i % 2, c)]
    rng.shuffle(rows)
    got = neardup.near_duplicates(documents(rows), size=2).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == _brute_components(rows, 2)


@pytest.mark.parametrize("repeats", [1, 4])
def test_second_round_with_repeated_rows(spark, documents, monkeypatch, repeats):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for n, length, most in ((60, 80, 14), (40, 60, 8), (60, 50, 9)):
        texts += _copies(rng, vocabulary, n, length, most)
    rows = list(enumerate(texts, start=100)) * repeats
    seen = []

    def watched(beside, *args):
        seen.append(beside.groupBy("main", "digest").count().where("count > 1").count())
        return possible_pairs(beside, *args)

    possible_pairs = neardup.possible_pairs
    monkeypatch.setattr(neardup, "possible_pairs", watched)
    got = neardup.near_duplicates(documents(rows), size=2).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == _brute_components(rows, 2)
    assert seen == [0]


def test_near_dedup_stage_decides_by_id_and_text(spark, documents):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choices([f"w{i}" for i in range(300)], k=40))
    clean, base, twice = [say() for _ in range(12)], say(), say()
    near = base + " more"
    rows = ([(None, t) for t in clean[:6]] + [(None, near), (None, twice), (None, twice), (None, None), (None, None)]
            + [(20, t) for t in clean[6:9]] + [(3, base), (20, near), (30, clean[9]), (30, clean[9]), (40, clean[10]), (41, clean[11])])
    out = corpus_pipeline.near_dedup_stage(spark, documents(rows), SF)
    assert out.columns == documents([]).columns
    want = ([(None, t) for t in clean[:6]] + [(None, twice), (None, None), (None, None)] + [(20, t) for t in clean[6:9]]
            + [(3, base), (30, clean[9]), (40, clean[10]), (41, clean[11])])
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted((str(i), str(t)) for i, t in want)
