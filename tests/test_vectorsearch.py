"""The bounded-block index against plain products: exact results, few visits where the data has structure."""

import numpy as np
import pandas as pd
import pytest

from tastebud.operators import vectorsearch as VS
from tastebud.operators.similar import similar_embeddings

VEC = "id long, vec array<double>"


def table(spark, m, names="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], VEC).withColumnRenamed("id", names)


def plain(q, m, n, without=()):
    s = np.round(q @ m.T, 9)
    for i, j in without:
        s[i, j] = -np.inf
    out = set()
    for i, row in enumerate(s):
        for r, j in enumerate(sorted((j for j in range(len(m)) if row[j] > -np.inf), key=lambda j: (-row[j], j))[:n]):
            out.add((i, r + 1, j))
    return out


@pytest.mark.parametrize("kind", ["normal", "lengths", "ties", "zeros"])
def test_products_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    m, q = rng.normal(size=(90, 4)), rng.normal(size=(25, 4))
    if kind == "lengths":
        m *= 10.0 ** rng.uniform(-3, 2, size=(90, 1))
    if kind == "ties":
        m, q = np.round(m), np.round(q)
    if kind == "zeros":
        m[::3], q[::4] = 0.0, 0.0
    index = VS.build_index(table(spark, m), block_rows=8, max_pivots=6)
    without = [(int(i), int(j)) for i, j in zip(rng.integers(0, 25, 120), rng.integers(0, 90, 120))]
    excluded = spark.createDataFrame(without, "query_id long, id long")
    got = VS.top_products(index, table(spark, q, "query_id"), 7, excluded)
    assert {(r.query_id, r.rank, r.id) for r in got.collect()} == plain(q, m, 7, without)


def test_fewer_rows_than_asked_and_empty_sides(spark):
    m = np.eye(3)
    index = VS.build_index(table(spark, m))
    assert VS.top_products(index, table(spark, m, "query_id"), 9).count() == 9
    assert VS.top_products(index, table(spark, m, "query_id").limit(0), 9).count() == 0
    empty = VS.build_index(table(spark, m).limit(0))
    assert VS.top_products(empty, table(spark, m, "query_id"), 9).count() == 0


def test_bounds_hold_for_every_block(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(300, 5)) * rng.uniform(0.1, 4, size=(300, 1))
    index = VS.build_index(table(spark, m), block_rows=16, max_pivots=9)
    q = rng.normal(size=(40, 5))
    bounds = VS.upper_bounds((index.pivots, index.cell, index.nearest, index.farthest, index.longest), q)
    at = {int(b): i for i, b in enumerate(index.block)}
    rows = index.rows.collect()
    assert len(rows) == 300 and len(at) > 15
    for r in rows:
        assert (q @ np.array(r.vec) <= bounds[:, at[r.block]] + 1e-9).all()


@pytest.mark.parametrize("size", [4_000, 16_000])
def test_clustered_vectors_are_found_in_few_blocks(spark, size):
    """Pairs of query and block, against all: both sizes hold the same bound, so visits grow with n, not n²."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(64, 24))
    m = centres[rng.integers(0, 64, size)] + 0.05 * rng.normal(size=(size, 24))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    index, visits = VS.build_index(table(spark, m), block_rows=size // 64), []
    queries = np.arange(0, size, 40)
    asked = spark.createDataFrame([(int(i), m[i].tolist()) for i in queries], "query_id long, vec array<double>")
    got = VS.top_products(index, asked, 5, visits=visits).collect()
    want = np.sort(np.round(m[queries] @ m.T, 9), axis=1)[:, ::-1][:, :5]
    for i, q in enumerate(queries):
        assert [r.score for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == pytest.approx(want[i].tolist())
    assert sum(visits) < 0.15 * len(queries) * len(index.block)


def test_one_vector_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 6))
    m[::3] = m[0]
    vecs = table(spark, m, "vec_id").withColumnRenamed("vec", "embedding")
    got = {(r.query_id, r.rank, r.vec_id) for r in similar_embeddings(vecs, vecs, 4, block_rows=5).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert got == plain(unit, unit, 4, [(i, i) for i in range(60)])


@pytest.mark.parametrize("group_values", [64, 4_194_304])
def test_rows_between_tasks_are_per_group_not_per_block(spark, monkeypatch, group_values):
    """Vectors without structure: no table of a round has a row per (query, block), and results stay exact with string ids and ties."""
    written, store = [], VS.stored

    def counted(df, name):
        out = store(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(VS, "stored", counted)
    monkeypatch.setattr(VS, "GROUP_VALUES", group_values)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 4))
    m[200:] = m[:200]
    names = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(m)], "id string, vec array<double>")
    index = VS.build_index(names, block_rows=8, max_pivots=6)
    without = [(int(i), int(j)) for i, j in zip(rng.integers(0, 400, 900), rng.integers(0, 400, 900))]
    excluded = spark.createDataFrame([(f"{i:03d}", f"{j:03d}") for i, j in without], "query_id string, id string")
    got = VS.top_products(index, names.withColumnRenamed("id", "query_id"), 3, excluded)
    assert {(int(r.query_id), r.rank, int(r.id)) for r in got.collect()} == plain(m, m, 3, without)
    assert len(index.block) >= 50 and max(k for name, k in written if name == "visits") <= 400


def test_few_blocks_are_visited_in_one_round(spark):
    """A round is several small jobs: where all blocks are few, asking for some of them first saves nothing."""
    rng = np.random.default_rng(6)
    m, q = np.round(rng.normal(size=(90, 4)), 1), np.round(rng.normal(size=(25, 4)), 1)
    m[::5] = m[0]
    index, visits = VS.build_index(table(spark, m), block_rows=9, max_pivots=3), []
    assert 2 < len(index.block) <= VS.ONE_ROUND
    without = [(i, j) for i in range(25) for j in range(0, 90, 7)]
    got = VS.top_products(index, table(spark, q, "query_id"), 6, spark.createDataFrame(without, "query_id long, id long"), visits=visits)
    assert {(r.query_id, r.rank, r.id) for r in got.collect()} == plain(q, m, 6, without)
    assert visits == [25 * len(index.block)]


def test_vectors_without_structure_take_two_rounds(spark):
    """After the first round no query can leave out half of the blocks: all others are visited at once, not in a round more."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(400, 16))
    index, visits = VS.build_index(table(spark, m), block_rows=8, max_pivots=6), []
    assert len(index.block) > VS.ONE_ROUND
    got = VS.top_products(index, table(spark, m, "query_id"), 3, visits=visits)
    assert {(r.query_id, r.rank, r.id) for r in got.collect()} == plain(m, m, 3)
    assert len(visits) == 2 and visits[0] == 2 * 400


@pytest.mark.parametrize("names", [int, "{:04d}".format])
def test_a_tile_streams_its_blocks_and_keeps_the_best(names):
    """Scores that single precision can't tell apart, ties beyond what a query may hold, excluded ids, blocks not asked for."""
    rng = np.random.default_rng(9)
    m, n = rng.normal(size=(900, 8)), 5
    m[100:300], m[300:500] = m[0], m[0] * (1 + 1e-8 * np.arange(200))[:, None]
    q = np.vstack([m[0], 1e3 * m[0], -m[0], np.zeros(8), rng.normal(size=(12, 8))])
    place = np.arange(900) // 60
    asks = rng.random((len(q), 15)) < 0.8
    asks[:4] = True
    ids = [names(i) for i in rng.permutation(900)]
    gone = {(i, int(j)) for i, j in zip(rng.integers(0, len(q), 300), rng.integers(0, 900, 300))}

    def frame(tile, turn, kind, **columns):
        base = {"tile": tile, "turn": turn, "kind": kind, "query_id": names(0), "vec": None, "nth": np.nan, "asked": None, "gone": None, "place": 0, "id": names(0)}
        return pd.DataFrame([base | dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)])

    def batches():
        for tile in (4, 9):
            rows = [frame(tile, -1, 0, query_id=[names(i) for i in range(len(q))], vec=list(q), asked=[np.packbits(a).tobytes() for a in asks])]
            for p in range(15):
                at = np.flatnonzero(place == p)
                without = [(i, [ids[j] for j in at if (i, j) in gone]) for i in range(len(q))]
                rows.append(frame(tile, p, 1, query_id=[names(i) for i, x in without if x], gone=[x for _, x in without if x]))
                rows.append(frame(tile, p, 2, vec=list(m[at]), id=[ids[j] for j in at], place=[p] * len(at)))
            yield from (x for r in np.array_split(pd.concat(rows, ignore_index=True), 7) for x in [r])

    out = pd.concat(list(VS._tiles(batches(), n, 9, 1e-7)))
    assert len(out) == 2 * n * len(q)  # each tile gives n at most
    scores = np.round(q @ m.T, 9)
    for i in range(len(q)):
        fits = [j for j in range(900) if asks[i, place[j]] and (i, j) not in gone]
        want = sorted(ids[j] for j in sorted(fits, key=lambda j: (-scores[i, j], ids[j]))[:n])
        assert sorted(out.loc[out.query_id == names(i), "id"]) == sorted(2 * want)


def test_tiling_gives_few_results_for_long_lists_and_fits():
    """Runs of blocks are long where results are many, parts hold what fits, and there are tiles enough."""
    for queries, items, n in ((900_000, 1_200_000, 200), (90_000, 1_200_000, 120), (540_000, 7_200_000, 12), (3_000, 1_200_000, 12)):
        groups, fit = -(-items * 64 // VS.GROUP_VALUES), min(VS.GROUP_VALUES // 64, VS.STATE_CELLS // VS._cap(n))
        runs, each = VS._tiling(queries, queries * groups, items, groups, fit, 64, n)
        assert each <= fit and runs <= groups
        assert runs * -(-queries // each) >= min(VS.TASKS, groups * -(-queries // VS.QUERY_ROWS))
        assert runs * n < 1500 or queries < 10_000  # rows a query leaves to the last window
