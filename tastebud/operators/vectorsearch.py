"""Exact top-n inner products by an index of bounded blocks.

The corpus is split into cells around pivots (by angle) and every cell, in order
of falling length and growing angle, into blocks. A block is known by its cell,
the least and greatest angle of its vectors to the pivot and their greatest
length. No vector of a block has a product with a query q above

    |q| * longest * cos(max(0, angle(q, pivot) - farthest, nearest - angle(q, pivot)))

so a query visits blocks in order of that bound and leaves when its n-th score
can't be beaten. On unit vectors this is a metric index (the length is constant);
on factor vectors the lengths prune too. Results are exact whatever the data:
where directions carry no structure, every block is visited and the work is that
of plain block products, spread over three rounds (one where blocks are few).

What travels is a query's vector, with one bit per block, once for every run of
blocks it visits, and a run of blocks once for every part of the queries that
visit it (a tile: one part over one run); no (query, block) pair is ever a row. A
task holds the part, which is bounded by ``GROUP_VALUES`` numbers of vectors and
``STATE_CELLS`` results, and reads the blocks of the run as a stream, so runs may
be long: each adds at most n results of a query to what is shuffled. How many
parts and runs there are follows from what moving either costs (``_tiling``).

Products are formed in single precision, compared with the n-th score that the
tile has so far less the greatest rounding error there can be, and only pairs that
may reach it are scored in double precision: scores and ranks are those of double
precision whatever the data.

What the driver holds and sends is bounded at every size: ``MAX_PIVOTS`` vectors
and ``MAX_BLOCKS`` block rows of five numbers; beyond that blocks grow, not their
number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastebud.functions.index import dealt, dense_index
from tastebud.session import stored

BLOCK_ROWS, QUERY_ROWS = 1024, 2048
MAX_PIVOTS, MAX_BLOCKS = 1024, 65_536
FIRST_VISIT, GROWTH = 2, 8  # blocks a query may visit in the first round; factor to the second, where it can leave out half; the third has no bound
ONE_ROUND = 32  # of so few blocks all are visited at once: leaving some out saves less than a round costs
BOUND_CELLS = PRODUCT_CELLS = 4_000_000  # query x block bounds, query x vector products held at once
GROUP_VALUES = 4_194_304  # numbers in the vectors of a group of blocks, or of a part of the queries: 32 MB
STATE_CELLS = 8_388_608  # results that the queries of a part may hold meanwhile: 128 MB of scores and ids
GROUPS, TASKS = 8, 48  # groups of blocks where there are so many blocks, and tiles of a round that has the queries for them
RESULT_NUMBERS = 24  # numbers of a vector that move at the cost of one result row
PLACED_TILES = 4096  # so many tiles get a partition each
ANGLE_SLACK, SLACK = 1e-6, 1e-7  # beyond the rounding of arc cosines and products


@dataclass
class VectorIndex:
    rows: DataFrame       # (id, vec, block)
    pivots: np.ndarray    # unit vectors
    block: np.ndarray     # key, cell, nearest and farthest angle, greatest length of every block
    cell: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    longest: np.ndarray
    count: int            # rows


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and unit vectors; one without length stays zero."""
    size = np.linalg.norm(vectors, axis=1)
    return size, np.divide(vectors, size[:, None], out=np.zeros_like(vectors), where=size[:, None] > 0)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and angles to every pivot; a vector without length has angle 0."""
    size, unit = _units(vectors)
    angle = np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))
    angle[size == 0] = 0.0
    return size, angle


def build_index(corpus: DataFrame, id_col: str = "id", vec_col: str = "vec", block_rows: int = BLOCK_ROWS,
                max_pivots: int = MAX_PIVOTS, max_blocks: int = MAX_BLOCKS) -> VectorIndex:
    """Index the rows of ``corpus`` that have a vector; ids are unique."""
    rows = stored(corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
                  .where(F.col("vec").isNotNull()), "vectors")
    count = rows.count()
    size = max(block_rows, -(-count // max(1, max_blocks - max_pivots)))
    drawn = (rows.where(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id")
             .limit(max(1, min(max_pivots, count // size))).select("vec").collect())  # at most max_pivots
    pivots = np.array([r.vec for r in drawn], float) if drawn else np.ones((1, 1))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    none = not drawn
    known = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches):
        for b in batches:
            if not len(b):
                continue
            if none:  # all vectors are zero
                cell, away, length = np.zeros(len(b), int), np.zeros(len(b)), np.zeros(len(b))
            else:
                length, unit = _units(np.vstack(b["vec"].to_numpy()))
                cosine = unit @ known.value.T
                cell = cosine.argmax(axis=1)
                away = np.where(length == 0, 0.0, np.arccos(np.clip(cosine[np.arange(len(b)), cell], -1.0, 1.0)))
            yield b.assign(cell=cell, away=away, length=length)

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType()), T.StructField("away", T.DoubleType()),
                           T.StructField("length", T.DoubleType())])
    ordered = dense_index(rows.mapInPandas(place, schema), [F.col("cell"), F.round("length", 9).desc(), F.col("away"), F.col("id")],
                          "position")
    blocks = ordered.withColumn("block", F.shiftleft("cell", 40) + (F.col("position") / size).cast("long"))
    seen = (blocks.groupBy("block", "cell").agg(F.min("away").alias("near"), F.max("away").alias("far"), F.max("length").alias("length"))
            .orderBy("block").toPandas())  # at most max_blocks + pivots
    return VectorIndex(blocks.select("id", "vec", "block"), pivots, seen["block"].to_numpy(np.int64), seen["cell"].to_numpy(np.int64),
                       seen["near"].to_numpy(float), seen["far"].to_numpy(float), seen["length"].to_numpy(float), count)


def upper_bounds(index_parts: tuple, vectors: np.ndarray) -> np.ndarray:
    """For each query and block a number that no product reaches from above."""
    pivots, cell, nearest, farthest, longest = index_parts
    if vectors.shape[1] != pivots.shape[1]:
        return np.zeros((len(vectors), len(cell)))  # only zero vectors in the corpus
    length, angle = _angles(vectors, pivots)
    to = angle[:, cell]
    apart = np.maximum(np.maximum(to - farthest, nearest - to) - ANGLE_SLACK, 0.0)
    return length[:, None] * longest * np.maximum(np.cos(np.minimum(apart, np.pi)), 0.0)


def _best(scored: DataFrame, n: int, digits: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= n)


def top_products(index: VectorIndex, queries: DataFrame, n: int, excluded: DataFrame | None = None, digits: int = 9,
                 visits: list | None = None) -> DataFrame:
    """(query_id, rank, id, score): the n greatest products of every query (query_id, vec), ids unique.

    Scores are ranked rounded to ``digits``, ties by id; ``excluded`` rows
    (query_id, id) don't count. ``visits`` gets the (query, block) pairs of each round.
    """
    if n <= 0:
        raise ValueError("n must be greater than zero")
    spark = queries.sparkSession
    kinds = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec", T.ArrayType(T.DoubleType()))]
    id_field = T.StructField("id", index.rows.schema["id"].dataType)
    result = T.StructType([kinds[0], id_field, T.StructField("score", T.DoubleType())])
    total = len(index.block)
    if not total:
        return spark.createDataFrame([], T.StructType([kinds[0], T.StructField("rank", T.LongType()), id_field, result["score"]]))
    slack = SLACK + 2 * 10.0 ** -digits
    parts = spark.sparkContext.broadcast((index.pivots, index.cell, index.nearest, index.farthest, index.longest))
    most = max(1, GROUP_VALUES // index.pivots.shape[1])  # vectors of a group or part
    wide = max(1, min(most * total // index.count, -(-total // GROUPS)))  # blocks of a group
    groups, held = -(-total // wide), -(-wide // 8)  # a query's blocks are bits: so many bytes a group
    bit = np.arange(total) // wide * held * 8 + np.arange(total) % wide
    gone = None
    if excluded is not None:
        at = excluded.select("query_id", "id").distinct().join(dealt(index.rows.select("id", "block")), "id")
        gone = stored(at.groupBy("query_id", "block").agg(F.collect_list("id").alias("gone")), "excluded")

    def propose(may: int):
        def run(batches):
            step = max(1, BOUND_CELLS // total)
            for b in batches:
                for start in range(0, len(b), step):
                    part = b.iloc[start:start + step]
                    bounds = upper_bounds(parts.value, np.vstack(part["vec"].to_numpy()))
                    least = part["nth"].to_numpy(float)
                    wanted = ~(bounds + slack * (1 + np.abs(bounds)) < least[:, None])  # no n-th score yet: all
                    among = np.ones_like(wanted)
                    if may < total:
                        first = np.argpartition(-bounds, may - 1, axis=1)[:, :may]
                        among = np.zeros_like(wanted)
                        np.put_along_axis(among, first, True, axis=1)
                        if may > FIRST_VISIT:
                            among[wanted.sum(axis=1) * 2 > total] = True
                    left = wanted.sum(axis=1) - (wanted & among).sum(axis=1)
                    wanted &= among
                    bits = np.zeros((len(part), groups * held * 8), np.uint8)
                    bits[:, bit] = wanted
                    was = np.frombuffer(b"".join(part["done"]), np.uint8).reshape(len(part), -1) if part["done"].iloc[0] else np.zeros((1, 1), np.uint8)
                    bits = np.packbits(bits, axis=1)
                    asked = bits & ~was
                    now = np.unpackbits(asked, axis=1)
                    visited = asked.reshape(len(part), groups, held).any(axis=2)
                    yield pd.DataFrame({"query_id": part["query_id"], "vec": part["vec"], "nth": part["nth"],
                                        "done": [x.tobytes() for x in bits | was], "asked": [x.tobytes() for x in asked],
                                        "groups": [np.flatnonzero(x).astype(np.int32) for x in visited], "blocks": now.sum(axis=1, dtype=np.int64),
                                        "left": left.astype(np.int64)})
        return run

    def score(batches):
        return _tiles(batches, n, digits, slack)

    state = T.StructType([*kinds, T.StructField("nth", T.DoubleType()), T.StructField("done", T.BinaryType()), T.StructField("asked", T.BinaryType()),
                          T.StructField("groups", T.ArrayType(T.IntegerType())), T.StructField("blocks", T.LongType()), T.StructField("left", T.LongType())])
    queries = stored(queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).where(F.col("query_id").isNotNull()), "queries")
    found_so_far = T.StructType([kinds[0], T.StructField("rank", T.LongType()), id_field, result["score"]])
    best, done, fit = spark.createDataFrame([], found_so_far).limit(0), None, max(1, min(most, STATE_CELLS // _cap(n)))
    turn = np.empty(total, int)
    turn[np.argsort(-index.longest, kind="stable")] = np.arange(total)  # within a tile the longest vectors come first
    for may in sorted({min(m, total) for m in (FIRST_VISIT, FIRST_VISIT * GROWTH, total)}) if total > ONE_ROUND else [total]:
        nth = best.where(F.col("rank") == n).select("query_id", F.col("score").alias("nth"))
        now = dealt(queries).join(dealt(nth), "query_id", "left")
        now = now.withColumn("done", F.lit(b"")) if done is None else now.join(dealt(done), "query_id")
        now = stored(now.select("query_id", "vec", "nth", "done").mapInPandas(propose(may), state), "visits")
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum("left"), F.lit(0))).first()
        if visits is not None:
            visits.append(int(seen[1]))
        if not seen[1]:
            break  # of the next blocks in order none can beat the n-th score, so no later one can
        counts = now.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most one row a block
        runs, each = _tiling(seen[0], int(counts["n"].sum()), index.count, groups, fit, index.pivots.shape[1], n)
        long = -(-groups // runs)  # groups of a run
        run_of = F.array_distinct(F.transform("groups", lambda g: F.floor(g / long).cast("int")))
        asking = now.select("query_id", "vec", "nth", "asked", F.explode(run_of).alias("run"))
        if long > 1:
            counts = asking.groupBy("run").agg(F.count(F.lit(1)).alias("n")).toPandas()
        copies, first, tiles = {}, {}, 0
        for r, k in counts.itertuples(index=False):
            copies[int(r)], first[int(r)] = -(-int(k) // each), tiles
            tiles += copies[int(r)]
        blocks = F.broadcast(spark.createDataFrame(
            [(int(b), r, int(bit[i] - r * long * held * 8), int(turn[i]), first[r], copies[r]) for i, b in enumerate(index.block) if (r := i // wide // long) in copies],
            "block long, run int, place int, turn int, first int, copies int"))  # at most max_blocks + pivots rows
        tile = (F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("copies"))).cast("int").alias("tile")
        no_id, no_query = (F.lit(0).cast(x.dataType) for x in (id_field, kinds[0]))  # a column with nulls would lose digits of large numbers
        left = asking.join(F.broadcast(spark.createDataFrame([(r, first[r], copies[r]) for r in copies], "run int, first int, copies int")), "run")
        left = left.select(tile, F.lit(-1).alias("turn"), F.lit(0).alias("kind"), "query_id", "vec", "nth",
                           F.substring("asked", F.col("run") * (long * held) + 1, F.lit(long * held)).alias("asked"),
                           F.lit(None).cast(T.ArrayType(id_field.dataType)).alias("gone"), F.lit(0).alias("place"), no_id.alias("id"))
        if gone is not None:  # rows of their own before the block's
            left = left.unionByName(dealt(gone).join(blocks, "block").select(tile, "turn", F.lit(1).alias("kind"), "query_id", "gone", "place", no_id.alias("id")),
                                    allowMissingColumns=True)
        right = index.rows.join(blocks, "block").select(
            F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("tile"), "turn", F.lit(2).alias("kind"),
            no_query.alias("query_id"), "vec", "place", "id")
        found = (_placed(left.unionByName(right, allowMissingColumns=True), tiles).sortWithinPartitions("tile", "turn", "kind")
                 .mapInPandas(score, result))
        best = stored(_best(best.select("query_id", "id", "score").union(found), n, digits), "best")
        if not seen[2]:
            break
        done = now.select("query_id", "done")
    return best.select("query_id", "rank", "id", "score")


def _tiling(queries: int, visits: int, items: int, groups: int, fit: int, width: int, n: int) -> tuple[int, int]:
    """(runs, queries of a part): the tiling that moves least of those with enough tiles, where parts fit.

    An item's vector moves once per part, a query's vector and its n results once
    per run that it visits; ``visits`` are the queries' visits to groups.
    """
    options = []
    for runs in range(1, groups + 1):
        if runs > 64 and runs < groups and runs % 16:
            continue
        pairs = min(runs * queries, visits)
        each = -(-pairs // runs)
        most = max(1, -(-each // min(fit, QUERY_ROWS)))
        parts = max(-(-each // fit), min(most, -(-TASKS // runs)))
        options.append((-min(TASKS, runs * parts), parts * items * width + pairs * (width + RESULT_NUMBERS * n), runs, -(-each // parts)))
    return min(options)[2:]


def _placed(rows: DataFrame, tiles: int) -> DataFrame:
    """``rows`` dealt by ``tile``; where tiles are few each gets a partition of its own, which a hash of their numbers wouldn't give."""
    if tiles > PLACED_TILES:
        return rows.repartition(PLACED_TILES, "tile")
    numbers = rows.sparkSession.range(tiles * 32).select(F.col("id").cast("int").alias("number"))
    keys = dict(numbers.groupBy(F.pmod(F.hash("number"), F.lit(tiles)).alias("at")).agg(F.min("number")).collect())  # one row a tile
    spare = iter(range(tiles * 32, tiles * 33))
    return rows.withColumn("tile", F.element_at(F.lit([keys[t] if t in keys else next(spare) for t in range(tiles)]), F.col("tile") + 1)).repartition(tiles, "tile")


def _cap(n: int) -> int:
    """Results that a query may hold before they are cut to the best n."""
    return n + max(64, n // 2)


def _tiles(batches, n: int, digits: int, slack: float):
    """The n best of every query of a tile over the blocks it asks for, from rows in order of tile, turn and kind.

    Kinds: 0 a query (``vec``, ``asked``: bits of its blocks), 1 the ids that a
    query excludes in the block that follows, 2 an item with the place of its block.
    """
    key = tile = None
    for b in batches:
        ends = [0, *(np.flatnonzero(np.diff(b["tile"].to_numpy())) + 1), len(b)]
        for lo, hi in zip(ends, ends[1:]):
            if lo == hi:
                continue
            rows = b.iloc[lo:hi]
            if rows["tile"].iloc[0] != key:
                if tile is not None:
                    yield from tile.results()
                key, tile = rows["tile"].iloc[0], _Tile(n, digits, slack)
            tile.add(rows)
    if tile is not None:
        yield from tile.results()


def _nonzero(some: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of booleans, few of them true: eight are looked at together."""
    flat = some.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    r, c = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[r] * 8 + c


class _Tile:
    """The queries of one tile and the best results they have so far, in no order."""

    def __init__(self, n: int, digits: int, slack: float):
        self.n, self.digits, self.slack, self.cap = n, digits, slack, _cap(n)
        self.asking, self.gone, self.met, self.ids = [], [], 0, None

    def add(self, rows: pd.DataFrame) -> None:
        kind = rows["kind"].to_numpy()
        if (kind == 0).any():
            self.asking.append(rows.loc[kind == 0, ["query_id", "vec", "nth", "asked"]])
        if (kind == 1).any():
            self.gone.append(rows.loc[kind == 1, ["query_id", "gone", "turn"]])
        if (kind == 2).any() and self.asking:
            if self.met == 0:
                self.begin()
            self.meet(rows[kind == 2])

    def begin(self) -> None:
        q = pd.concat(self.asking, ignore_index=True)
        m = len(q)
        self.query, self.vectors = q["query_id"], np.vstack(q["vec"].to_numpy())
        self.least = np.nan_to_num(q["nth"].to_numpy(float), nan=-np.inf) - self.slack
        self.asked = np.frombuffer(b"".join(q["asked"]), np.uint8).reshape(m, -1)
        size = np.linalg.norm(self.vectors, axis=1)
        self.size = np.where(size > 0, size, 1.0)
        with np.errstate(all="ignore"):
            self.single = (self.vectors / self.size[:, None]).astype(np.float32)
        self.scores = np.full((m, self.cap), -np.inf)
        self.fill, self.nth = np.zeros(m, np.int64), np.full(m, -np.inf)

    def meet(self, c: pd.DataFrame) -> None:
        """All queries against some items, in parts of at most ``PRODUCT_CELLS`` products."""
        ids, place, matrix = c["id"].to_numpy(), c["place"].to_numpy(), np.vstack(c["vec"].to_numpy())
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(object)
        row, at = _hidden(self.query, self.gone, ids)
        last = c["turn"].iloc[-1]
        self.gone = [g[g["turn"] >= last] for g in self.gone if (g["turn"] >= last).any()]
        with np.errstate(all="ignore"):
            longest = np.linalg.norm(matrix, axis=1).max()
            longest = longest if longest > 0 else 1.0
            scale = self.size * longest
        single = bool(np.isfinite(scale).all() and (scale > 0).all())
        # in single precision lengths are 1 at most, so this is more than a product's rounding error
        left, right, error = (self.single, (matrix / longest).astype(np.float32), (matrix.shape[1] + 8) * 2.0 ** -23) if single else (self.vectors, matrix, 0.0)
        scale = scale if single else np.ones(len(scale))
        for lo, hi, who in self.asked_for(place):
            step, inside = max(1, PRODUCT_CELLS // (hi - lo)), (at >= lo) & (at < hi)
            gone_row, gone_at = row[inside], at[inside] - lo
            for some in (who[i:i + step] for i in range(0, len(who), step)):
                products = left[some] @ right[lo:hi].T
                a, b = np.searchsorted(gone_row, [some[0], some[-1] + 1])
                to = np.minimum(np.searchsorted(some, gone_row[a:b]), len(some) - 1)
                own = some[to] == gone_row[a:b]
                products[to[own], gone_at[a:b][own]] = -np.inf
                self.take(some, products, scale[some], error, matrix[lo:hi], ids[lo:hi])
        self.met += 1
        if not self.met & (self.met - 1):  # at every doubling
            self.cut(np.flatnonzero(self.fill >= self.n))

    def asked_for(self, place: np.ndarray):
        """(from, to, queries) of runs of items: blocks that all queries ask for go together."""
        starts = [0, *(np.flatnonzero(np.diff(place)) + 1), len(place)]
        every, begun = np.arange(len(self.asked)), None
        for lo, hi in zip(starts, starts[1:]):
            who = np.flatnonzero(self.asked[:, place[lo] >> 3] >> (7 - (place[lo] & 7)) & 1)
            if len(who) == len(every):
                begun = lo if begun is None else begun
                continue
            if begun is not None:
                yield begun, lo, every
                begun = None
            if len(who):
                yield lo, hi, who
        if begun is not None:
            yield begun, len(place), every

    def take(self, queries: np.ndarray, products: np.ndarray, scale: np.ndarray, error: float, matrix: np.ndarray, ids: np.ndarray) -> None:
        """What may be among a query's best is scored in double precision and kept."""
        rows, cols = products.shape
        lowest = float(np.finfo(products.dtype).min)
        reach = np.maximum((np.maximum(self.least[queries], self.nth[queries]) - self.slack) / scale - error, lowest)

        def raised(some: np.ndarray) -> None:  # no query needs more than the n best of these items
            if cols > self.n and len(some):
                nth = np.partition(products[some], cols - self.n, axis=1)[:, cols - self.n].astype(float)
                nth = np.where(np.isnan(nth), -np.inf, nth)
                reach[some] = np.maximum(reach[some], nth - 2 * error - 2 * self.slack / scale[some])

        raised(np.flatnonzero(reach == lowest))
        hit = _nonzero(products >= reach.astype(products.dtype)[:, None])
        many = np.bincount(hit // cols, minlength=rows) > self.cap
        if many.any():
            raised(np.flatnonzero(many))
            hit = _nonzero(products >= reach.astype(products.dtype)[:, None])
        for some in np.array_split(hit, max(1, -(-len(hit) * matrix.shape[1] // PRODUCT_CELLS))):
            w, k = np.divmod(some, cols)
            w = queries[w]
            s = np.round(np.einsum("ij,ij->i", self.vectors[w], matrix[k]), self.digits)
            keep = (s >= np.maximum(self.least[w], self.nth[w])) & (s > -np.inf)
            self.put(w[keep], s[keep], ids[k[keep]])

    def put(self, w: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        """Results in order of their queries; a query that has too many keeps the best n."""
        if not len(w):
            return
        number = np.bincount(w, minlength=len(self.fill))
        full = self.fill + number > self.cap
        at = self.fill[w] + np.arange(len(w)) - np.searchsorted(w, w)
        fits = ~full[w]
        self.scores[w[fits], at[fits]] = s[fits]
        self.ids[w[fits], at[fits]] = ids[fits]
        self.fill[~full] += number[~full]
        if full.any():
            self.cut(np.flatnonzero(full), w[~fits], at[~fits], s[~fits], ids[~fits])

    def cut(self, rows: np.ndarray, w=None, at=None, s=None, ids=None) -> None:
        """The best n of some queries' results, with new ones beside them: by score, of equal scores the smallest ids."""
        wide = self.cap if w is None else max(self.cap, int(at.max()) + 1) if len(w) else self.cap
        step = max(1, PRODUCT_CELLS // wide)
        for some in (rows[i:i + step] for i in range(0, len(rows), step)):
            scores, held = np.full((len(some), wide), -np.inf), np.zeros((len(some), wide), self.ids.dtype)
            scores[:, :self.cap], held[:, :self.cap] = self.scores[some], self.ids[some]
            if w is not None:
                a, b = np.searchsorted(w, [some[0], some[-1] + 1])
                to = np.searchsorted(some, w[a:b])
                scores[to, at[a:b]], held[to, at[a:b]] = s[a:b], ids[a:b]
            nth = np.partition(scores, wide - self.n, axis=1)[:, wide - self.n]
            keep = (scores >= nth[:, None]) & (scores > -np.inf)
            tied = np.flatnonzero(keep.sum(axis=1) > self.n)
            if len(tied):
                r, c = np.nonzero(scores[tied] == nth[tied, None])
                name = held[tied][r, c]
                name = np.unique(name, return_inverse=True)[1] if name.dtype == object else name
                order = np.lexsort((name, r))
                place = np.arange(len(r)) - np.searchsorted(r, r)  # r is sorted
                over = order[place >= (self.n - (scores[tied] > nth[tied, None]).sum(axis=1))[r]]
                keep[tied[r[over]], c[over]] = False
            r, c = np.nonzero(keep)
            to = np.arange(len(r)) - np.searchsorted(r, r)
            self.scores[some] = -np.inf
            self.scores[some[r], to], self.ids[some[r], to] = scores[r, c], held[r, c]
            self.fill[some] = np.bincount(r, minlength=len(some))
            self.nth[some] = nth  # -inf where there are fewer

    def results(self):
        if not self.met:
            return
        self.cut(np.flatnonzero(self.fill > self.n))
        step = max(1, 200_000 // self.n)
        for start in range(0, len(self.fill), step):
            r, c = np.nonzero(self.scores[start:start + step] > -np.inf)
            if len(r):
                yield pd.DataFrame({"query_id": self.query.iloc[start + r].to_numpy(), "id": self.ids[start + r, c], "score": self.scores[start + r, c]})


def _hidden(query: pd.Series, gone: list, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``query``, places in ``ids``) of the excluded pairs, by row."""
    rows = pd.DataFrame({"query_id": query, "row": np.arange(len(query))}).merge(pd.concat(gone), on="query_id") if gone else ()
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(rows["row"].to_numpy(), [len(x) for x in rows["gone"]])
    at = pd.Index(ids).get_indexer(pd.Index(np.concatenate(rows["gone"].to_list())))
    order = np.argsort(row, kind="stable")
    order = order[at[order] >= 0]
    return row[order], at[order]
