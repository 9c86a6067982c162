"""Truncated SVD and blocked top-k scoring over sparse row tables; factors are tables too.

A sparse matrix is a DataFrame of rows ``(row, cols array<int>, vals
array<double>)`` (one row per user or document, bounded by the number of
columns). A column-side block is a DataFrame ``(col, vec array<double>)``. Row
blocks meet the vectors of the columns they touch in one cogroup per block, and
column sums are aggregated with partial sums before the shuffle. Only l x l
matrices (l = components + oversamples) and counts reach the driver, nothing is
broadcast by hand, and the plan is the same at every size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastebud.functions.index import dealt
from tastebud.operators.vectorsearch import BLOCK_ROWS, build_index, top_products
from tastebud.session import stored

ROW_BLOCK_VALUES = 100_000  # matrix values of one row block: at most as many column vectors meet it
TIE_DIGITS = 12  # scores equal to that many digits are ties
GRAM = -1  # key of the row that carries (A Z)'(A Z)
VECS = "col long, vec array<double>"


def csr_rows(coo: DataFrame, row: str, col: str, val: str) -> DataFrame:
    """(row, cols, vals) with cols sorted; duplicates of (row, col) must be pre-aggregated."""
    g = coo.groupBy(row).agg(F.sort_array(F.collect_list(F.struct(F.col(col).cast("int").alias("c"),
                                                                  F.col(val).cast("double").alias("v")))).alias("e"))
    return g.select(F.col(row).alias("row"), F.col("e.c").alias("cols"), F.col("e.v").alias("vals"))


def row_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` dealt into blocks of about ``ROW_BLOCK_VALUES`` values, at least one per shuffle partition."""
    values = rows.agg(F.sum(F.size("cols").cast("long"))).first()[0] or 0
    blocks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(values) // ROW_BLOCK_VALUES))
    return rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))


def touched(blocks: DataFrame) -> DataFrame:
    """(at_block, col): the columns with a value in a block."""
    return (blocks.select(F.col("block").alias("at_block"), F.explode("cols").alias("col"))
            .select("at_block", F.col("col").cast("long")).distinct())


def _empty(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: np.array([], object) for c in columns})


def _products(b: pd.DataFrame, z: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row block and the vectors it touches: Y = A Z, and per value its row, place in z, column and value.

    Columns without a vector count as zero.
    """
    order = np.argsort(z["col"].to_numpy(), kind="stable")
    keys, mat = z["col"].to_numpy()[order], np.vstack(z["vec"].to_numpy()[order])
    lens = np.fromiter(map(len, b["cols"]), np.int64, len(b))
    cols = np.concatenate([np.asarray(c, np.int64) for c in b["cols"]])
    vals = np.concatenate([np.asarray(v, np.float64) for v in b["vals"]])
    row_of = np.repeat(np.arange(len(b)), lens)
    at = np.minimum(np.searchsorted(keys, cols), len(keys) - 1)
    known = keys[at] == cols
    row_of, at, vals = row_of[known], at[known], vals[known]
    y = np.zeros((len(b), mat.shape[1]))
    np.add.at(y, row_of, vals[:, None] * mat[at])
    return y, row_of, at, keys, vals


def at_a(blocks: DataFrame, places: DataFrame, z: DataFrame, with_gram: bool = False, n_cols: int | None = None) -> DataFrame:
    """(col, vec) of Aᵀ(A Z); with ``with_gram`` also one row ``GRAM`` with (A Z)ᵀ(A Z), flattened.

    ``n_cols`` says how many vectors Z has at most: few may go along, more are dealt by column.
    """
    def run(b: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if b.empty or v.empty:
            return _empty("col", "vec")
        y, row_of, at, keys, vals = _products(b, v)
        sums = np.zeros((len(keys), y.shape[1]))
        np.add.at(sums, at, vals[:, None] * y[row_of])
        out = pd.DataFrame({"col": keys, "vec": list(sums)})
        if with_gram:
            out = pd.concat([out, pd.DataFrame({"col": [GRAM], "vec": [(y.T @ y).ravel()]})], ignore_index=True)
        return out

    parts = (blocks.select("block", "cols", "vals").groupBy("block")
             .cogroup(places.join(dealt(z, rows=n_cols), "col").groupBy("at_block")).applyInPandas(run, VECS))
    return vector_sum(parts, "col")


def vector_sum(vectors: DataFrame, key: str) -> DataFrame:
    return (vectors.groupBy(key).agg(Summarizer.sum(array_to_vector("vec")).alias("s"))
            .select(key, vector_to_array("s").alias("vec")))


def gram(z: DataFrame) -> np.ndarray:
    """ZᵀZ: one l x l partial per task, summed by Spark."""
    def run(batches):
        total = None
        for b in batches:
            if len(b):
                m = np.vstack(b["vec"].to_numpy())
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"col": [0], "vec": [total.ravel()]})

    flat = np.asarray(vector_sum(z.select("vec").mapInPandas(run, VECS), "col").first()["vec"])
    l = int(round(len(flat) ** 0.5))
    return flat.reshape(l, l)


def times(z: DataFrame, m: np.ndarray) -> DataFrame:
    """(col, vec) of Z M for a small matrix M."""
    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"col": b["col"], "vec": list(np.vstack(b["vec"].to_numpy()) @ m)})

    return z.select("col", "vec").mapInPandas(run, VECS)


def _orthonormal(g: np.ndarray) -> np.ndarray:
    """M such that the columns of Z M are orthonormal, from g = ZᵀZ; directions of no weight are left out."""
    scale = np.sqrt(np.diag(g))
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    lam, w = np.linalg.eigh(g * np.outer(inverse, inverse))
    keep = lam > max(lam.max(), 0.0) * 1e-13
    return inverse[:, None] * w[:, keep] / np.sqrt(lam[keep])


def truncated_svd(rows: DataFrame, n_cols: int, n_components: int = 64, seed: int = 42, n_iter: int = 7,
                  n_oversamples: int = 10, n_rows: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Randomized truncated SVD (Halko, Martinsson, Tropp 2011) of a sparse row table.

    Returns (V, sigma): V is the table (col, vec) of right singular vectors with
    r = min(n_components, min(shape) - 1) components; columns without a value
    have no row. Every power step writes AᵀA Z once and makes it orthonormal
    through its l x l Gram matrix.
    """
    if n_components <= 0:
        raise ValueError("n_components must be greater than zero")
    m = n_rows if n_rows is not None else rows.count()
    if m == 0:
        raise ValueError("Cannot fit on empty interactions")
    if min(m, n_cols) - 1 < 1:
        raise ValueError("At least two users and two items are required for SVD")
    r = min(n_components, min(m, n_cols) - 1)
    width = r + n_oversamples
    blocks = stored(row_blocks(rows), "rows")
    places = stored(touched(blocks), "places")

    def drawn(batches):
        for b in batches:
            vecs = [np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, c])).normal(size=width)
                    for c in b["col"].tolist()]
            yield pd.DataFrame({"col": b["col"], "vec": vecs})

    z = rows.sparkSession.range(n_cols).withColumnRenamed("id", "col").mapInPandas(drawn, VECS)
    for _ in range(n_iter):
        z = stored(at_a(blocks, places, z, n_cols=n_cols), "power")
        z = times(z, _orthonormal(gram(z)))
    # last pass: Z2 = Aᵀ Y and G = YᵀY for Y = A Z, then the SVD of QᵀA = (Z2 M)ᵀ with Q = Y M
    last = stored(at_a(blocks, places, z, with_gram=True, n_cols=n_cols), "power")
    flat = np.asarray(last.where(F.col("col") == GRAM).first()["vec"])
    z2 = last.where(F.col("col") != GRAM)
    width = int(round(len(flat) ** 0.5))
    lam, w = np.linalg.eigh(flat.reshape(width, width))
    keep = lam > max(lam.max(), 0.0) * 1e-12
    half = w[:, keep] / np.sqrt(lam[keep])
    square, u = np.linalg.eigh(half.T @ gram(z2) @ half)
    order = np.argsort(-square)[:r]
    order = order[square[order] > 0]
    s = np.sqrt(square[order])
    return stored(times(z2, half @ u[:, order] / s), "vectors"), s


def project_rows(rows: DataFrame, vectors: DataFrame, normalize: bool = False) -> DataFrame:
    """(row, vec) = A V per row with columns (optionally L2-normalised; a zero row stays zero).

    ``vectors`` is (col, vec); a column without a vector counts as zero. Rows of
    a block that meets no vector at all are left out.
    """
    blocks = row_blocks(rows.where(F.size("cols") > 0).select("row", "cols", "vals"))
    kind = T.StructType([T.StructField("row", rows.schema["row"].dataType),
                         T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(b: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if b.empty or v.empty:
            return _empty("row", "vec")
        y = _products(b, v)[0]
        if normalize:
            norm = np.linalg.norm(y, axis=1, keepdims=True)
            y = np.divide(y, norm, out=np.zeros_like(y), where=norm > 0)
        return pd.DataFrame({"row": b["row"], "vec": list(y)})

    places = touched(blocks).join(vectors.select("col", "vec"), "col")
    return blocks.groupBy("block").cogroup(places.groupBy("at_block")).applyInPandas(run, kind)


def top_k_scores(users: DataFrame, items: DataFrame, k: int, mode: str = "profile",
                 allowed: DataFrame | None = None, block_rows: int = BLOCK_ROWS, digits: int = TIE_DIGITS) -> DataFrame:
    """(customer_id, rank, item_idx, score): the best k items of every user, exact, by bounded blocks of items.

    ``users`` rows carry ``(customer_id, cols, vals)``: the history columns
    (excluded from the result) and their weights; ``items`` is (item_idx, vec).
    The user vector is the weighted sum of the history's vectors,
    L2-normalised when ``mode`` is ``profile``. A user visits blocks of items in
    order of the greatest score they can hold and leaves when its k-th score
    can't be beaten (``vectorsearch``); only the history items of a block go along
    to it. Ties go to the lower item index (= article id order). ``allowed``
    (item_idx) limits the candidates.
    """
    if k <= 0:
        raise ValueError("k must be greater than zero")
    if mode not in ("raw", "profile"):
        raise ValueError("mode must be raw or profile")
    known = users.where(F.size("cols") > 0)
    vectors = project_rows(known.withColumnRenamed("customer_id", "row"), items.withColumnRenamed("item_idx", "col"),
                           normalize=mode == "profile")
    candidates = items if allowed is None else items.join(allowed.select("item_idx"), "item_idx", "left_semi")
    index = build_index(candidates.withColumn("item_idx", F.col("item_idx").cast("long")), "item_idx", "vec", block_rows)
    history = known.select(F.col("customer_id").alias("query_id"), F.explode("cols").alias("id")).withColumn("id", F.col("id").cast("long"))
    top = top_products(index, vectors.withColumnRenamed("row", "query_id"), k, history, digits)
    return top.select(F.col("query_id").alias("customer_id"), "rank", F.col("id").alias("item_idx"), "score")
