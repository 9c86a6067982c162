"""Quality classifier and importance resampling with hashed n-gram models.

Two bag models over hashed word uni- and bigrams are counted: one of the whole
corpus (raw) and one of documents labelled as good (target). A document's log
importance weight is the sum over its n-grams of log target - log raw. The mean
per n-gram, against a threshold calibrated on held-out labels, accepts or
rejects it; Gumbel noise added to the log weight and a top-k cut draw a sample
without replacement in proportion to the weights.

The raw model counts every n-gram of every document (summed per task before the
shuffle; the tables have ``buckets`` entries whatever the corpus). Labels are a
bounded sample: at most ``MAX_LABELLED`` rows by hash order, one half for the
target model, the other for the threshold.

Defined results: a text without n-grams (null, empty, blank) has weight and
score 0 and is accepted; repeated ids get the decision of their own text; a label that
contradicts another of the same id counts as the lower one, null labels as none;
without labels of both kinds nothing is rejected; equal keys at the cut are all
sampled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastebud.llm.common import small_batches

BUCKETS = 16_384
MAX_LABELLED = 40_000
KEEP_GOOD = 0.995
SMOOTHING = 1.0
BINS_PER_UNIT, MOST = 200, 10.0
CACHED_WORDS = 200_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
SCORED = T.StructType([T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())])
U = np.uint64


class WordCodes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return out


def ngrams(text: str | None, codes: WordCodes, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the word unigrams and bigrams of ``text`` (words and runs of punctuation, lower case)."""
    words = TOKEN.findall(text.lower()) if text else []
    h = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    one = h * U(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (h[1:] + U(1)) * U(0xC2B2AE3D27D4EB4F)) * U(0x9E3779B97F4A7C15)
    return (np.concatenate([one, two]) >> U(40)) % U(buckets)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # log target - log raw per bucket
    threshold: float     # least mean weight per n-gram that is accepted

    def scored(self, text: Column) -> Column:
        """Struct (n_grams, log_weight) of a text column."""
        shared = _session().sparkContext.broadcast(self.weights)

        @F.pandas_udf(SCORED)
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            codes, w = WordCodes(), shared.value
            for texts in batches:
                grams = [ngrams(t, codes, len(w)) for t in texts]
                yield pd.DataFrame({"n_grams": [len(g) for g in grams],
                                    "log_weight": [float(w[g].sum()) for g in grams]})

        return score(text)

    def accepts(self, scored: Column) -> Column:
        return (scored["n_grams"] == 0) | (mean_weight(scored) >= F.lit(self.threshold))


def _session():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def mean_weight(scored: Column) -> Column:
    return scored["log_weight"] / F.greatest(scored["n_grams"], F.lit(1))


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                    most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` labelled ids in hash order: (doc_id, good, fold)."""
    return (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good"))
            .where("doc_id is not null and good is not null")
            .groupBy("doc_id").agg(F.min("good").alias("good"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
            .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", buckets: int = BUCKETS, most_labelled: int = MAX_LABELLED,
        keep_good: float = KEEP_GOOD) -> QualityModel:
    small_batches(docs.sparkSession)
    sample = labelled_sample(labels, id_col, label_col, most_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = rows.join(F.broadcast(sample), "doc_id", "left")  # at most ``most_labelled`` rows
    target = (F.col("good") == 1) & (F.col("fold") == 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, raw, tgt = WordCodes(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for text, is_target in zip(b["text"], b["target"], strict=True):
                seen = np.bincount(ngrams(text, codes, buckets).astype(np.int64), minlength=buckets) \
                    if text and len(text) > buckets else None
                if seen is not None:
                    raw += seen
                    tgt += seen * int(is_target)
                else:
                    g = ngrams(text, codes, buckets).astype(np.int64)
                    np.add.at(raw, g, 1)
                    if is_target:
                        np.add.at(tgt, g, 1)
        used = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": used, "raw": raw[used], "target": tgt[used]})

    counts = (marked.select("text", F.coalesce(target, F.lit(False)).alias("target"))
              .mapInPandas(count, "bucket long, raw long, target long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
              .collect())  # at most ``buckets`` rows
    raw, tgt = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        tgt[r["bucket"]] += r["target"]
    if tgt.sum() <= SMOOTHING * buckets:
        return QualityModel(np.zeros(buckets), float("-inf"))
    model = QualityModel(np.log(tgt / tgt.sum()) - np.log(raw / raw.sum()), float("-inf"))

    held = rows.join(F.broadcast(sample.where("fold = 1")), "doc_id")
    level = F.least(F.greatest(mean_weight(F.col("s")), F.lit(-MOST)), F.lit(MOST))
    bins = (held.select("good", model.scored(F.col("text")).alias("s"))
            .groupBy("good", F.floor(level * BINS_PER_UNIT).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .collect())  # at most 2 * 4,001 rows
    return QualityModel(model.weights, threshold({(r["good"], r["bin"]): r["n"] for r in bins}, keep_good))


def threshold(bins: dict[tuple[int, int], int], keep_good: float = KEEP_GOOD) -> float:
    """The cut that rejects most bad documents and keeps ``keep_good`` of the good ones of the held-out half."""
    good = {b: n for (g, b), n in bins.items() if g == 1}
    bad = {b: n for (g, b), n in bins.items() if g != 1}
    if not good or not bad:
        return float("-inf")
    best, cut, lost, caught, last = 0.0, float("-inf"), 0, 0, 0
    all_good, all_bad = sum(good.values()), sum(bad.values())
    for b in sorted({*good, *bad}):  # rejecting everything below b
        gain = caught / all_bad - lost / all_good
        if lost <= (1 - keep_good) * all_good and gain > best:
            best, cut = gain, (last + 1) / BINS_PER_UNIT  # just above what is rejected
        lost += good.get(b, 0)
        caught += bad.get(b, 0)
        last = b
    return cut


def gumbel_key(log_weight: Column, seed: int, *row: Column) -> Column:
    """Log weight plus Gumbel noise drawn from a hash of the row and the seed."""
    bits = F.shiftrightunsigned(F.xxhash64(*row, F.lit(seed)), 11)
    u = (bits.cast("double") + 0.5) / F.lit(float(2**53))
    return log_weight - F.log(-F.log(u))


def kth_largest(values: DataFrame, col: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a column by narrowing histograms: ``bins`` rows reach the driver at a time."""
    if k <= 0:
        return None
    lo, hi, n = values.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n:
        return None
    if k >= n:
        return lo
    rank = k  # within [lo, hi]
    while lo < hi:
        width = (hi - lo) / bins
        inside = values.where((F.col(col) >= lo) & (F.col(col) <= hi))
        cell = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        cells = (inside.groupBy(cell.alias("cell"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect())
        for r in sorted(cells, key=lambda r: -r["lo"]):
            if rank <= r["n"]:
                if len(cells) == 1 and (r["lo"], r["hi"]) == (lo, hi):
                    # Cells as narrow as doubles allow: walk the distinct values of this one cell.
                    for v in inside.groupBy(col).count().orderBy(F.desc(col)).toLocalIterator():
                        if rank <= v["count"]:
                            return v[col]
                        rank -= v["count"]
                lo, hi = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return lo


def resample(scored: DataFrame, k: int, key_col: str = "gumbel_key") -> DataFrame:
    """``scored`` with boolean ``sampled``: the rows of the k largest keys among the accepted ones (``kept``)."""
    cut = kth_largest(scored.where("kept").select(key_col), key_col, k)
    chosen = F.lit(False) if cut is None else F.col("kept") & (F.col(key_col) >= F.lit(cut))
    return scored.withColumn("sampled", chosen)
