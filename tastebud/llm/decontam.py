"""Benchmark decontamination by Wu-Manber multi-pattern search.

The benchmark becomes a set of byte patterns: every window of ten consecutive
words, each word between single spaces. A document is brought to the same form
once and searched for all patterns together. Per class of pattern lengths a
block-shift table says how far the search may jump after looking at the last
``BLOCK`` bytes of the search window; where it may not jump, the bucket of that
suffix block (split by the first bytes) names the few patterns worth a direct
comparison. A jump is as long as the shortest pattern of its class, so long and
short patterns are searched separately.

The patterns go to the executors in blocks of at most ``max_pattern_bytes``; a
larger benchmark takes several passes, each adding to the hits of the one
before, so neither a broadcast nor a worker's tables grow past the bound.

Defined results: a null or empty text has no words and no hits; items without
words give no window; repeated items and rows change nothing; an item with a
null id is named ``null``; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastebud.llm.common import materialise, small_batches

WINDOW = 10
BLOCK = 8
LENGTH_CLASSES = (8, 16, 32, 64)
MAX_PATTERN_BYTES = 32 * 1024 * 1024
WORD_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])

# ASCII letters and digits stay (A-Z in lower case), other ASCII becomes a space,
# bytes of multi-byte characters stay.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
             for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """Every window of ``size`` words as ``b" w1 ... wn "``; fewer words are one window, none is none."""
    if not words:
        return []
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Search of all patterns at once; ``find`` yields (start byte, pattern number)."""

    def __init__(self, patterns: list[bytes], block: int = BLOCK):
        classes: dict[int, list[int]] = {}
        for k, p in enumerate(patterns):
            classes.setdefault(sum(len(p) >= c for c in LENGTH_CLASSES), []).append(k)
        self.tables = [self._table(patterns, ks, block) for _, ks in sorted(classes.items())]

    @staticmethod
    def _table(patterns, ks, block):
        shortest = min(len(patterns[k]) for k in ks)
        width = min(block, shortest)
        shift: dict[bytes, int] = {}
        buckets: dict[bytes, dict[bytes, list[tuple[bytes, int]]]] = {}
        for k in ks:
            p = patterns[k]
            for end in range(width, shortest + 1):
                b = p[end - width:end]
                if shortest - end < shift.get(b, shortest):
                    shift[b] = shortest - end
            buckets.setdefault(p[shortest - width:shortest], {}).setdefault(p[:width], []).append((p, k))
        return shortest, width, shift, buckets

    def find(self, data: bytes) -> Iterator[tuple[int, int]]:
        n = len(data)
        for shortest, width, shift, buckets in self.tables:
            jump, get, end = shortest - width + 1, shift.get, shortest
            while end <= n:
                block = data[end - width:end]
                step = get(block, jump)
                if step:
                    end += step
                    continue
                start = end - shortest
                for p, k in buckets[block].get(data[start:start + width], ()):
                    if data.startswith(p, start):
                        yield start, k
                end += 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(matcher: WuManber, patterns: list[tuple[bytes, list[str]]], text, before) -> dict:
    words = words_of(text)
    spans = [(s["start"], s["end"]) for s in before["spans"]] if before is not None else []
    items = set(before["items"]) if before is not None else set()
    if words:
        data = b" " + b" ".join(words) + b" "
        at = word = 0
        for start, k in matcher.find(data):
            if start < at:  # the next class of lengths begins at the front again
                at = word = 0
            word += data.count(b" ", at, start)
            at = start
            spans.append((word, word + patterns[k][0].count(b" ") - 1))
            items.update(patterns[k][1])
    return {"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in merged(spans)],
            "items": sorted(items)}


_MATCHERS: dict[str, tuple] = {}


def _hits_udf(spark, patterns: list[tuple[bytes, list[str]]], key: str):
    shared = spark.sparkContext.broadcast(patterns)

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        if key not in _MATCHERS:  # one set of tables per worker process
            _MATCHERS.clear()
            _MATCHERS[key] = WuManber([p for p, _ in shared.value]), shared.value
        matcher, named = _MATCHERS[key]
        for texts, before in batches:
            had = before.to_dict("records") if "items" in before else [None] * len(texts)
            yield pd.DataFrame([_search(matcher, named, t, b if b is not None and b["items"] is not None else None)
                                for t, b in zip(texts, had, strict=True)], columns=["n_words", "spans", "items"])

    return hits


def pattern_table(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """Distinct window patterns with the sorted ids of the items they come from."""
    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def windows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(windows_of(words_of(t), window))))

    return (benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                             F.explode(windows(F.col(text_col))).alias("pattern"))
            .groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items")))


def pattern_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
                   max_pattern_bytes: int = MAX_PATTERN_BYTES) -> Iterator[list[tuple[bytes, list[str]]]]:
    """The patterns in blocks of about ``max_pattern_bytes``, one on the driver at a time."""
    spark = benchmark.sparkSession
    small_batches(spark)
    pats = materialise(spark, pattern_table(benchmark, id_col, text_col, window), "patterns")
    total = pats.agg(F.sum(F.length("pattern") + F.lit(16) * F.size("items"))).first()[0] or 0
    blocks = max(1, -(-total // max_pattern_bytes))
    for b in range(blocks):
        part = pats.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b) if blocks > 1 else pats
        yield [(bytes(r["pattern"]), list(r["items"])) for r in part.toLocalIterator()]


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "hits",
              id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
              max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, merged word spans [start, end) of window occurrences, item ids.

    No shuffle: each row is searched where it lies. With more than one block
    of patterns the rows are written between the passes.
    """
    spark = docs.sparkSession
    df = None
    for number, patterns in enumerate(pattern_blocks(benchmark, id_col, item_text_col, window, max_pattern_bytes)):
        if df is None:
            before: Column = F.lit(None).cast(HITS)
            df = docs
        else:
            df = materialise(spark, df, "hits")
            before = F.col(out)
        key = f"{id(patterns)}-{number}-{spark.sparkContext.applicationId}-{len(patterns)}"
        df = df.withColumn(out, _hits_udf(spark, patterns, key)(F.col(text_col), before))
    return df


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
