"""Spelling variants: words one edit apart, found by an index of variable-length grams.

1. Words are counted within tasks (bounded tables, flushed when full) and summed.
2. Gram dictionary: a gram is extended, from two characters up to five, as long
   as it is frequent among the words; frequent grams are at most ``FREQUENT`` of
   each length by the definition of the cut, so the broadcast has a fixed bound.
   A word is wrapped in a start and an end mark and has one gram for each of its
   starts: the shortest prefix there that is not frequent, meets the end or is
   four long. What a gram is follows from the characters it spans alone.
3. Affected grams: an edit changes the grams that span its place and leaves all
   others as they are, at the same distance from the start or from the end. The
   number affected is at most the largest number that span one place. Of its
   grams a word takes some that no place is spanned by all of, those of the
   shortest lists: at least one (taken less affected) is then found in every word
   one edit away. Words of six letters and more always have such grams.
4. The posting lists of the taken grams, for the same and the next length and the
   positions that an edit before or after leaves, are merged, and their words
   verified. Short words go along in the lists and are verified before anything
   is shuffled again; long ones (over ``CARRIED`` letters) are fetched by id.
5. A word's form is its near word of largest count; roots are followed by
   doubling, as counts grow at least ``ratio`` times along a chain.

Defined results: null texts have no words; a null id counts as an empty one in
the deletion rule; ties go to the smallest word in code-point order; repeated
rows count again; very long runs are words like others; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastebud.llm.common import materialise, small_batches

RUN = re.compile("[A-Za-zÀ-ÿ]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
SHORTEST, LONGEST, FREQUENT = 2, 4, 65_536
CARRIED = 48
TABLE_ROWS, TABLE_CHARS, BATCH_ROWS = 200_000, 16 * 1024 * 1024, 20_000


class Table(Counter):
    """Counts of strings that report when they outgrow their bound."""
    chars = 0

    def add(self, word: str, n: int) -> bool:
        if word not in self:
            self.chars += len(word)
        self[word] += n
        return len(self) >= TABLE_ROWS or self.chars >= TABLE_CHARS

    def rows(self, name: str) -> Iterator[pd.DataFrame]:
        words, counts = np.array(list(self), object), np.fromiter(self.values(), np.int64, len(self))
        self.clear()
        self.chars = 0
        for at in range(0, len(words), BATCH_ROWS):
            yield pd.DataFrame({name: words[at:at + BATCH_ROWS], "n": counts[at:at + BATCH_ROWS]})


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(A_TO_Z)


def runs_of(text: str, doc_id: str, delete_every: int | None) -> Iterator[tuple[str, int]]:
    """The words of one text with their counts; ``delete_every`` is the deletion rule's divisor, if any."""
    counts = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        counts[lowered(run)] += n
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in counts.items():
        if delete_every:
            h = zlib.crc32(run.encode(), start)
            if h % delete_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
        yield run, n


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, delete_every: int | None = None) -> DataFrame:
    """(word, n) of all words of the documents that are long and frequent enough."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table()
        for b in batches:
            for doc_id, text in zip(b["id"], b["text"], strict=True):
                if not text:
                    continue
                for word, n in runs_of(text, doc_id, delete_every):
                    if len(word) >= least_length and table.add(word, n):
                        yield from table.rows("word")
        yield from table.rows("word")

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return (rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def gram_dictionary(words: DataFrame) -> frozenset[str]:
    """The frequent grams: those of more than one in ``FREQUENT`` of all gram positions, and more than eight."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table()
        for b in batches:
            for word in b["word"]:
                s = "^" + word
                for p in range(len(s)):
                    for e in range(p + SHORTEST, min(p + LONGEST, len(s) + 1)):
                        if table.add(s[p:e], 1):
                            yield from table.rows("gram")
        yield from table.rows("gram")

    counts = words.select("word").mapInPandas(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    positions = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    often = counts.where(F.col("n") > max(8, positions / FREQUENT)).select("gram").toPandas()
    return frozenset(often["gram"])


def decompose(word: str, frequent: frozenset[str]) -> list[tuple[int, int, str]]:
    """(start, end, gram) for every start of the word between its marks; ends are exclusive."""
    s = "^" + word + "$"
    out = []
    for p in range(len(s) - 1):
        e = p + SHORTEST
        while e < len(s) and e - p < LONGEST and s[p:e] in frequent:
            e += 1
        out.append((p, e, s[p:e]))
    return out


def affected(grams: list[tuple[int, int, str]]) -> int:
    """The largest number of grams that span one place: all that one edit can change."""
    open_, most, now = sorted((x for p, e, _ in grams for x in ((p, 1), (e, -1)))), 0, 0
    for _, step in open_:
        now += step
        most = max(most, now)
    return most


def taken(grams: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Of (start, end, gram, list size) the cheapest that are one more than an edit can affect.

    Intervals without a common place hold two that are apart, so the cheapest
    choice is a pair: for each gram the one of the shortest list that ends before it.
    """
    by_end, before, best = sorted(grams, key=lambda g: g[1]), [], None
    least = None
    at = 0
    for g in sorted(grams, key=lambda g: g[0]):
        while at < len(by_end) and by_end[at][1] <= g[0]:
            if least is None or by_end[at][3] < least[3]:
                least = by_end[at]
            at += 1
        if least is not None and (best is None or least[3] + g[3] < best):
            best, before = least[3] + g[3], [least, g]
    return before


def postings(words: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """(id, size, p, e, gram, word) for every gram of every word; only words of up to ``CARRIED`` letters go along."""
    known = words.sparkSession.sparkContext.broadcast(frequent)
    columns = ["id", "size", "p", "e", "gram", "word"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for b in batches:
            for key, word in zip(b["id"], b["word"], strict=True):
                carried = word if len(word) <= CARRIED else None
                for p, e, gram in decompose(word, known.value):
                    rows.append((key, len(word), p, e, gram, carried))
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return words.select("id", "word").mapInPandas(run, "id long, size long, p long, e long, gram string, word string")


def probes(lists: DataFrame) -> DataFrame:
    """(id, own, word, gram, p, size): the lists in which a word looks for near words of its own length and the next."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, size, word, grams in zip(b["id"], b["size"], b["word"], b["grams"], strict=True):
                for p, _, gram, _ in taken([(g["p"], g["e"], g["gram"], g["n"]) for g in grams]):
                    # Left of the edit a gram keeps its start, right of it its distance from the end.
                    rows += [(key, size, word, gram, p + shift, size + longer) for shift, longer in ((0, 0), (0, 1), (1, 1))]
            yield pd.DataFrame(rows, columns=["id", "own", "word", "gram", "p", "size"])

    at = ["gram", "p", "size"]
    lengths = lists.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    grams = (lists.join(lengths, at).groupBy("id", "size", "word")
             .agg(F.collect_list(F.struct("p", "e", "gram", "n")).alias("grams")))
    return grams.mapInPandas(run, "id long, own long, word string, gram string, p long, size long")


def near_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(id, other) of all ordered pairs of words one inserted, deleted or replaced code point apart."""
    lists = materialise(spark, postings(words, gram_dictionary(words)), "postings")
    at = ["gram", "p", "size"]
    partners = lists.select(*at, F.col("id").alias("other"), F.col("word").alias("other_word"))
    # Words of one length find each other both ways; the shorter of two finds the longer.
    met = probes(lists).join(partners, at).where((F.col("id") < F.col("other")) | (F.col("own") < F.col("size")))
    known = F.col("word").isNotNull() & F.col("other_word").isNotNull()
    near = F.levenshtein("word", "other_word", 1) == 1
    merged = (met.where(~known | near).groupBy("id", "other").agg(F.bool_or(known).alias("near"))
              .select("id", "other", "near"))
    merged = materialise(spark, merged, "near")
    long = (merged.where(~F.col("near")).join(words.select("id", "word"), "id")
            .join(words.select(F.col("id").alias("other"), F.col("word").alias("other_word")), "other")
            .where(near).select("id", "other"))
    pairs = merged.where("near").select("id", "other").union(long.select("id", "other"))
    return pairs.union(pairs.select(F.col("other").alias("id"), F.col("id").alias("other")))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to the last; every round doubles the links passed."""
    now = materialise(spark, forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                        F.col("next").isNotNull().alias("moved"))
        step = materialise(spark, step, "roots")
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO,
                      delete_every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the documents."""
    if least_length < LEAST_LENGTH:
        raise ValueError(f"words under {LEAST_LENGTH} letters may have no two grams apart")
    spark = docs.sparkSession
    small_batches(spark)
    counted = count_words(docs, id_col, text_col, least_length, least_count, delete_every)
    words = materialise(spark, counted.withColumn("id", F.monotonically_increasing_id()), "words")
    others = words.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (near_words(spark, words).join(others, "other").groupBy("id")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")))
    near = words.join(best, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.order") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.order") >= ratio * F.col("n"), -F.col("best.order")).alias("form_n"))
    near = materialise(spark, near, "near")
    return near.join(roots(spark, near.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
