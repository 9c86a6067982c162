"""Line dedup: lines that several documents share stay in one of them only.

1. Every text is split at line feeds; a line's key is the line without blanks at
   both ends, A to Z in lower case. Keys of at least ``least_chars`` code points
   are hashed to 128 bits and written once, with the place of their row and line.
2. Per hash the distinct documents are counted and the largest id kept. Both
   aggregates combine before they shuffle, so a line of a third of all documents
   is a few rows by the time it meets others of its hash.
3. Lines whose hash reaches ``least_docs`` are dropped, but those of the largest
   id. The positions a text loses meet the text again by the place of its row
   (a hash of id and text): one shuffle of the texts, no key more frequent than
   its exact repetitions, which AQE splits.
4. Each text is put together again from the lines that stay, by position.

DataFrame functions only. Every lambda works on its own elements, so a text of
many lines costs time in proportion to them.

Defined results: a null text is an empty one (one empty line); a text keeps its
carriage returns and blanks, as only keys are normalised; rows that share an id
are one document, and a shared line stays in all rows of the id that keeps it;
rows without an id are one document too, smaller than all others; a key that
repeats within one document counts once and loses all its lines or none;
repeated rows stay repeated; an empty table gives no rows; other columns pass,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastebud.llm.common import fresh, materialise

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS = 20, 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without blanks at both ends, A to Z in lower case and no other letter changed."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(names: tuple[str, str], *of: Column) -> list[Column]:
    """Two independent 64-bit hashes, as columns of the two names."""
    return [F.xxhash64(F.lit(seed), *of).alias(name) for seed, name in enumerate(names)]


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
                 least_docs: int = LEAST_DOCS) -> DataFrame:
    """(p1, p2, dropped): the place of each row that loses lines, and their positions, ascending."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *_hashes(("p1", "p2"), F.col(id_col), text))
    lines = rows.select("id", "p1", "p2", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("id", "p1", "p2", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    keyed = materialise(docs.sparkSession, keyed.select("id", "p1", "p2", "pos", *_hashes(("h1", "h2"), F.col("key"))), "lines")
    spread = (keyed.select("h1", "h2", "id").distinct().groupBy("h1", "h2")
              .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_docs))
    # Written, so that the join reads two plain shuffles, of which AQE splits the one a common line makes uneven.
    spread = materialise(docs.sparkSession, spread.select("h1", "h2", "keeper"), "shared")
    lost = keyed.join(spread, ["h1", "h2"]).where(F.col("id").isNull() | (F.col("id") != F.col("keeper")))
    return lost.groupBy("p1", "p2").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def without(lines: Column, dropped: Column) -> Column:
    """``lines`` without those at the ascending positions ``dropped``."""
    before = F.slice(F.concat(F.array(F.lit(-1)), dropped), F.lit(1), F.size(dropped))
    gaps = F.zip_with(dropped, before, lambda d, b: d - b - 1)
    flags = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True)))))
    marked = F.zip_with(lines, flags, lambda x, f: F.struct(x.alias("line"), F.coalesce(f, F.lit(False)).alias("gone")))
    return F.transform(F.filter(marked, lambda x: ~x["gone"]), lambda x: x["line"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: str = "kept_text",
                n_lines: str = "n_lines", n_dropped: str = "n_dropped", least_chars: int = LEAST_CHARS,
                least_docs: int = LEAST_DOCS) -> DataFrame:
    """Every row of ``docs`` with its text less the shared lines, its lines before and the number dropped."""
    names = []
    for wanted in ("p1", "p2", "dropped"):
        names.append(fresh(docs, wanted))
    shared = shared_lines(docs, id_col, text_col, least_chars, least_docs)
    shared = shared.select(*[F.col(c).alias(n) for c, n in zip(("p1", "p2", "dropped"), names, strict=True)])
    text, dropped = F.col(text_col), F.col(names[2])
    rows = docs.select("*", *_hashes((names[0], names[1]), F.col(id_col), text)).join(shared, names[:2], "left")
    new = {kept: F.when(dropped.isNull(), F.coalesce(text, F.lit("")))
                  .otherwise(F.array_join(without(lines_of(text), dropped), "\n")),
           n_lines: F.size(lines_of(text)).cast("long"),
           n_dropped: F.coalesce(F.size(dropped), F.lit(0)).cast("long")}
    return rows.select(*[F.col(c) for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])
