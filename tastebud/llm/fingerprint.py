"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is the multiset of its paragraphs (trimmed, non-empty lines). Each
paragraph's SHA-256 is expanded to a wide vector of 192 small integers packed
four to a 64-bit word, and a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo 2^14, beside the number of paragraphs. Sums don't
depend on the order, and a paragraph is inserted or deleted by adding or
subtracting its vector.

The first 64 lanes take uniform values: equal fingerprints mean equal multisets.
The other 128 lanes take 0 or 1, read as random signs: the mean square of the
lanes' difference estimates how many paragraphs differ, which gives the likeness
of two fingerprints without the texts (1 for equal multisets, about 0 for
disjoint ones).

Defined results: null, empty and blank texts have no paragraphs and fingerprint
zero, alike to each other (1) and to nothing else (0). Rows that repeat an id are
ordered by their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIFORM_WORDS, SIGN_WORDS = 16, 32
LANES = 0x3FFF3FFF3FFF3FFF  # four lanes of 14 bits; the gaps take the carries
BITS = 0x0001000100010001
MODULUS = 1 << 14
WORDS = UNIFORM_WORDS + SIGN_WORDS


def paragraphs(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.trim(p))
    return F.filter(trimmed, lambda p: p != "")


def vector(digest: Column) -> Column:
    """The packed lanes of one paragraph, after the paragraph count 1."""
    words = [F.xxhash64(digest, F.lit(i)).bitwiseAND(F.lit(LANES if i < UNIFORM_WORDS else BITS)) for i in range(WORDS)]
    return F.array(F.lit(1).cast("long"), *words)


def zero() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), WORDS + 1)


def _plus(x: Column, y: Column) -> Column:
    return (x + y).bitwiseAND(F.lit(LANES))


def _minus(x: Column, y: Column) -> Column:
    # Lane-wise negation modulo 2^14 is complement plus one.
    return _plus(x, _plus(y.bitwiseXOR(F.lit(LANES)), F.lit(BITS)))


def _lanewise(a: Column, b: Column, op, count) -> Column:
    lanes = F.zip_with(F.slice(a, 2, WORDS), F.slice(b, 2, WORDS), op)
    return F.concat(F.array(count(F.element_at(a, 1), F.element_at(b, 1))), lanes)


def insert(fp: Column, paragraph: Column) -> Column:
    return combine(fp, vector(F.sha2(F.trim(paragraph), 256)))


def delete(fp: Column, paragraph: Column) -> Column:
    return _lanewise(fp, vector(F.sha2(F.trim(paragraph), 256)), _minus, lambda x, y: x - y)


def combine(a: Column, b: Column) -> Column:
    """Fingerprint of the two multisets together."""
    return _lanewise(a, b, _plus, lambda x, y: x + y)


def fingerprint(text: Column) -> Column:
    """array<bigint>: paragraph count and packed lane sums. The count stays below 2^62, the mask keeps it."""
    digests = F.transform(paragraphs(text), lambda p: F.sha2(p, 256))
    lanes = F.aggregate(digests, zero(), lambda acc, d: F.zip_with(acc, vector(d), _plus))
    return F.concat(F.array(F.size(digests).cast("long")), F.slice(lanes, 2, WORDS))


def as_hex(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _lane(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(MODULUS - 1))


def _centred(x: Column) -> Column:
    return F.pmod(x + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2


def _squares(words: Column, n: Column) -> Column:
    """Sum over the sign lanes of the squared signed sum of n paragraphs."""
    def one(x):
        signed = [_centred(2 * _lane(x, i) - n) for i in range(4)]
        return reduce(lambda p, q: p + q, (s * s for s in signed))
    return F.aggregate(F.transform(words, one), F.lit(0).cast("long"), lambda acc, s: acc + s)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share (0 to 1) of common paragraphs, 2 |A and B| / (|A| + |B|) with multiplicity."""
    wa, wb = F.slice(a, UNIFORM_WORDS + 2, SIGN_WORDS), F.slice(b, UNIFORM_WORDS + 2, SIGN_WORDS)
    na, nb = F.element_at(a, 1), F.element_at(b, 1)
    apart = _squares(F.zip_with(wa, wb, _minus), na - nb).cast("double")
    total = (_squares(wa, na) + _squares(wb, nb)).cast("double")
    near = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), apart / F.nullif(total, F.lit(0.0))))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(near, F.lit(0.0)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): each document with the next one by descending id, cyclically.

    Ids are cut into blocks at quantiles, the rows of a block are ordered in
    one task, and the first row of each block stands as a guest at the end of
    the block before it. Texts are shuffled once; the table of first ids has
    one row per block.
    """
    spark = docs.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-2**63)))
    cuts = sorted(set(rows.agg(F.percentile_approx("k", [i / blocks for i in range(1, blocks)] or [0.5], 20 * blocks))
                      .first()[0] or []))
    # Two levels, so that a row looks at few cuts however many blocks there are.
    step = max(1, round(len(cuts) ** 0.5))
    upper = cuts[step - 1::step]
    lower = [cuts[i:i + step] for i in range(0, len(cuts) + 1, step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<bigint>")
    coarse = F.size(F.filter(longs(upper), lambda c: c < F.col("k")))
    fine = F.element_at(F.array(*[longs(x) for x in lower]), coarse + 1)
    block = (coarse * step + F.size(F.filter(fine, lambda c: c < F.col("k")))).cast("int")
    heads = sorted((r["block"], r["k"]) for r in  # one row per block
                   rows.select(block.alias("block"), "k").groupBy("block").agg(F.max("k").alias("k")).collect())
    # The head of a block follows the last row of the next higher block; the very first follows the very last.
    hosts = [(k, heads[(i + 1) % len(heads)][0]) for i, (_, k) in enumerate(heads)]
    host = F.broadcast(spark.createDataFrame(hosts, "k long, host int"))
    placed = (rows.withColumn("block", block).withColumn("fp", fingerprint(F.col("text"))).join(host, "k", "left"))
    own = F.struct(F.col("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("block"), F.lit(True).alias("guest"))
    dealt = (placed.select("doc_id", "k", "text", "fp", F.inline(
        F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at_block", "guest")))
    order = Window.partitionBy("at_block").orderBy("guest", F.desc("k"), "text")
    return (dealt.select("doc_id", "text", "fp", "guest", F.lead("text").over(order).alias("next_text"),
                         F.lead("fp").over(order).alias("next_fp"))
            .where(~F.col("guest")).drop("guest"))
