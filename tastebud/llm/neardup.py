"""Near-duplicate groups by b-bit MinHash.

1. Each text becomes its set of distinct word shingles (64-bit hashes), 128
   minima of that set, 24 bands of 4 minima, and a signature that keeps the low
   4 bits of each minimum, packed into eight 64-bit words. Texts with the same
   set (exact copies above all) are one node from here on.
2. Nodes that share a band bucket are candidates. A bucket is not expanded into
   pairs: its members are first compared with one member, the one that shares
   most buckets with others (the original of a group of copies, as a rule).
3. The signatures' equal parts are counted by bit operations; after correction
   for chance collisions they estimate the similarity. Pairs whose estimate is
   more than five standard errors below the threshold are dropped, the others
   are confirmed on the full shingle sets.
4. Confirmed links are merged into components. A bucket that still holds more
   than one component is searched again, only across its components, so that no
   link between different texts that share a bucket is left out: what is never
   looked at is a pair already known to be connected.

A pair at the threshold shares no bucket with probability (1 - 0.8^4)^24, about
3 in a million; more similar pairs less.

Defined results: a null text or a text without words has an empty set, is linked
with nothing and kept; repeated rows share a component; a null id never becomes
a component's name unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastebud.llm.common import materialise, small_batches

HASHES, ROWS, BANDS, BITS = 128, 4, 24, 4
WORDS_OUT = HASHES * BITS // 64
LOW = 0x1111111111111111
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
U = np.uint64
_seeds = np.random.Generator(np.random.PCG64(20240101))
MULTIPLY = _seeds.integers(0, 2**63, HASHES, dtype=np.uint64) * U(2) + U(1)
ADD = _seeds.integers(0, 2**63, HASHES, dtype=np.uint64)
CACHED_WORDS = 200_000
SIGNATURE = [f"s{i}" for i in range(WORDS_OUT)]
SKETCH = ("doc_id long, place binary, n_shingles long, digest binary, bands array<long>, "
          + ", ".join(f"{s} long" for s in SIGNATURE))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of ``text`` (the whole sequence if it is shorter)."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def minima(items: np.ndarray, block: int = 2048) -> np.ndarray:
    """The 128 minima of a non-empty set, block by block."""
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(items), block):
        out = np.minimum(out, (items[i:i + block, None] * MULTIPLY + ADD).min(axis=0))
    return out


def sketch(items: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Digest of the set, band hashes and packed low bits."""
    low = minima(items)
    band = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        band = mix(band + low[r:BANDS * ROWS:ROWS])
    bits = (mix(low) & U(2**BITS - 1)).reshape(WORDS_OUT, -1)
    packed = np.bitwise_or.reduce(bits << (np.arange(bits.shape[1], dtype=np.uint64) * U(BITS)), axis=1)
    return xxhash.xxh3_128_digest(items.tobytes()), band.view(np.int64), packed.view(np.int64)


def place_of(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What names a row: a digest of its id and text; null for a null text."""
    name = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null"))
    return F.unhex(F.sha2(F.concat(name, F.lit(":"), F.col(text_col)).cast("binary"), 256))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for doc_id, place, text in zip(b["doc_id"].astype("Int64"), b["place"], b["text"], strict=True):
                items = shingles(text, size, hashes)
                if len(items):
                    digest, band, packed = sketch(items)
                    rows.append((doc_id, place, len(items), digest, band, *packed.tolist()))
                else:
                    rows.append((doc_id, place, 0, None, None, *[None] * WORDS_OUT))
            out = pd.DataFrame(rows, columns=["doc_id", "place", "n_shingles", "digest", "bands", *SIGNATURE])
            yield out.astype({"doc_id": "Int64"} | {s: "Int64" for s in SIGNATURE})

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), place_of(id_col, text_col).alias("place"),
                        F.col(text_col).alias("text"))
            .mapInPandas(run, SKETCH))


def unequal(a: Column, b: Column) -> Column:
    """Number of 4-bit parts in which two signature words differ."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(LOW)))


def estimate(a: str, b: str) -> Column:
    """Similarity estimated from the signatures of two sides, corrected for chance collisions."""
    differ = reduce(lambda x, y: x + y, (unequal(F.col(f"{a}.{s}"), F.col(f"{b}.{s}")) for s in SIGNATURE))
    chance = 1 / 2**BITS
    return ((1 - differ / F.lit(HASHES)) - F.lit(chance)) / F.lit(1 - chance)


def least_estimate(threshold: float) -> float:
    """Five standard errors below the threshold."""
    chance = 1 / 2**BITS
    p = threshold + (1 - threshold) * chance
    return threshold - 5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def texts_of(docs: DataFrame, nodes: DataFrame, digests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, text) of the very row each of the wanted digests was drawn from, one row per digest."""
    wanted = digests.join(nodes.select("digest", "place"), "digest")
    texts = docs.select(place_of(id_col, text_col).alias("place"), F.col(text_col).alias("text"))
    return texts.join(wanted, "place").select("digest", "text").dropDuplicates(["digest"])  # rows may repeat


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) of digests whose full sets have intersection / union >= numerator / denominator."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last = WordHashes(), {}

        def items(text, digest):
            # The sets of the last texts: neighbours in the sorted join share a side.
            if digest not in last:
                if len(last) >= 64:
                    last.clear()
                last[digest] = shingles(text, size, hashes)
            return last[digest]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                x, y = items(ta, bytes(a)), items(tb, bytes(b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if denominator * both >= numerator * (len(x) + len(y) - both):
                    keep.append((a, b))
            yield pd.DataFrame(keep, columns=["a", "b"])

    left = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a binary, b binary")


def against_centre(near: DataFrame, centres: DataFrame, texts: DataFrame, size: int, numerator: int = 80,
                   denominator: int = 100) -> DataFrame:
    """``near`` with the set size n and the items by which it is apart from the centre of ``main``.

    Items of the set itself come as their hash, items of the centre that it lacks
    as its complement. Sets that differ from the centre in more than they hold
    are better told apart by their own items (``own``, as if the centre were
    empty). With threshold t and r = (1 - t) / (1 + t) any partner of such a set
    differs in over t (1 - r) - r of its size (0.6 for 0.8), and sets from there to
    1 have both; what a set does not need is null. No array is longer than its set.
    """
    t, r = numerator / denominator, (denominator - numerator) / (denominator + numerator)
    from_share = t * (1 - r) - r - 1e-9

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, centre, middle = WordHashes(), None, None
        for b in batches:
            rows = []
            for main, digest, comp, apart, text, at, centre_text in b.itertuples(index=False, name=None):
                items = shingles(text, size, hashes)
                if bytes(at) != centre:
                    centre, middle = bytes(at), shingles(centre_text, size, hashes)
                own = np.setdiff1d(items, middle, assume_unique=True)
                lacks = len(middle) - (len(items) - len(own))
                by_centre = by_itself = None
                if len(own) + lacks <= len(items):
                    by_centre = np.concatenate([own, ~np.setdiff1d(middle, items, assume_unique=True)]).view(np.int64)
                if len(own) + lacks > from_share * len(items):
                    by_itself = items.view(np.int64)
                rows.append((main, digest, comp, apart, len(items), by_centre, by_itself))
            yield pd.DataFrame(rows, columns=["main", "digest", "comp", "apart", "n", "apart_by", "own"])

    rows = (near.join(texts, "digest").join(centres, "main")
            .join(texts.select(F.col("digest").alias("centre"), F.col("text").alias("centre_text")), "centre")
            .select("main", "digest", "comp", "apart", "text", "centre", "centre_text"))
    return rows.mapInPandas(run, "main binary, digest binary, comp binary, apart boolean, n long, apart_by array<long>, own array<long>")


def possible_pairs(beside: DataFrame, centres: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) of digests across components, at least one apart, that reach the threshold; no link is left out.

    Two sets of n and m items reach it if they differ in at most
    (n + m) * (denominator - numerator) / (denominator + numerator) items, and they
    differ where just one of them differs from the centre. So of d and e items
    that part them from the centre they need (d + e - allowed) / 2 in common. Sets
    that need none are both linked with the centre itself, which is asked alone.
    Others share an item among the rarest d - need + 1 of the one and the rarest
    e - need + 1 of the other; need is that of the pair, so that sets at some
    distance from the centre meet on rare items only.
    """
    def allowed(n, m):
        return F.floor((n + m) * (denominator - numerator) / F.lit(denominator + numerator))

    group = ["main", "side"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("apart_by")), F.struct(F.lit(1).alias("side"), F.col("own").alias("apart_by"))))
    sets = (beside.select("main", "digest", "comp", "apart", "n", sides.alias("by")).where("by.apart_by is not null")
            .select("main", "by.side", "digest", "comp", "apart", "n", "by.apart_by").withColumn("d", F.size("apart_by")))
    items = sets.select(*group, "digest", "comp", "apart", "n", "d", F.explode("apart_by").alias("item"))
    spread = items.groupBy(*group, "item").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 1)
    rarest = Window.partitionBy(*group, "digest").orderBy(F.coalesce("held", F.lit(1)), "item")
    # Items of one set alone hold the first places and then meet nothing.
    placed = (items.join(spread, [*group, "item"], "left").withColumn("place", F.row_number().over(rarest))
              .where(F.col("held").isNotNull()).select(*group, "item", "digest", "comp", "apart", "n", "d", "place"))
    need = F.ceil((F.col("x.d") + F.col("y.d") - allowed(F.col("x.n"), F.col("y.n"))) / 2)
    met = (placed.where("apart").alias("x").join(placed.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*group, "item")])
           .where((F.col("x.comp") != F.col("y.comp")) & (~F.col("y.apart") | (F.col("x.digest") < F.col("y.digest")))
                  & (F.least("x.n", "y.n") * denominator >= F.greatest("x.n", "y.n") * numerator)
                  & (F.col("x.place") <= F.col("x.d") - need + 1) & (F.col("y.place") <= F.col("y.d") - need + 1))
           .select(F.col("x.main").alias("m"), F.col("x.side").alias("s"), F.col("x.digest").alias("a"), F.col("y.digest").alias("b"))
           .distinct())
    sides = sets.select(*group, "digest", "n", "d", "apart_by")

    def side(name, end):
        return sides.alias(name), (F.col("m") == F.col(f"{name}.main")) & (F.col("s") == F.col(f"{name}.side")) & (F.col(end) == F.col(f"{name}.digest"))

    found = (met.join(*side("x", "a")).join(*side("y", "b"))
             .where(need <= F.size(F.array_intersect("x.apart_by", "y.apart_by"))).select("a", "b"))
    middle = centres.join(sets.where("side = 0").select("main", F.col("digest").alias("centre"), F.col("comp").alias("c_comp"),
                                                        F.col("n").alias("c_n")), ["main", "centre"])
    direct = (sets.where("side = 0").join(middle, "main")
              .where((F.col("comp") != F.col("c_comp")) & (F.col("d") <= allowed(F.col("n"), F.col("c_n"))))
              .select(F.col("digest").alias("a"), F.col("centre").alias("b")))
    both = found.union(direct)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, comp) of every node with a link, comp the smallest node reachable; by alternating stars.

    Each round is written to shared storage; nothing but two numbers per round
    reaches the driver. A hub's edges are spread by their other end in the
    aggregate and split by AQE in the join.
    """
    def directed(e):
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))

    def stars(e, larger_only):
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = e.join(least, "u")
        if larger_only:
            return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))

    def mark(e):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = materialise(spark, directed(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = directed(stars(both, True)).distinct()
        now = materialise(spark, directed(stars(large, False)).distinct(), "edges")
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    numerator: int = 80, denominator: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    return near_rows(docs, id_col, text_col, size, numerator, denominator).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
              numerator: int = 80, denominator: int = 100) -> DataFrame:
    """(doc_id, place, n_shingles, component_id, stays) for every row of ``docs``.

    ``stays`` decides by id and text: it holds for rows linked with nothing and, in
    a component, for the place of its smallest id alone.
    """
    spark = docs.sparkSession
    least = least_estimate(numerator / denominator)
    drawn = materialise(spark, sketches(docs, id_col, text_col, size), "sketches")
    nodes = materialise(spark, drawn.where("digest is not null").dropDuplicates(["digest"]), "nodes")
    signed = nodes.select("digest", *SIGNATURE)

    # Buckets with more than one node.
    rows = nodes.select("digest", F.posexplode("bands").alias("band", "low")) \
                .select("digest", F.xxhash64("band", "low").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = materialise(spark, rows.join(shared, "bucket"), "members")

    # First round: every member against the bucket's best connected one.
    weight = members.groupBy("digest").agg(F.sum("n").alias("weight"))
    heads = (members.join(weight, "digest").groupBy("bucket")
             .agg(F.max(F.struct("weight", "digest"))["digest"].alias("head")))
    first = (members.join(heads, "bucket").where(F.col("digest") != F.col("head"))
             .select(F.col("digest").alias("a"), F.col("head").alias("b")).distinct())
    first = materialise(spark, first.join(signed.alias("x"), F.col("a") == F.col("x.digest"))
                        .join(signed.alias("y"), F.col("b") == F.col("y.digest"))
                        .where(estimate("x", "y") >= least).select("a", "b"), "pairs")

    # Texts of all nodes that look like another one of their bucket, fetched once for both rounds.
    signs = members.select("bucket", "digest").join(signed, "digest")
    alike = (signs.alias("x").join(signs.alias("y"), (F.col("x.bucket") == F.col("y.bucket"))
                                   & (F.col("x.digest") != F.col("y.digest")) & (estimate("x", "y") >= least), "left_semi")
             .select("digest").distinct())
    texts = materialise(spark, texts_of(docs, nodes, alike, id_col, text_col), "texts")
    links = materialise(spark, confirmed(first, texts, size, numerator, denominator), "links")
    comps = components(spark, links)

    # Second round: only across the components that still meet in a bucket.
    own = members.join(comps.select(F.col("node").alias("digest"), "comp"), "digest", "left") \
                 .withColumn("comp", F.coalesce("comp", "digest"))
    mixed = (own.join(heads, "bucket").groupBy("bucket")
             .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                  F.max(F.when(F.col("digest") == F.col("head"), F.col("comp"))).alias("main"))
             .where(F.col("lo") != F.col("hi")).select("bucket", "main"))
    open_rows = materialise(spark, own.join(mixed, "bucket")
                            .join(nodes.drop("bands", "doc_id", "place"), "digest")
                            .withColumn("apart", F.col("comp") != F.col("main")), "open")
    x, y = open_rows.where("apart").alias("x"), open_rows.alias("y")
    meet = ((F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp"))
            & (F.least("x.n_shingles", "y.n_shingles") * denominator
               >= F.greatest("x.n_shingles", "y.n_shingles") * numerator)
            & (estimate("x", "y") >= least))
    columns = ["main", "digest", "comp", "apart"]
    # Nodes with any such partner, by the main component of the bucket they meet in.
    near = materialise(spark, x.join(y, meet, "left_semi").select(*columns)
                       .union(y.join(x, meet, "left_semi").select(*columns)).distinct(), "near")
    if near.limit(1).count():
        centres = (near.join(weight, "digest").groupBy("main")
                   .agg(F.max(F.struct("weight", "digest"))["digest"].alias("centre")))
        centres = materialise(spark, centres, "centres")
        beside = materialise(spark, against_centre(near, centres, texts, size, numerator, denominator), "beside")
        second = (possible_pairs(beside, centres, numerator, denominator)
                  .join(first, ["a", "b"], "left_anti")
                  .join(first.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
        found = materialise(spark, confirmed(second, texts, size, numerator, denominator), "links")
        if found.limit(1).count():
            comps = components(spark, links.union(found))

    # Components of documents, named by their smallest id.
    labelled = drawn.select("doc_id", "place", "n_shingles", "digest").join(
        comps.select(F.col("node").alias("digest"), "comp"), "digest", "left") \
        .withColumn("comp", F.coalesce("comp", "digest"))
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place"))
    names = (labelled.where("comp is not null").groupBy("comp").agg(first_row.alias("first"))
             .select("comp", F.col("first.doc_id").alias("name"), F.col("first.place").alias("first_place")))
    # Written, so that the join reads two plain shuffles, of which AQE splits the one a large component makes uneven.
    names = materialise(spark, names, "names")
    return (labelled.join(names, "comp", "left")
            .withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("name")))
            .select("doc_id", "place", "n_shingles", "component_id",
                    (F.col("comp").isNull() | F.col("place").eqNullSafe(F.col("first_place"))).alias("stays")))
