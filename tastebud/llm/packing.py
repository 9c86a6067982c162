"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so the packing is decided on counts
per length: a table of at most ``capacity`` rows, whatever the corpus. On that
table the reduction fixes bins which provably dominate every alternative (a
longest piece that nothing fits beside; a pair that fills the bin; the best
partner when no two others can stand in for it; the best two others), as often
as the counts allow. Best-fit decreasing packs what remains. The plan is a list
of bin patterns with a multiplicity, never a list of documents; each pattern
uses up a length or a group of bins, so the plan is bounded by the capacity too.

Spark does the rest: texts are tokenised in place, the k-th piece of a length is
numbered from a per-task counter plus per-task offsets (both keyed by task and
length, so no length class meets in one task), and a join with the plan turns
the number into a sequence and an offset.

Defined results: a null text is an empty text (the end token alone); repeated
rows and ids are packed as separate pieces; an empty table packs into nothing.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tastebud.llm.common import materialise, small_batches

CAPACITY = 2048
# Chunks whose token ids a worker keeps in each of two generations, so memory is bounded.
CACHED_CHUNKS = 250_000
# Texts with characters outside these (controls, combining marks, other scripts)
# are tokenised whole; inside them a white-space chunk is tokenised by itself.
WHOLE_TEXT = re.compile("[^\\t\\n\\r\\x20-\\x7E\\xA1-\\u012F\\u0131-\\u024F\\u2010-\\u2027\\u20AC]")
# Byte-level vocabularies write a byte as itself where it is printable, else as a letter from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long")


class Generations(dict):
    """A bounded memo: when full it becomes the old generation, from which what is asked for again moves back."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class ChunkIds(Generations):
    """Lower-case white-space chunk or word -> its token ids as little-endian 32-bit bytes.

    Where the tokenizer is the lower-casing one whose split rule can be read
    from its file, a new chunk is split by that rule and each new word goes
    through the model alone; texts with the start of a special token, and other
    tokenizers, go through the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        super().__init__(CACHED_CHUNKS)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        self.starts = tuple({t["content"][:2] for t in spec["added_tokens"]})
        self.by_words = _splits_words(spec)
        if self.by_words:
            self.model = self.tokenizer.model
            self.written = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
            self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall

    def ids(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def make(self, chunk: str) -> bytes:
        if not chunk.isalpha():  # letters alone are one word whatever the split rule says of other characters
            if chunk[-1] in ".,!" and chunk[:-1].isalpha():
                return self[chunk[:-1]] + self[chunk[-1]]
            words = self.split(chunk)
            if words != [chunk]:
                return b"".join(map(self.__getitem__, words))
        letters = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(BYTE_LETTERS)
        return b"".join([self.written[t.id] for t in self.model.tokenize(letters)])

    def text_ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words or WHOLE_TEXT.search(text) or any(s in text for s in self.starts):
            return self.ids(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


def _splits_words(spec: dict) -> bool:
    """Whether words can be tokenised one by one: NFC, white space and case, then one split rule and byte-level BPE."""
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in before] == ["Split", "ByteLevel"]
            and before[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and before[0]["behavior"] == "Removed" and before[0]["invert"]
            and not before[1]["add_prefix_space"] and not before[1]["use_regex"] and spec["model"]["type"] == "BPE"
            and spec["post_processor"] is None and not spec["model"].get("dropout"))


_TOKENIZERS: dict[int, ChunkIds] = {}


def tokenised_pieces(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of every document with length, checksum and the task's running number for that length.

    Token streams longer than ``capacity`` are cut into full pieces and a
    last, shorter one; only lengths and checksums leave the task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hash(shared.value)
        if key not in _TOKENIZERS:
            _TOKENIZERS.clear()
            _TOKENIZERS[key] = ChunkIds(shared.value)
        chunks, task, seen = _TOKENIZERS[key], TaskContext.get().partitionId(), {}
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = chunks.text_ids(text) + end
                for at in range(0, len(data), step):
                    part = data[at:at + step]
                    length = len(part) // 4
                    nth = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc_id, at // step, at // 4, length, zlib.crc32(part), task, nth))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
            yield out.astype({"doc_id": "Int64"})

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(pieces, PIECES))


class Counts:
    """Counts per length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, w: int, k: int) -> None:
        self.n[w] -= k
        if not self.n[w]:
            del self.n[w]
            self.order.pop(bisect.bisect_left(self.order, w))

    def largest(self, most: int, without: dict[int, int]) -> int | None:
        """Largest length <= most, beyond the pieces in ``without``."""
        for i in range(bisect.bisect_right(self.order, most) - 1, -1, -1):
            w = self.order[i]
            if self.n[w] > without.get(w, 0):
                return w
        return None

    def smallest(self, k: int, without: dict[int, int]) -> list[int]:
        out: list[int] = []
        for w in self.order:
            out += [w] * min(k - len(out), self.n[w] - without.get(w, 0))
            if len(out) == k:
                break
        return out


def dominating_set(left: Counts, j: int, capacity: int) -> list[int] | None:
    """Pieces that may be fixed beside a piece of length ``j`` without loss, or None if no rule applies."""
    room, used = capacity - j, {j: 1}
    best = left.largest(room, used)
    if best is None:
        return []
    if best == room:
        return [best]
    small = left.smallest(3, used)
    if len(small) < 2 or small[0] + small[1] > room:
        return [best]  # at most one more piece fits: the largest dominates
    if len(small) == 3 and sum(small) <= room:
        return None
    # At most two more fit. The pair with the largest sum, by its larger member.
    pair = None
    for a in reversed(left.order[:bisect.bisect_right(left.order, room)]):
        if left.n[a] <= used.get(a, 0):
            continue
        b = left.largest(min(a, room - a), {**used, a: used.get(a, 0) + 1})
        if b is not None and (pair is None or a + b > sum(pair)):
            pair = (a, b)
    if pair is None or best >= sum(pair):
        return [best]
    # Every feasible pair has a larger member <= best and a smaller one <= room / 2.
    half = left.largest(room // 2, used)
    if pair[0] == best and half is not None and pair[1] >= half:
        return list(pair)
    return None


def reduce_by_dominance(left: Counts, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fix dominating bins, largest piece first; returns (pattern, multiplicity) and shrinks ``left``."""
    fixed, at = [], capacity + 1
    while (i := bisect.bisect_left(left.order, at) - 1) >= 0:
        j = left.order[i]
        others = dominating_set(left, j, capacity)
        if others is None:
            at = j
            continue
        pattern: dict[int, int] = {}
        for w in (j, *others):
            pattern[w] = pattern.get(w, 0) + 1
        times = min(left.n[w] // c for w, c in pattern.items())
        for w, c in pattern.items():
            left.take(w, c * times)
        fixed.append((pattern, times))
    return fixed


def best_fit(left: Counts, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: bins with one pattern are handled together."""
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    order: list[int] = []
    done: list[tuple[dict[int, int], int]] = []

    def put(pattern, times, room):
        if room == 0:
            done.append((pattern, times))
            return
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append((pattern, times))

    for w in reversed(list(left.order)):
        todo = left.n[w]
        while todo:
            i = bisect.bisect_left(order, w)
            if i < len(order):
                room = order[i]
                pattern, times = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(i)
            else:
                room, pattern, times = capacity, {}, todo
            fit = room // w  # the bin just used has the least room until nothing more fits
            whole = min(times, todo // fit)
            if whole:
                put({**pattern, w: pattern.get(w, 0) + fit}, whole, room - fit * w)
                todo -= whole * fit
                times -= whole
            if todo and times:
                put({**pattern, w: pattern.get(w, 0) + todo}, 1, room - todo * w)
                times -= 1
                todo = 0
            if pattern and times:
                put(pattern, times, room)
    for room in order:
        done += rooms[room]
    return done


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bin patterns {length: copies} with multiplicities that hold exactly the pieces counted."""
    left = Counts(counts)
    fixed = reduce_by_dominance(left, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, copies, sequence, offset): numbers [from, to) of a length go to bins from ``sequence``."""
    out, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for w, copies in sorted(pattern.items(), reverse=True):
            start = taken.get(w, 0)
            taken[w] = start + copies * times
            out.append((w, start, taken[w], copies, sequence, offset))
            offset += copies * w
        sequence += times
    return out


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, task, nth) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in  # at most ``capacity`` rows
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = slots(plan(counts, capacity))
    at = spark.createDataFrame(rows, "length long, lo long, hi long, copies long, base long, at long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (pieces.groupBy("length", "task").agg(F.max("nth").alias("last"))
               .withColumn("first", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)))
               .drop("last"))
    numbered = pieces.join(offsets, ["length", "task"]).withColumn("k", F.col("first") + F.col("nth"))
    # The plan has at most one row per bin pattern and length in it: bounded by the capacity.
    placed = numbered.join(F.broadcast(at), (numbered["length"] == at["length"]) & (numbered["k"] >= at["lo"])
                           & (numbered["k"] < at["hi"])).drop(at["length"])
    within = F.col("k") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(within / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + (within % F.col("copies")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    spark = docs.sparkSession
    pieces = materialise(spark, tokenised_pieces(docs, tokenizer_json, id_col, text_col, capacity, end_id), "pieces")
    return pack(spark, pieces, capacity)
