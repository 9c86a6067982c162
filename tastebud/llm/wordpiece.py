"""Token counts with a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry again and again. Instead of
backing up after each piece, a trie over the vocabulary carries a failure link
per node: where to go on when no edge matches, and how many pieces have been
settled by going there. The counts are precomputed, so a word's number of pieces
is found in one pass over its characters and no piece is ever built.

Vocabulary entries that begin with ``##`` continue a word, the others begin one.
A word that can't be covered counts as one unknown token.

Defined results: null and empty texts have no words and no tokens; white space
separates words, every other character that is no letter, digit or underscore is
a word by itself.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastebud.llm.common import small_batches

WORD = re.compile(r"\w+|[^\w\s]")
CONTINUES = "##"
CACHED_WORDS = 200_000
COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")])


def sentencepiece_vocabulary(path: str) -> list[str]:
    """A SentencePiece model's pieces in word-piece writing: word starts as they are, others after ``##``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p[1:] if p.startswith("▁") else CONTINUES + p for p in pieces} - {"", CONTINUES})


class Automaton:
    """Trie with failure links; nodes are numbers, 0 starts a word and 1 continues it."""

    def __init__(self, vocabulary):
        self.edges: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for entry in vocabulary:
            node, rest = (1, entry[len(CONTINUES):]) if entry.startswith(CONTINUES) and len(entry) > len(CONTINUES) else (0, entry)
            if not rest:
                continue
            for c in rest:
                nxt = self.edges[node].get(c)
                if nxt is None:
                    nxt = self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    ends.append(False)
                node = nxt
            ends[node] = True
        self.link = [-1] * len(self.edges)   # -1: the word can't be covered
        self.popped = [0] * len(self.edges)  # pieces settled by following the link
        todo = deque((u, c, v) for u in (0, 1) for c, v in self.edges[u].items())
        while todo:
            u, c, v = todo.popleft()
            if ends[v]:
                self.link[v], self.popped[v] = 1, 1
            else:
                z, pops = self.link[u], self.popped[u]
                while z != -1 and c not in self.edges[z]:
                    pops += self.popped[z]
                    z = self.link[z]
                if z != -1:
                    self.link[v], self.popped[v] = self.edges[z][c], pops
            todo.extend((v, d, w) for d, w in self.edges[v].items())

    def count(self, word: str) -> int | None:
        """Number of greedy pieces, or None when the word can't be covered."""
        edges, link, popped = self.edges, self.link, self.popped
        node = pieces = 0
        for c in word:
            while c not in edges[node]:
                pieces += popped[node]
                node = link[node]
                if node == -1:
                    return None
            node = edges[node][c]
        while node != 1:
            pieces += popped[node]
            node = link[node]
            if node == -1:
                return None
        return pieces


class WordCounts(dict):
    """Word -> (tokens, unknown words); emptied when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        n = self.automaton.count(word)
        out = self[word] = (1, 1) if n is None else (n, 0)
        return out


_COUNTS: dict[int, WordCounts] = {}


def with_token_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text", out: str = "counts") -> DataFrame:
    """``docs`` with struct ``out`` (n_words, n_tokens, n_unknown); no shuffle.

    The vocabulary, a fixed file, is broadcast; each worker builds the automaton once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    key = hash(tuple(vocabulary))

    @F.pandas_udf(COUNTS)
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[key] = WordCounts(Automaton(shared.value))
        known = _COUNTS[key]
        for texts in batches:
            rows = []
            for text in texts:
                words = WORD.findall(text) if text else []
                found = [known[w] for w in words]
                rows.append((len(words), sum(t for t, _ in found), sum(u for _, u in found)))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])

    return docs.withColumn(out, counts(F.col(text_col)))
