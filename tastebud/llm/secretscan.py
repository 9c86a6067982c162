"""Secret scans: fixed patterns plus character Markov models, in DataFrame functions only.

Base kinds come from three regular expressions. A fourth kind, ``markov``, covers
runs of key characters outside them: two first-order character models, one of
random strings and one of ordinary identifiers, score the run's parts between
``/``, ``_`` and ``-`` that are long enough for a key (names, paths, dates and
rulers have none, or ordinary ones). A run is a span if the log-likelihood ratio
of these parts exceeds the prior odds against a secret and, by pair of
characters, ``LEAST_MEAN``.

The models are fitted on labelled samples. Random: strings by rule, digests of
counters in hexadecimal, base64 and capital letters with digits. Ordinary: all
words of all documents, weighted by their number, as they stand and (derived from
the counts of pairs, beginnings and ends) in capitals, capitalised, joined by
underscores, hyphens and capitals, and with numbers; and the labelled names of
``NAMED``. The model is a table over pairs of 67 characters; no pair counts more
than ``MOST_RATIO`` either way.

Positions come from lengths: the texts between the matches (split) and the
matches (extract all) alternate, so running sums give each match's place in code
points. Arrays are bound once and running sums formed in blocks (``arrays``):
a text of very many matches costs time in proportion.

Defined results: null and empty texts have no spans; markov spans lie outside
base spans; repeated rows are scanned alike; without documents the identifier
model is flat and nothing is added.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastebud.llm.arrays import let, outside, running, united
from tastebud.llm.common import materialise

# Patterns and lengths that the result is defined by (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RUN = 16
RUN = f"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
SEPARATORS = "/_-"
PART = f"[A-Za-z0-9+=]{{{LEAST_RUN},}}"  # what a separator leaves together
SAMPLE_STRINGS = 6000
PRIOR_ODDS = 1e6
LEAST_MEAN, MOST_RATIO = 0.5, 3.0  # log ratio of a pair: least mean of a span, most of any
NAMED_SHARE = 0.05  # of all ordinary pairs, by weight
SMOOTHING = 0.5
SCALE = 1000  # log ratios are kept as integers of a thousandth
# Labelled ordinary strings (fixed values).
NAMED = (
    "usr/local/lib/python/site-packages/numpy/core", "application/x-www-form-urlencoded", "src/main/java/org/apache/spark/sql",
    "2024-01-05T10-22-33Z-backup", "text/html", "multipart/form-data", "image/svg+xml", "application/vnd+json", "Content-Type",
    "X-Forwarded-For", "getElementById", "addEventListener", "HttpServletRequest", "AbstractSingletonProxyFactoryBean",
    "NullPointerException", "UnsupportedOperationException", "max_connections_per_host", "spark_executor_memoryOverhead",
    "JAVA_TOOL_OPTIONS", "LD_LIBRARY_PATH", "PYTHONDONTWRITEBYTECODE", "kubernetes-dashboard", "internationalization",
    "deserializationConfiguration", "utf8mb4_unicode_ci", "x86_64-unknown-linux-gnu", "sha256sum", "base64encode", "ISO8601",
    "RFC3339Nano", "IPv6Address", "http2ServerStream", "windows10enterprise", "release20240105", "build12345678", "user123456",
    "order0000012345", "aaaaaaaaaaaaaaaa", "xxxxxxxxxxxxxxxx", "XXXXXXXXXXXXXXXX", "0000000000000000", "================",
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01234567890123456789", "qwertyuiopasdfghjklzxcvbnm")
SPAN = "array<struct<kind:int,start:int,end:int>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def located(text: Column, pattern: str, kind: int, passes, group: int = 0) -> Column:
    """Spans of the matches that ``passes(match, group of it)`` accepts; a failing match still takes up its text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    met = F.filter(F.arrays_zip(F.split(text, pattern, -1), found, values), lambda x: x["1"].isNotNull())
    steps = F.transform(met, lambda x: F.struct((F.length(x["0"]) + F.length(x["1"])).alias("step"), F.length(x["1"]).alias("length"),
                                                passes(x["1"], x["2"]).alias("ok")))

    def place(s):
        ends = running(F.transform(s, lambda x: x["step"]), F.lit(0), lambda a, b: a + b)
        placed = F.zip_with(s, ends, lambda x, e: F.struct(x["ok"].alias("ok"), F.struct(
            F.lit(kind).alias("kind"), (e - x["length"]).alias("start"), e.alias("end")).alias("span")))
        return F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: x["span"])

    return let(steps, place)


def base_spans(text: Column) -> Column:
    """Spans of the kinds assign, access and hex, by start and kind."""
    folded = F.lower(text)
    named = F.lit(False)
    for word in KEYWORDS:
        named = named | F.contains(folded, F.lit(word))
    every = lambda m, v: F.lit(True)
    assign = F.when(named, located(text, ASSIGN, 0, lambda m, v: F.length(v) >= LEAST_VALUE, group=1)).otherwise(_none())
    access = F.when(F.contains(text, F.lit("AKIA")), located(text, ACCESS, 1, every)).otherwise(_none())
    hexes = F.when(text.rlike(HEX), located(text, HEX, 2, every)).otherwise(_none())
    return by_start(F.concat(assign, access, hexes))


def by_start(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def log_ratio(run: Column, table: Column) -> Column:
    """(total, pairs) over the parts of a run: log P(random) - log P(ordinary) of adjacent characters, times SCALE."""
    parts = F.regexp_extract_all(run, F.lit(PART), F.lit(0))

    def of(part):
        places = F.transform(F.split(part, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        begin = F.struct(F.lit(0).alias("before"), F.lit(0).cast("long").alias("total"))

        def walk(acc, p):
            pair = (acc["before"] - 1) * len(ALPHABET) + p
            gain = F.when((acc["before"] > 0) & (p > 0), F.element_at(table, pair).cast("long")).otherwise(F.lit(0).cast("long"))
            return F.struct(p.alias("before"), (acc["total"] + gain).alias("total"))

        return F.struct(F.aggregate(places, begin, walk, lambda acc: acc["total"]).alias("total"),
                        (F.length(part) - 1).cast("long").alias("pairs"))

    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("pairs"))
    return F.aggregate(F.transform(parts, of), zero, lambda a, x: F.struct(
        (a["total"] + x["total"]).alias("total"), (a["pairs"] + x["pairs"]).alias("pairs")))


def pairs_in(s: Column) -> Column:
    """All adjacent pairs of characters, in time proportional to the length."""
    return F.regexp_extract_all(s, F.lit("(?s)(?=(..))"), F.lit(1))


def random_sample(spark: SparkSession, n: int = SAMPLE_STRINGS) -> DataFrame:
    """Random strings by rule: digests of counters in three writings, 16 to 47 characters long."""
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    code = F.base64(F.unhex(digest))
    caps = F.upper(F.regexp_replace(code, "[+/=]", ""))
    written = F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, code).otherwise(caps)
    return spark.range(n).select(F.lit("random").alias("label"),
                                 F.substring(written, F.lit(1), F.lit(16) + (F.col("id") % 32).cast("int")).alias("s"))


def ordinary_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n): the runs of key characters in all documents and their number; those of a base pattern are no sample."""
    words = docs.where(F.col(text_col).isNotNull()).select(F.explode(F.split(F.col(text_col), "[^A-Za-z0-9+/_=-]+")).alias("w"))
    return (words.where((F.length("w") > 1) & ~F.col("w").rlike(f"{HEX}|{ACCESS}"))
            .groupBy("w").agg(F.count(F.lit(1)).alias("n")))


def ordinary_counts(words: DataFrame) -> dict[str, float]:
    """Weights of pairs in ordinary strings: the words as they stand and the forms that identifiers are made of."""
    words = materialise(words.sparkSession, words, "words")
    w = F.col("w")

    def table(value: Column) -> dict[str, int]:
        rows = words.select(value.alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n")).where(F.length("k") == 2)
        return {r["k"]: r["n"] for r in rows.collect()}  # at most 67 x 67

    within, first = table(F.explode(pairs_in(w))), table(F.substring(w, 1, 2))
    turn = table(F.concat(F.substring(w, -1, 1), F.substring(w, 1, 1)))  # last and first character
    out: dict[str, float] = Counter()
    for k, n in within.items():
        out[k] += 4 * n  # alone, twice in a joined form, in a form with a number
        out[k.upper()] += 2 * n
    for k, n in first.items():
        out[k[0].upper() + k[1]] += 2 * n
        out[k] -= n  # in the capitalised form
    for k, n in turn.items():
        last, begin = k
        for pair in (last + "_", "_" + begin, last + "-", "-" + begin, last + begin.upper(), last.upper() + "_", "_" + begin.upper()):
            out[pair] += n
        for digit in "0123456789":
            out[last + digit] += n / 10
            out["-" + digit] += n / 10
            for other in "0123456789":
                out[digit + other] += 2 * n / 100
    total, named = sum(out.values()), Counter(x[i:i + 2] for x in NAMED for i in range(len(x) - 1))
    share = NAMED_SHARE * total / sum(named.values())
    for k, n in named.items():
        out[k] += share * n
    return {k: n for k, n in out.items() if n > 0 and k[0] in ALPHABET and k[1] in ALPHABET} if total > 0 else {}


def fit(docs: DataFrame, text_col: str = "text") -> list[int]:
    """Scaled log ratios for all pairs of the alphabet, row by row (first character, second character)."""
    random = random_sample(docs.sparkSession).select(F.explode(pairs_in(F.col("s"))).alias("k")).groupBy("k").count()
    counts: dict[tuple[str, str], float] = {("random", r["k"]): r["count"] for r in random.collect()}  # at most 67 x 67
    ordinary = ordinary_counts(ordinary_words(docs, text_col))
    if not ordinary:
        return [-SCALE] * len(ALPHABET) ** 2
    return ratios(counts | {("identifier", k): n for k, n in ordinary.items()})


def ratios(counts: dict[tuple[str, str], float]) -> list[int]:
    """Smoothed conditional log ratios; a character unseen in a model follows its overall frequencies."""
    tables = {}
    for label in ("random", "identifier"):
        single = {c: sum(counts.get((label, a + c), 0) for a in ALPHABET) + SMOOTHING for c in ALPHABET}
        total = sum(single.values())
        share = {c: n / total for c, n in single.items()}
        for a in ALPHABET:
            row = {c: counts.get((label, a + c), 0) + SMOOTHING * len(ALPHABET) * (0.5 * share[c] + 0.5 / len(ALPHABET))
                   for c in ALPHABET}
            n = sum(row.values())
            tables.update({(label, a, c): math.log(row[c] / n) for c in ALPHABET})
    most = round(SCALE * MOST_RATIO)
    return [max(-most, min(most, round(SCALE * (tables["random", a, c] - tables["identifier", a, c])))) for a in ALPHABET for c in ALPHABET]


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of the spans."""
    def over(s):
        sizes = F.concat(F.transform(s, lambda x: x["end"] - x["start"]), F.array(F.lit(0)))
        return F.array_join(F.zip_with(outside(text, s), sizes, lambda p, n: F.concat(p, F.repeat(F.lit(" "), n))), "")

    return F.when(F.size(spans) > 0, let(united(spans), over)).otherwise(text)


def markov_spans(text: Column, table: Column, base: Column, prior_odds: float = PRIOR_ODDS) -> Column:
    """Runs of key characters outside the base spans that are likelier random than named."""
    least, mean = round(SCALE * math.log(prior_odds)), round(SCALE * LEAST_MEAN)

    def passes(m, _):
        likely = let(log_ratio(m, table), lambda r: (r["total"] >= least) & (r["total"] >= r["pairs"] * mean))
        return F.when(m.rlike(PART) & m.rlike("[A-Za-z]"), likely).otherwise(F.lit(False))

    return F.when(text.rlike(PART), let(blanked(text, base), lambda t: located(t, RUN, 3, passes))).otherwise(_none())


def with_spans(docs: DataFrame, table: list[int], text_col: str = "text", base: str = "base", spans: str = "spans",
               prior_odds: float = PRIOR_ODDS) -> DataFrame:
    """``docs`` with arrays of (kind, start, end): ``base`` the patterns' spans, ``spans`` those and the models'."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    weights = F.lit(table).cast("array<int>")
    out = docs.withColumn(base, base_spans(text))
    return out.withColumn(spans, by_start(F.concat(F.col(base), markov_spans(text, weights, F.col(base), prior_odds))))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by one mark; null stays null."""
    return F.when(F.size(spans) > 0, F.array_join(outside(text, united(spans)), mark)).otherwise(text)
