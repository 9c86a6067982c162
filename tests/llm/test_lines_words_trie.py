"""Line dedup, spelling variants and the prefix trie against brute force, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tastebud.llm import linededup, queries, spelling, trie

CONV = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# --- lines -----------------------------------------------------------------
def plain_lines(rows, least_chars=20, least_docs=3):
    key = lambda l: lower(l.strip(BLANKS))
    ids = defaultdict(set)
    rank = lambda i: (i is not None, i or 0)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                ids[key(line)].add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(ids[key(x)]) < least_docs or max(ids[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lines_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=str)


def test_lines_equal_brute_force(spark, documents, odd):
    rng = random.Random(5)
    common = [f"this line number {k} is shared by some documents" for k in range(6)] + ["short", "", "  \t "]
    made = [(100 + d, "\n".join(rng.choice(["  ", "", "\t"]) + rng.choice([str.upper, str, str.title])(rng.choice(common)) + rng.choice(["", "\r"])
                                for _ in range(rng.randint(1, 12)))) for d in range(40)]
    hot = "A line that every third document of the table holds"
    rows = odd + made + [(200 + d, hot + ("\nown words of document %d here" % d)) for d in range(60)] \
        + [(None, hot), (None, "x\n" + hot), (300, hot), (300, hot + "\n" + hot), (7, "ÄÖÜ ärger über die straße im süden\n" * 3)]
    got = lines_rows(linededup.dedup_lines(documents(rows)))
    assert got == sorted(plain_lines(rows), key=str)
    assert sum(r[2] for r in got) > 60


def test_lines_of_one_very_long_text(spark, documents):
    """Time in proportion to the lines: 100,000 in one text, every second of them dropped."""
    shared = [f"shared line {k:06d} of many words" for k in range(50_000)]
    long = "\n".join(f"{x}\nonly here {k:06d} and nowhere else" for k, x in enumerate(shared))
    rows = [(1, long), (2, "\n".join(shared)), (3, "\n".join(shared))]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.dedup_lines(documents(rows)).collect()}
    assert got == {1: (100_000, 50_000), 2: (50_000, 50_000), 3: (50_000, 0)}


def test_lines_pass_other_columns_and_an_empty_table(spark, documents):
    df = documents([(1, "a")]).withColumnRenamed("hits", "p1").withColumnRenamed("lang", "dropped")
    out = linededup.dedup_lines(df)
    assert {"p1", "dropped", "kept_text"} <= set(out.columns) and out.count() == 1
    assert linededup.dedup_lines(documents([(1, "a")]).limit(0)).count() == 0


# --- words -----------------------------------------------------------------
def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows, every=None):
    counts = Counter()
    for i, t in rows:
        for run in spelling.RUN.findall(t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: x for w, x in best.items() if words[x] >= 5 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def words_rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_words_equal_brute_force(spark, documents, odd):
    rng = random.Random(9)
    stems = ["".join(rng.choice("abéÿ÷") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    rows = list(odd)
    for d in range(60):
        words = []
        for _ in range(90):
            w = stems[min(int(rng.expovariate(0.12)), len(stems) - 1)]
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "q", "éa"]) + w[at + 1:]
            words.append(rng.choice([w, w.title(), w.upper()]))
        rows.append((rng.choice([d, None]), " ".join(words)))
    rows += [(900 + d, "chainword " * 10 + "chainwort " + ("cheinwort" if d < 9 else "")) for d in range(60)]
    got = words_rows(spelling.spelling_variants(documents(rows), delete_every=7))
    assert got == plain_words(rows, 7)
    assert sum(1 for r in got if r[1]) > 10 and any(r[1] and r[2] != r[1] for r in got)


def test_long_words_are_compared_whole(spark, documents):
    """Words over the carried length are fetched by id; one run of 50,000 letters among them."""
    base = {n: ("abcdefghij" * 5001)[:n] for n in (47, 48, 49, 50, 50_000)}
    words = [w for n, w in base.items() for w in (w, w[:20] + "Z" + w[21:], w[:3] + w[4:])]
    rows = [(d, " ".join(words)) for d in range(5)]
    assert words_rows(spelling.spelling_variants(documents(rows))) == plain_words(rows)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=6, max_size=12), st.integers(0, 11), st.sampled_from(["ins", "del", "rep"]), st.sampled_from("abcd"),
       st.sets(st.text("^abc", min_size=2, max_size=3)))
def test_a_taken_gram_survives_every_edit(word, at, kind, letter, frequent):
    at = min(at, len(word) - 1)
    edited = word[:at] + {"ins": letter + word[at], "del": "", "rep": letter}[kind] + word[at + 1:]
    frequent = frozenset(frequent)
    grams = [(*g, len(g[2])) for g in spelling.decompose(word, frequent)]
    some = spelling.taken(grams)
    assert len(some) - spelling.affected([g[:3] for g in some]) >= 1
    if len(edited) < len(word):
        return  # the shorter word looks for the longer
    shift = len(edited) - len(word)
    there = {(p, g) for p, _, g in spelling.decompose(edited, frequent)}
    assert any((p, g) in there or (p + shift, g) in there for p, _, g, _ in some)


def test_words_of_empty_tables(spark, documents):
    assert spelling.spelling_variants(documents([(1, "a")]).limit(0)).count() == 0
    assert spelling.spelling_variants(documents([(1, None), (2, "")])).count() == 0


def test_crc_in_sql_is_crc32():
    sql = f"WITH {queries._CRC_TABLE} SELECT {queries._CRC.format('[49, 50, 195, 169]')} FROM crc_table"
    assert duckdb.connect().execute(sql).fetchall()[0][0] == zlib.crc32("12é".encode())


# --- trie ------------------------------------------------------------------
def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0, key), role, text))
    base = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in base.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = base.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    words = lambda k: len([w for w in _split(k[-1][1]) if w]) if k else 0
    out = []
    for k, m in members.items():
        below = [x for x in members if x[:len(k)] == k]
        kids = [x for x in members if len(x) == len(k) + 1 and x[:len(k)] == k]
        leaves = sum(not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in members) for x in below)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids), leaves,
                    sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _split(s):
    for b in BLANKS:
        s = s.replace(b, " ")
    return s.split(" ")


def trie_rows(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                        "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def some_conversations(rng, n, most=6):
    texts = ["hello there", "how are\tyou", "", "a b c d", "naïve — 日本"]
    return [(c, rng.choice([t, t, None]) if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]), rng.choice([*texts, None]))
            for c in rng.sample(range(-45, 130), n) for t in range(rng.randint(1, most))]


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rows = some_conversations(rng, 70)
    rows += [(None, 0, "user", "no conversation"), (41, 0, "user", "twice"), (41, 0, "user", "twice")]
    df = spark.createDataFrame(rows, CONV).withColumn("node", __import__("pyspark").sql.functions.lit("clash")).repartition(5)
    assert trie_rows(trie.prefix_trie(df)) == plain_trie(rows)


def test_trie_over_chunks_and_small_trees(spark, monkeypatch):
    """A conversation of a third of the rows, shared long prefixes, and trees that are written out every few keys."""
    rng = random.Random(4)
    long = [(20, t, "user", f"turn {t % 7}") for t in range(150)]
    rows = long + [(c, t, "user", f"turn {t % 7}") for c in (23, 27, 31) for t in range(rng.choice([32, 64, 65, 100]))]
    rows += some_conversations(rng, 25, 4)
    got = trie_rows(trie.prefix_trie(spark.createDataFrame(rows, CONV).repartition(4)))
    assert got == plain_trie(rows)
    chunks = trie.chunks_of(*trie.rebuilt(trie.turns_of(spark.createDataFrame(rows, CONV)))).persist()
    one = {tuple(r) for r in trie.merged(trie.gather(trie.weighed(chunks, trie.F.lit(1), trie.F.lit(0)))).collect()}
    monkeypatch.setattr(trie, "TREE_BYTES", 2000)
    many = {tuple(r) for r in trie.merged(trie.gather(trie.weighed(chunks, trie.F.lit(1), trie.F.lit(0)))).collect()}
    assert one == many


def test_trie_of_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=5), max_size=400), st.integers(0, 255))
def test_radix_tree_keeps_every_key(keys, byte):
    """All node layouts: many keys share one byte, so nodes of 256 children come up."""
    tree, want = trie.RadixTree(lambda a, b: a + b), Counter()
    for k in [*keys, *(bytes((byte, x)) for x in range(200)), *(bytes((byte, 7, x)) for x in range(40))]:
        tree.insert(k, 1)
        want[k] += 1
    assert list(tree.items()) == sorted(want.items())
    kinds, stack = set(), [tree.root]
    while stack:
        node = stack.pop()
        kinds.add(node.kind)
        assert node.count == len(node.children()) <= node.kind
        stack.extend(c for _, c in node.children())
    assert {48, 256} <= kinds


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_line_dedup", "op13_prefix_trie"])
def test_registered_queries_equal_their_sql(spark, name):
    from oracle_check import check, duck
    ok, why, _ = check(spark, duck("/root/testdata/sf0.001"), name, "/root/testdata/sf0.001", queries.QUERIES, queries.ORACLE)
    assert ok, why
