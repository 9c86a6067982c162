"""License, fingerprint, secret and token scans against hand-made and brute-force results."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tastebud.llm import fingerprint as fp
from tastebud.llm import licenses, secretscan, wordpiece


def test_licenses_find_lines_paragraphs_and_texts(spark, documents):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and "hereby" in t)
    rows = [(1, "Some words.\nLicensed under the Apache License, Version 2.0.\nMore words here."),
            (2, "Intro line\n\n" + mit.replace("copies of the", "copies, of the") + "\n\nother things"),
            (3, "nothing to see"), (4, "RELEASED under the mit licence license")]
    out = {r["doc_id"]: r["matches"] for r in licenses.with_licenses(documents(rows)).collect()}
    assert [(m["unit"], m["license"], m["dice"]) for m in out[1]] == [("line", "Apache-2.0", 1.0)]
    assert ("paragraph", "MIT") in {(m["unit"], m["license"]) for m in out[2]}
    assert out[3] == []
    start, end = out[1][0]["start"], out[1][0]["end"]
    assert rows[0][1][start:end] == "Licensed under the Apache License, Version 2.0."


def test_licenses_size_bounds_lose_nothing():
    rng = random.Random(1)
    vocabulary = "licensed under the mit license released apache version 2 0 terms of this".split()
    known = licenses.Templates()
    for _ in range(2000):
        words = [w.encode() for w in rng.choices(vocabulary, k=rng.randint(0, 14))]
        pairs = licenses.bigrams(words)
        best = max(((2 * len(pairs & p) / (len(pairs) + len(p)) if pairs and p else 0.0) for _, p in known.sets))
        found = known.best(words)
        assert (found is not None) == (best >= known.threshold and len(words) > 1)
        assert found is None or found[1] == pytest.approx(best)


def test_licenses_inside_other_text_in_their_usual_layout():
    known = licenses.Templates(licenses.all_templates())
    fill = "\n".join(f"Part {i} tells of step{i} here. It says thing{i} too." for i in range(500))
    before, after = f"{fill}\n\nA second part, with words.", f"Usage\n\n{fill}"

    def names(layout):
        text = f"{before}\n\n{layout}\n\n{after}"
        out = licenses.scan(text, known)
        assert all(0 <= m["start"] < m["end"] <= len(text) and m["dice"] >= licenses.THRESHOLD for m in out)
        assert all(m["start"] >= len(before) - 30 and m["end"] <= len(text) - len(after) + 30 for m in out)
        return {m["license"] for m in out}

    for name, text in licenses.all_templates():
        words = text.split()
        broken, kept = "", text if "\n\n" in text else ""
        for i in range(0, len(words), 11):  # wrapped lines, a blank one after each that ends a sentence
            broken += " ".join(words[i:i + 11]) + ("\n\n" if words[min(i + 10, len(words) - 1)].endswith((".", ":")) else "\n")
        for layout in filter(None, (broken, kept)):
            assert names(layout) & ({name} | ({"GPL", "GPL-3.0"} if name == "GPL" else set())), (name, layout[:80])
    mit = " ".join(next(t for n, t in licenses.TEMPLATES if n == "MIT" and "hereby" in t).split())
    parts = mit.replace(" The above copyright", "\n\nThe above copyright").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    assert parts.count("\n\n") == 2 and names(parts) == {"MIT"}
    gpl = " ".join(next(t for n, t in licenses.TEMPLATES if n == "GPL").split())
    assert "GPL" in names(gpl.replace(" This program is distributed", "\n\nThis program is distributed"))
    assert names("Written by nobody in 2020. Released under the MIT License. See the file.") == {"MIT"}
    assert names("This is a tool. It does things. See the manual.") == set()


def test_license_runs_equal_all_windows():
    rng = random.Random(3)
    templates = (("a", "k l m n o p q r s t u v"), ("b", "k l m x y z"), ("c", "p q r x"))
    known = licenses.Templates(templates)
    hits = 0
    for _ in range(400):
        text = "".join(rng.choice("klmnopqrstuvxyz") + rng.choice([" ", " ", " ", ". ", "\n"]) for _ in range(rng.randint(0, 20)))
        at = rng.randint(0, len(text))
        body = [w for w in rng.choice(templates)[1].split() if rng.random() < 0.9]
        text = text[:at] + "\n" + "".join(w + rng.choice([" ", " ", ". ", "\n", "\n\n"]) for w in body) + "\n" + text[at:]
        words, spans = licenses.words_of(text), [p for p in licenses.pieces(text) if licenses.words_of(text[p[0]:p[1]])]
        best = 0.0
        for i in range(len(spans)):
            for j in range(i, len(spans)):
                pairs = licenses.bigrams(licenses.words_of(text[spans[i][0]:spans[j][1]]))
                best = max([best, *(2 * len(pairs & p) / (len(pairs) + len(p)) for _, p in known.sets if pairs)])
        every = licenses.runs(text, words, known, [])
        assert bool(every) == (best >= known.threshold)
        for m in every:
            pairs = licenses.bigrams(licenses.words_of(text[m["start"]:m["end"]]))
            body = licenses.bigrams(licenses.words_of(dict(templates)[m["license"]]))
            assert m["dice"] == pytest.approx(2 * len(pairs & body) / (len(pairs) + len(body)))
        hits += bool(every)
    assert 50 < hits < 400


def test_licenses_odd_rows_and_empty_table(spark, documents, odd):
    assert all(r["matches"] == [] for r in licenses.with_licenses(documents(odd)).collect())
    assert licenses.with_licenses(documents([]).limit(0)).count() == 0


def _brute_lanes(text):
    sums = [0] * (4 * fp.WORDS)
    n = 0
    for p in (text or "").split("\n"):
        if not (p := p.strip(" ")):
            continue
        n += 1
        digest = hashlib.sha256(p.encode()).hexdigest().encode()
        for i in range(fp.WORDS):
            word = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(digest, seed=42))
            word &= fp.LANES if i < fp.UNIFORM_WORDS else fp.BITS
            for lane in range(4):
                sums[4 * i + lane] = (sums[4 * i + lane] + (word >> 16 * lane & 0xFFFF)) % fp.MODULUS
    return n, sums


def test_fingerprint_equals_brute_force_sums(spark, documents):
    texts = ["a\nb\n\n c ", "c\na\nb", None, "", "x", "x\nx\nx", "é\n日本"]
    rows = documents(list(enumerate(texts))).select("doc_id", fp.fingerprint(F.col("text")).alias("f")).collect()
    for r in rows:
        n, sums = _brute_lanes(texts[r["doc_id"]])
        lanes = [w >> 16 * lane & 0xFFFF for w in r["f"][1:] for lane in range(4)]
        assert (r["f"][0], lanes) == (n, sums)


def test_fingerprint_is_homomorphic(spark):
    row = spark.range(1).select(
        fp.fingerprint(F.lit("a\nb\nc")).alias("all"), fp.insert(fp.fingerprint(F.lit("c\na")), F.lit("b")).alias("ins"),
        fp.delete(fp.fingerprint(F.lit("a\nx\nb\nc")), F.lit("x")).alias("del"),
        fp.combine(fp.fingerprint(F.lit("b")), fp.fingerprint(F.lit("c\na"))).alias("sum")).first()
    assert row["all"] == row["ins"] == row["del"] == row["sum"]


def test_likeness_estimates_common_paragraphs(spark):
    rng = random.Random(2)
    lines = [f"line {rng.random()}" for _ in range(400)]
    cases = [("\n".join(lines[:100]), "\n".join(reversed(lines[:100])), 1.0), ("\n".join(lines[:100]), "\n".join(lines[50:150]), 0.5),
             ("\n".join(lines[:100]), "\n".join(lines[200:300]), 0.0), ("", None, 1.0), ("", "a", 0.0)]
    df = spark.createDataFrame(cases, "a string, b string, want double")
    for r in df.select("want", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"], abs=0 if r["want"] == 1 else 0.25)


@pytest.mark.parametrize("blocks", [1, 2, 7, 40])
def test_next_document_in_descending_order(spark, documents, blocks):
    rng = random.Random(blocks)
    ids = rng.sample(range(-50, 10**6), 60)
    out = fp.with_next(documents([(i, f"text {i}") for i in ids]), blocks=blocks).collect()
    ids.sort(reverse=True)
    want = {a: f"text {b}" for a, b in zip(ids, ids[1:] + ids[:1])}
    assert {r["doc_id"]: r["next_text"] for r in out} == want and len(out) == 60


def test_next_document_of_odd_rows(spark, documents, odd):
    out = fp.with_next(documents(odd), blocks=3).collect()
    assert len(out) == len(odd) and all(r["next_text"] is not None for r in out)
    assert fp.with_next(documents([(9, "only")]), blocks=4).first()["next_text"] == "only"
    assert fp.with_next(documents([]), blocks=4).count() == 0


KINDS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
          lambda m: len(m[2]) >= 6),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
         ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def _brute_base(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))


def test_base_secrets_equal_brute_force(spark, documents):
    rng = random.Random(5)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", " = ", ": ", '"', "'", "abc", "AKIA", "ABCDEFGH12345678", "é", " ", "\n",
             "0123456789abcdef", "deadbeef", "==", "x9"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)]
    table = [-1000] * len(secretscan.ALPHABET) ** 2
    for r in secretscan.with_spans(documents(list(enumerate(texts))), table).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == _brute_base(texts[r["doc_id"]])
        assert r["spans"] == r["base"]


def test_markov_models_tell_random_from_named(spark, documents):
    rng = random.Random(9)
    words = "retrieve configuration manager window customer account nightly bucket partition payload tokenizer merge".split()
    plain = [(i, " ".join(rng.choices(words, k=80))) for i in range(60)]
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hidden = ["".join(rng.choices(base62, k=32)) for _ in range(40)]
    named = ["configuration_manager_window", "customerAccountPartition", "RETRIEVE_NIGHTLY_BUCKET", "payload-tokenizer-merge-12"]
    docs = documents(plain + [(1000 + i, f"see {s} there") for i, s in enumerate(hidden)]
                     + [(2000 + i, f"see {s} there") for i, s in enumerate(named)])
    out = {r["doc_id"]: r["spans"] for r in secretscan.with_spans(docs, secretscan.fit(docs)).collect()}
    caught = sum(out[1000 + i] and (out[1000 + i][0]["start"], out[1000 + i][0]["end"]) == (4, 36) for i in range(len(hidden)))
    assert caught >= 0.9 * len(hidden)
    assert not any(out[2000 + i] for i in range(len(named))) and not any(out[i] for i, _ in plain)


def test_secrets_redaction_and_odd_rows(spark, documents, odd):
    rows = [*odd, (50, 'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end')]
    docs = documents(rows)
    out = secretscan.with_spans(docs, secretscan.fit(docs)).select("doc_id", "text", secretscan.redacted(F.col("text"), F.col("spans")).alias("r"))
    for r in out.collect():
        assert r["r"] == ('é [SECRET]" end' if r["doc_id"] == 50 else r["text"])
    assert secretscan.fit(docs.limit(0)) == [-secretscan.SCALE] * len(secretscan.ALPHABET) ** 2


ORDINARY = ["usr/local/lib/python/site-packages/numpy/core", "application/x-www-form-urlencoded", "src/main/java/org/apache/spark/sql/catalyst",
            "a/b/c/d/e/f/g/h/i/j/k/l", "2024-01-05T10-22-33Z-backup", "6f1c2a9e-51c3-4b7d-9a3e-0d2f4c6b8a17", "-" * 24 + "a", "getCustomerAccountById2",
            "x" * 200, "home/user/projects/reports/2023/annual_summary_final-v2", "org/junit/jupiter/api/AssertionsTest"]


def test_random_strings_of_every_kind_and_no_names(spark, documents):
    """Lengths 20 to 64 in hexadecimal with capitals, base62, base64 and base32; paths, types, dates and rulers are let be."""
    rng = random.Random(12)
    digits, caps = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = {"HEX": digits + "ABCDEF", "62": digits + caps + caps.lower(), "64": digits + caps + caps.lower() + "+/", "32": caps + "234567"}
    hidden = [(k, "".join(rng.choices(a, k=n))) for k, a in kinds.items() for n in (20, 24, 32, 40, 64) for _ in range(12)]
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = secretscan.fit(sf)
    rows = [(i, f"see {s} there") for i, (_, s) in enumerate(hidden)] + [(5000 + i, f"see {s} there") for i, s in enumerate(ORDINARY)]
    out = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secretscan.with_spans(documents(rows), model).collect()}
    for k in kinds:
        caught = [out[i] == [(4, 4 + len(s))] for i, (kind, s) in enumerate(hidden) if kind == k]
        assert sum(caught) >= 0.9 * len(caught), k
    assert [s for i, s in enumerate(ORDINARY) if out[5000 + i]] == []
    plain = secretscan.with_spans(sf, model).where(F.size("spans") > F.size("base"))
    assert plain.count() == 0


def test_a_text_of_very_many_matches(spark, documents):
    """100,000 assignments with random values in one text: spans, redaction and time in proportion."""
    import time
    text = "\n".join(f'é token = "v{i:06d}abcdefgh" end' for i in range(100_000))
    docs = documents([(1, text), (2, "nothing here")]).coalesce(1)
    began = time.time()
    out = secretscan.with_spans(docs, [-1000] * len(secretscan.ALPHABET) ** 2)
    got = {r["doc_id"]: r for r in out.select("doc_id", F.size("base").alias("n"), F.get("base", F.lit(99_999)).alias("last"),
                                              secretscan.redacted(F.col("text"), F.col("spans")).alias("r")).collect()}
    assert got[1]["n"] == 100_000 and got[1]["r"] == "\n".join(['é [SECRET]" end'] * 100_000)
    assert text[got[1]["last"]["start"]:got[1]["last"]["end"]] == 'token = "v099999abcdefgh'
    assert got[2]["n"] == 0 and got[2]["r"] == "nothing here" and time.time() - began < 90


def _greedy(word, vocabulary):
    at = pieces = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (word[at:end] if at == 0 else "##" + word[at:end]) in vocabulary:
                break
        else:
            return None
        at, pieces = end, pieces + 1
    return pieces


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(3)
    for _ in range(150):
        vocabulary = {("##" if rng.random() < 0.6 else "") + "".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 14))}
        automaton = wordpiece.Automaton(vocabulary)
        for _ in range(150):
            word = "".join(rng.choices("abc", k=rng.randint(1, 12)))
            assert automaton.count(word) == _greedy(word, vocabulary), (word, vocabulary)


def test_token_counts_of_odd_rows(spark, documents, odd):
    vocabulary = ["word", "one", "##ly", "a"]
    rows = documents(odd + [(20, "only one, a-xyz")])
    out = [(r["doc_id"], tuple(r["counts"])) for r in wordpiece.with_token_counts(rows, vocabulary).collect()]
    assert dict(out)[5] == (60_000, 60_000, 0) and dict(out)[20] == (6, 6, 4)
    assert all(c == (0, 0, 0) for i, c in out if i in (1, 2, 3)) and len(out) == len(odd) + 1
