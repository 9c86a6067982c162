"""Chat formatting, WARC archives and packing: exact round trips and optimality checks."""

import hashlib
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tastebud.llm import chat, packing, warc
from tastebud.llm.common import shared_path
from tastebud.llm.queries import TOKENIZERS, tokenizer_json

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<<SYS>><|image:1|>", "a\r\nb\n", "", "<", "s>", "<s", "日本 é"]


def test_escape_is_reversible_and_breaks_control_strings():
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choices([*NASTY, *chat.CONTROL, "[", "<", "/", "x"], k=rng.randint(0, 8)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not any(c in out for c in chat.CONTROL)
        assert chat.read_turn(chat.format_turn("user", [{"kind": "text", "text": text}])["formatted"]) == ("user", text)


def test_parts_become_placeholders_with_counts(spark):
    parts = [("text", "see <s> ", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None),
             ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), ("text", "bye", None, None, None, None, None)]
    schema = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>"
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", []), (1, 2, None, None)], schema)
    out = chat.format_turns(rows).orderBy("turn").collect()
    assert out[0]["formatted"] == "<s>user\nsee <\\s> <|image:1|><|audio:2|><|document:3|>bye</s>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in out[0]["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 50), ("document", "c.pdf", 3072)]
    assert all(out[0]["formatted"][a["start"]:].startswith(f"<|{a['kind']}:{a['n']}|>") for a in out[0]["attachments"])
    assert out[1]["formatted"] == "<s>assistant\n</s>\n" and out[2]["formatted"] == "<s>\n</s>\n"
    back = chat.read_back(chat.format_turns(rows)).first()
    assert (back["n_turns"], back["n_attachments"], back["attachment_tokens"], back["loss_chars"]) == (3, 3, 3125, 0)


def test_read_back_streams_many_turns(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", NASTY[((c or 0) + t) % len(NASTY)]) for c in (1, 2, None) for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df.withColumn("parts", chat.text_parts(F.col("text"))))).collect()}
    for c in (1, 2, None):
        turns = "".join(f"{r}\n{x}\n" for k, _, r, x in rows if k == c)
        loss = "".join(x for k, _, r, x in rows if k == c and r == "assistant")
        assert out[c]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert (out[c]["loss_sha256"], out[c]["loss_chars"]) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss))
    assert chat.read_back(chat.format_turns(df.limit(0).withColumn("parts", chat.text_parts(F.col("text"))))).count() == 0


@pytest.mark.parametrize("role", ["sys\nx", "a\\", "a\\\n", "\n", "", "<s>\\n"])
def test_roles_are_reversible(role):
    for text in ("hello", "\n\nx\\", "</s>[INST]"):
        part = dict.fromkeys(("ref", "width", "height", "seconds", "pages")) | {"kind": "text", "text": text}
        assert chat.read_turn(chat.format_turn(role, [part])["formatted"]) == (role, text)


def test_unknown_parts_keep_their_place():
    part = dict.fromkeys(("text", "width", "height", "seconds", "pages"))
    turn = chat.format_turn("user", [part | {"kind": "text", "text": "see ", "ref": None}, part | {"kind": "video", "ref": "v1"},
                                     part | {"kind": None, "ref": None}, part | {"kind": "image", "ref": "i1"}])
    assert chat.read_turn(turn["formatted"])[1] == "see <|unknown:1|><|unknown:2|><|image:3|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in turn["attachments"]] == [("unknown", "v1", 1), ("unknown", None, 1), ("image", "i1", 1)]


def test_warc_round_trip(spark):
    long, nasty = "é" * 60, "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\n" * 5
    pages = [(5, "http://a b\r\nX: y", long), (3, None, long), (9, "u", long), (4, "u", nasty), (8, "u", nasty), (1, "u", "short"),
             (2, "u", "short"), (6, "u", None), (7, "u", ""), (3, "again", long), (10, "u", "x" * 300_000), (None, "u", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)
    path = shared_path(spark, "warc")
    warc.write_archive(df, path, max_records=3)
    out = warc.read_resolved(spark, path).collect()
    assert len(out) == len(pages) and all(r["ok"] for r in out)
    kinds = sorted(((r["page_id"] or -1), r["record_type"], r["refers_to"]) for r in out)
    assert kinds == sorted([(5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (4, "response", None), (8, "revisit", 4), (1, "response", None),
                            (2, "response", None), (6, "response", None), (7, "response", None), (3, "response", None), (10, "response", None), (-1, "revisit", 3)],
                           key=lambda k: (k[0], k[1]))
    html = {p: h or "" for p, _, h in pages}
    for r in out:
        assert r["payload_bytes"] == len(html[r["page_id"]].encode()) and r["payload_digest"] == hashlib.sha256(html[r["page_id"]].encode()).hexdigest()
    empty = shared_path(spark, "warc")
    warc.write_archive(df.limit(0), empty)
    assert warc.read_resolved(spark, empty).count() == 0


def test_warc_files_by_bytes(spark):
    """Records of each size class have files of their own, none of them far over the bound."""
    import gzip
    import pathlib
    pages = [(i, "u", f"{i:04d}" * (200 if i % 10 else 40_000)) for i in range(60)]
    path = shared_path(spark, "warc")
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path, max_records=20,
                       file_bytes=200_000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in pathlib.Path(path.removeprefix("file:")).rglob("*.gz")]
    assert len(sizes) >= 8 and max(sizes) < 2 * 200_000
    assert warc.read_resolved(spark, path).where("ok").count() == 60


def test_broken_archives_are_rows(spark, tmp_path):
    """A cut record, a record without length, a foreign file and a cut gzip member stop their own file alone."""
    import gzip
    head = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: %d\r\n%sContent-Length: %s\r\n\r\n"
    digest = b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"x").hexdigest().encode() + b"\r\n"
    good = head % (1, digest, b"5") + b"\r\n\r\nx\r\n\r\n"
    files = {"whole": good, "cut": good + head % (2, digest, b"500") + b"abc", "length": good + head % (3, digest, b"much") + b"abc",
             "foreign": b"GIF89a", "nodigest": head % (4, b"", b"5") + b"\r\n\r\nx\r\n\r\n"}
    for name, data in files.items():
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data))
    (tmp_path / "member.gz").write_bytes(gzip.compress(good * 500)[:-20])
    out = warc.read_records(spark, str(tmp_path)).collect()
    assert sum(r["ok"] and r["page_id"] == 1 for r in out) >= 3 and sum(r["record_type"] == "broken" for r in out) == 4
    assert [r["ok"] for r in out if r["page_id"] == 4] == [False]


def test_warc_leaves_the_batch_rows_alone(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    path = shared_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), path)
    assert warc.read_resolved(spark, path).count() == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")


def test_word_ids_equal_the_tokenizer(tok):
    chunks, rng = packing.ChunkIds(tokenizer_json()), random.Random(6)
    assert chunks.by_words
    texts = ["Don't you'LL 12³ ½ ÀÉÎ ß ẞ İstanbul ΣΑΣ é", "x\x0bz\x85y", "a<|endoftext|>b <|startoftext|>", "<|EndOfText|>", "'S 'Ll !!! 12. .", "日本 語", "Ǆ ŉ ſtr K", "é"]
    texts += ["".join(rng.choices("aB'sStT 1²éÉ!<|>endoftext_-.,ŉßĲ\n\t", k=rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert chunks.text_ids(t) == b"".join(i.to_bytes(4, "little") for i in tok.encode(t, add_special_tokens=False).ids)


def test_other_tokenizers_go_through_the_whole_tokenizer():
    chunks = packing.ChunkIds(tokenizer_json("byte_bpe_50k.json"))
    assert not chunks.by_words and chunks.text_ids("two words") == chunks.ids("two words")


def _best_bins(weights, capacity):
    """Fewest bins by exhaustive search with a bound."""
    weights, best = sorted(weights, reverse=True), [len(weights)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(weights):
            best[0] = len(bins)
            return
        for b in {r: k for k, r in enumerate(bins)}.values():
            if bins[b] >= weights[i]:
                place(i + 1, bins[:b] + [bins[b] - weights[i]] + bins[b + 1:])
        place(i + 1, [*bins, capacity - weights[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimal_packing():
    rng = random.Random(8)
    for _ in range(250):
        capacity = rng.randint(8, 30)
        weights = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {w: weights.count(w) for w in weights}
        left = packing.Counts(counts)
        fixed = packing.reduce_by_dominance(left, capacity)
        rest = [w for w, n in left.n.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + _best_bins(rest, capacity) == _best_bins(weights, capacity), weights
        bins = packing.plan(counts, capacity)
        packed: dict[int, int] = {}
        for pattern, times in bins:
            assert times > 0 and sum(w * c for w, c in pattern.items()) <= capacity
            for w, c in pattern.items():
                packed[w] = packed.get(w, 0) + c * times
        assert packed == counts


def test_best_fit_on_counts_equals_best_fit_item_by_item():
    rng = random.Random(18)
    for _ in range(200):
        capacity = rng.randint(5, 60)
        weights = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 60))), reverse=True)
        bins: list[int] = []
        for w in weights:
            fit = [r for r in bins if r >= w]
            if fit:
                bins.remove(min(fit))
            bins.append((min(fit) if fit else capacity) - w)
        got = packing.best_fit(packing.Counts({w: weights.count(w) for w in weights}), capacity)
        rooms = sorted(capacity - sum(w * c for w, c in p.items()) for p, t in got for _ in range(t))
        assert rooms == sorted(bins)


def test_pack_documents_places_every_piece(spark, documents, odd, tok):
    rng = random.Random(10)
    rows = [*odd, *((100 + i, " ".join(rng.choices(["alpha", "beta", "gamma,"], k=rng.randint(0, 900)))) for i in range(60))]
    out = packing.pack_documents(documents(rows), tokenizer_json(), capacity=512).collect()
    want = []
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc_id, k // 512, k, len(ids[k:k + 512]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[k:k + 512])))
                 for k in range(0, len(ids), 512)]
    key = lambda r: json.dumps(r)
    assert sorted(([*r][:5] for r in out), key=key) == sorted(map(list, want), key=key)
    bins: dict[int, list] = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(documents([]), tokenizer_json()).count() == 0
