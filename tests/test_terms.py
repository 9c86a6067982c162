"""Terms counted within rows: exact for shared and missing ids, without a shuffle of the terms."""

from collections import Counter

from tastebud.operators import tfidf as TF

ROWS = [("a", "red Red red shoe"), ("b", "blue blue hat x"), ("a", "shoe red shoe"), (None, "one two"), (None, "two one two"),
        ("c", None), ("d", ""), ("e", "7 q")]


def want(rows, ngrams):
    out = Counter()
    for key, text in rows:
        t = [w for w in (text or "").lower().split() if len(w) > 1]
        out.update((key, w) for w in (t + [f"{a} {b}" for a, b in zip(t, t[1:])] if ngrams else t))
    return out


def test_terms_of_shared_and_missing_ids_are_added_up(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "article_id string, item_text string")
    for few in (0, 10_000):
        monkeypatch.setattr(TF, "FEW_ROWS", few)
        for ngrams in (True, False):
            got = {(r.article_id, r.term): r.tf for r in TF.doc_terms(docs, ngrams).collect()}
            assert got == want(ROWS, ngrams) and TF.doc_terms(docs, ngrams).count() == len(got)


def test_terms_of_single_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] not in ("a", None)], "article_id string, item_text string")
    plan = TF.doc_terms(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    assert {(r.article_id, r.term): r.tf for r in TF.doc_terms(docs).collect()} == want(
        [r for r in ROWS if r[0] not in ("a", None)], True)
