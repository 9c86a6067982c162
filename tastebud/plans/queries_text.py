"""TF-IDF, similarity, name resolution, catalog search and intent queries (SQL-checked)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastebud.functions.numeric import r6
from tastebud.operators import intent as I
from tastebud.operators import search as S
from tastebud.operators import similar as SIM
from tastebud.operators import tfidf as TF
from tastebud.plans.frames import Frames
from tastebud.plans.oracle import CHAT, with_ctes
from tastebud.plans.registry import register
from tastebud.session import stored
from tastebud.sources.adapters import shopping_messages
from tastebud.sources.tables import load_table

WORD = r"[\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Me}\p{Nd}\p{Pc}]{2,}"
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in TF.ENGLISH_STOP_WORDS)


def _terms_sql(src: str, key: str, text: str, stop: bool, name: str) -> str:
    toks = f"regexp_extract_all(lower(coalesce({text}, '')), '{WORD}')"
    if stop:
        toks = f"list_filter({toks}, lambda w: NOT list_contains([{_STOP_SQL}], w))"
    return f"""
{name}_tok AS (SELECT {key} AS doc, {toks} AS t FROM {src}),
{name}_terms AS (SELECT doc, term, count(*) AS tf FROM (
    SELECT doc, unnest(t) AS term FROM {name}_tok
    UNION ALL
    SELECT doc, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM {name}_tok
  ) GROUP BY doc, term)"""


def _tfidf_sql(src: str, key: str, text: str, stop: bool, max_features: int, sublinear: bool, name: str) -> str:
    tf = "(1 + ln(t.tf))" if sublinear else "CAST(t.tf AS DOUBLE)"
    return _terms_sql(src, key, text, stop, name) + f""",
{name}_vocab AS (SELECT term, sum(tf) AS total, count(*) AS df FROM {name}_terms GROUP BY term
                 ORDER BY total DESC, term LIMIT {max_features}),
{name}_w AS (SELECT t.doc, t.term, {tf} * (ln((1.0 + (SELECT count(*) FROM {src})) / (1.0 + v.df)) + 1) AS w
             FROM {name}_terms t JOIN {name}_vocab v USING (term)),
{name} AS (SELECT doc AS article_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM {name}_w)"""


CATALOG = "catalog AS (SELECT article_id, min(coalesce(item_text, '')) AS item_text FROM items WHERE article_id IS NOT NULL GROUP BY article_id)"
TFIDF_SUB = _tfidf_sql("catalog", "article_id", "item_text", False, 20000, True, "tfs")
TFIDF_PLAIN = _tfidf_sql("catalog", "article_id", "item_text", True, 5000, False, "tfp")


def _catalog(spark, d):
    return TF.catalog_prepare(Frames(spark, d).items)


@register("catalog_prepare", with_ctes("SELECT article_id, item_text FROM catalog", "items", extra=CATALOG))
def q_catalog_prepare(spark, d):
    return _catalog(spark, d)


@register("tokenize_ngrams", with_ctes("SELECT doc AS article_id, term, tf FROM tfs_terms", "items",
                                       extra=CATALOG + "," + _terms_sql("catalog", "article_id", "item_text", False, "tfs")))
def q_tokenize_ngrams(spark, d):
    return TF.doc_terms(_catalog(spark, d), ngrams=True)


@register("tokenize_documents", with_ctes("SELECT doc AS doc_id, term, tf FROM dt_terms",
                                          extra=_terms_sql("documents", "doc_id", "text", False, "dt")))
def q_tokenize_documents(spark, d):
    docs = load_table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("item_text"))
    return TF.doc_terms(docs, ngrams=True).withColumnRenamed("article_id", "doc_id")


@register("tfidf_vocab", with_ctes("SELECT term, CAST(total AS BIGINT) AS total, df FROM dv_vocab",
                                   extra=_tfidf_sql("documents", "doc_id", "text", False, 20000, True, "dv")))
def q_tfidf_vocab(spark, d):
    docs = load_table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("item_text"))
    return TF.vocabulary(TF.doc_terms(docs), 20000).select("term", F.col("total").cast("long").alias("total"), "df")


@register("tfidf_sublinear", with_ctes("SELECT article_id, term, round(weight, 6) AS weight FROM tfs", "items",
                                       extra=CATALOG + "," + TFIDF_SUB))
def q_tfidf_sublinear(spark, d):
    w = TF.tfidf(_catalog(spark, d), 20000, sublinear=True)
    return w.select("article_id", "term", r6("weight").alias("weight"))


@register("tfidf_plain_stop", with_ctes("SELECT article_id, term, round(weight, 6) AS weight FROM tfp", "items",
                                        extra=CATALOG + "," + TFIDF_PLAIN))
def q_tfidf_plain_stop(spark, d):
    w = TF.tfidf(_catalog(spark, d), 5000, sublinear=False, stop=TF.stop_words())
    return w.select("article_id", "term", r6("weight").alias("weight"))


_QUERY_ITEMS = "qitems AS (SELECT DISTINCT article_id FROM test_b)"
_PAIRS = """
pairs AS (SELECT q.article_id AS query_article_id, d.article_id, sum(q.weight * d.weight) AS score
          FROM (SELECT * FROM tfp WHERE article_id IN (SELECT article_id FROM qitems)) q
          JOIN tfp d ON q.term = d.term AND d.article_id <> q.article_id
          GROUP BY 1, 2),
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_article_id
                                   ORDER BY round(score, 9) DESC, article_id) AS rank FROM pairs) WHERE rank <= 5)"""


def plain_tfidf(f: Frames):
    """The search-side TF-IDF table (a fitted model artifact): computed once per session and read back from shared storage."""
    from tastebud.plans.evaluations import cached
    cat = TF.catalog_prepare(f.items)
    return cat, cached(f, "tfidf:plain", lambda: stored(TF.tfidf(cat, 5000, sublinear=False, stop=TF.stop_words()), "weights"))


def _tfidf_neighbours(spark, d, n=5):
    f = Frames(spark, d)
    cat, w = plain_tfidf(f)
    return SIM.similar_tfidf(w, cat, f.test.select("article_id").distinct(), n)


@register("similar_tfidf", with_ctes("""
SELECT t.query_article_id, qc.item_text AS query_item_text, t.rank, round(t.score, 6) AS score, t.article_id, c.item_text
FROM top5 t JOIN catalog c ON c.article_id = t.article_id JOIN catalog qc ON qc.article_id = t.query_article_id""",
                                     "items", "test_b", extra=CATALOG + "," + TFIDF_PLAIN + ",\n" + _QUERY_ITEMS + "," + _PAIRS))
def q_similar_tfidf(spark, d):
    out = _tfidf_neighbours(spark, d)
    return out.select("query_article_id", "query_item_text", "rank", r6("score").alias("score"), "article_id", "item_text")


@register("cross_similarity", with_ctes("SELECT query_article_id, article_id, round(score, 6) AS score FROM pairs",
                                        "items", "test_b", extra=CATALOG + "," + TFIDF_PLAIN + ",\n" + _QUERY_ITEMS + "," + _PAIRS))
def q_cross_similarity(spark, d):
    f = Frames(spark, d)
    _, w = plain_tfidf(f)
    pairs = SIM.pair_scores(w, f.test.select("article_id"))
    return pairs.select("query_article_id", "article_id", r6("score").alias("score"))


_VEC = """
vec AS (SELECT vec_id, CASE WHEN nrm > 0 THEN list_transform(v, lambda x: x / nrm) ELSE v END AS v
        FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm
              FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))),
vtop AS (SELECT * FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, c.v), 9) DESC, c.vec_id) AS rank
  FROM {queries} q JOIN vec c ON q.vec_id <> c.vec_id) WHERE rank <= 5)"""


@register("embedding_normalize", with_ctes("""
SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(v[pos], 6) AS value FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS pos FROM vec)""",
                                           extra=_VEC.split(",\nvtop")[0].strip()))
def q_embedding_normalize(spark, d):
    v = SIM.normalize_vectors(load_table(spark, d, "embeddings"))
    return v.select("vec_id", F.posexplode("embedding").alias("p", "x")).select(
        "vec_id", (F.col("p") + 1).cast("long").alias("pos"), r6("x").alias("value"))


@register("similar_embeddings", with_ctes("SELECT query_id, rank, round(score, 6) AS score, vec_id FROM vtop",
                                          extra=_VEC.format(queries="vec")))
def q_similar_embeddings(spark, d):
    e = load_table(spark, d, "embeddings")
    out = SIM.similar_embeddings(e, e, n=5)
    return out.select("query_id", "rank", r6("score").alias("score"), "vec_id")


@register("similar_batch", with_ctes("""
SELECT 'tfidf' AS method, query_article_id, rank, round(score, 6) AS score, article_id FROM top5
UNION ALL
SELECT 'embedding', CAST(query_id AS VARCHAR), rank, round(score, 6), CAST(vec_id AS VARCHAR) FROM vtop""",
                                     "items", "test_b",
                                     extra=CATALOG + "," + TFIDF_PLAIN + ",\n" + _QUERY_ITEMS + "," + _PAIRS + "," +
                                     _VEC.format(queries="(SELECT * FROM vec WHERE CAST(vec_id AS VARCHAR) IN (SELECT article_id FROM qitems))")))
def q_similar_batch(spark, d):
    """Both methods for the same query batch (items bought in the test week);
    the embedding table's ``vec_id`` is the article key of its vector."""
    f = Frames(spark, d)
    t = _tfidf_neighbours(spark, d).select(F.lit("tfidf").alias("method"), "query_article_id", "rank",
                                             r6("score").alias("score"), "article_id")
    e = load_table(spark, d, "embeddings")
    q = e.join(f.test.select(F.col("article_id").alias("k")).distinct(), F.col("vec_id").cast("string") == F.col("k"),
               "left_semi")
    v = SIM.similar_embeddings(e, q, n=5).select(
        F.lit("embedding").alias("method"), F.col("query_id").cast("string").alias("query_article_id"), "rank",
        r6("score").alias("score"), F.col("vec_id").cast("string").alias("article_id"))
    return t.unionByName(v)


# name queries: every distinct product name, every word of a name, every benchmark text
_NAMEQ_SQL = """
nameq AS (SELECT DISTINCT prod_name AS query_name FROM items WHERE prod_name IS NOT NULL
          UNION SELECT DISTINCT unnest(string_split(prod_name, ' ')) FROM items WHERE prod_name IS NOT NULL
          UNION SELECT DISTINCT text FROM benchmark),
names AS (SELECT article_id, prod_name, lower(trim(coalesce(prod_name, ''))) AS name_norm FROM items),
dict AS (SELECT n.article_id, n.prod_name, n.name_norm FROM names n
         JOIN (SELECT name_norm, min(article_id) AS article_id FROM names GROUP BY 1) m USING (article_id)),
sc AS (SELECT q.query_name, d.article_id, d.prod_name,
              CASE WHEN d.name_norm = lower(trim(q.query_name)) THEN 0
                   WHEN contains(d.name_norm, lower(trim(q.query_name))) THEN 1 ELSE 2 END AS tier,
              1.0 - levenshtein(lower(trim(q.query_name)), d.name_norm)
                    / greatest(length(lower(trim(q.query_name))), length(d.name_norm), 1) AS ratio
       FROM nameq q CROSS JOIN dict d),
best AS (SELECT * FROM (SELECT *, CASE WHEN tier = 0 THEN 1.0 ELSE ratio END AS score,
                               row_number() OVER (PARTITION BY query_name ORDER BY tier,
                                 round(CASE WHEN tier = 0 THEN 1.0 ELSE ratio END, 9) DESC, article_id) AS r FROM sc) WHERE r = 1)"""


def _name_queries(spark, d):
    items = Frames(spark, d).items
    names = items.where(F.col("prod_name").isNotNull())
    a = names.select(F.col("prod_name").alias("query_name"))
    b = names.select(F.explode(F.split("prod_name", " ")).alias("query_name"))
    c = load_table(spark, d, "benchmark").select(F.col("text").alias("query_name"))
    return a.unionByName(b).unionByName(c).distinct()


@register("resolve_name", with_ctes("""
SELECT query_name, CASE WHEN tier < 2 OR score >= 0.35 THEN article_id END AS article_id,
       CASE WHEN tier < 2 OR score >= 0.35 THEN prod_name END AS prod_name,
       CASE WHEN NOT (tier < 2 OR score >= 0.35) THEN 'no_match' WHEN tier = 0 THEN 'exact'
            WHEN tier = 1 THEN 'contains' ELSE 'fuzzy' END AS match_type,
       round(CASE WHEN tier < 2 OR score >= 0.35 THEN score ELSE 0.0 END, 6) AS name_match_score FROM best""",
                                    "items", extra=_NAMEQ_SQL))
def q_resolve_name(spark, d):
    out = SIM.resolve_name(_name_queries(spark, d), Frames(spark, d).items)
    return out.select("query_name", "article_id", "prod_name", "match_type", r6("name_match_score").alias("name_match_score"))


# search queries: user chat turns (whole texts), every product type, every product name
_SEARCHQ = """
sq AS (SELECT 'c:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS query_id, text AS query
       FROM {CHAT} WHERE role = 'user'
       UNION ALL SELECT DISTINCT 't:' || product_type_name, product_type_name FROM items
       UNION ALL SELECT DISTINCT 'n:' || prod_name, prod_name FROM items WHERE prod_name IS NOT NULL),
stok AS (SELECT DISTINCT query_id, token FROM (
           SELECT query_id, unnest(regexp_extract_all(lower(coalesce(query, '')), '[a-z]+')) AS token FROM sq)
         WHERE length(token) > 1 AND token NOT IN ({stop})),
ntok AS (SELECT query_id, count(*) AS n_tok FROM stok GROUP BY 1),
tax AS (SELECT article_id, lower(concat_ws(' ', coalesce(product_type_name, ''), coalesce(product_group_name, ''))) AS taxonomy
        FROM items),
tm AS (SELECT DISTINCT t.token, x.taxonomy FROM (SELECT DISTINCT token FROM stok) t
       JOIN (SELECT DISTINCT taxonomy FROM tax) x
         ON regexp_matches(x.taxonomy, '\\b' || t.token || 's?\\b')
         OR regexp_matches(x.taxonomy, '\\b' || (CASE WHEN t.token LIKE '%s' AND length(t.token) > 3
                                                   THEN substr(t.token, 1, length(t.token) - 1) ELSE t.token END) || 's?\\b')),
qt AS (SELECT s.query_id, m.taxonomy FROM stok s JOIN tm m USING (token) GROUP BY 1, 2
       HAVING count(*) = (SELECT n_tok FROM ntok WHERE ntok.query_id = s.query_id)),
shits AS (SELECT * FROM (SELECT q.query_id, x.article_id, coalesce(p.score, 0.0) AS score,
                     row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(p.score, 0.0) DESC, x.article_id) AS rank
              FROM qt q JOIN tax x USING (taxonomy) LEFT JOIN pop_b p ON p.article_id = x.article_id) WHERE rank <= {limit})""".replace("{CHAT}", CHAT)
SEARCH_SQL = _SEARCHQ.format(stop=", ".join(f"'{w}'" for w in S.SEARCH_STOPWORDS), limit=10)


def _search_queries(spark, d):
    items = Frames(spark, d).items
    conv = shopping_messages(spark, d).where(F.col("role") == "user").select(
        F.concat_ws(":", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("query"))
    types = items.select(F.concat(F.lit("t:"), "product_type_name").alias("query_id"),
                         F.col("product_type_name").alias("query")).distinct()
    names = items.where(F.col("prod_name").isNotNull()).select(
        F.concat(F.lit("n:"), "prod_name").alias("query_id"), F.col("prod_name").alias("query")).distinct()
    return conv.unionByName(types).unionByName(names)


# Queries for a product type come with a budget.
_BUDGETS = """
sqb AS (SELECT query_id, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS said, CASE WHEN query_id LIKE 't:%' THEN 40000.0 END AS budget FROM sq
        WHERE query_id IN (SELECT query_id FROM stok)),
sprices AS (SELECT article_id, CAST(round_even(median(price) * 1000, 0) AS BIGINT) AS price_k FROM train_b GROUP BY article_id),
bhits AS (SELECT * FROM (SELECT q.query_id, x.article_id, coalesce(p.score, 0.0) AS score,
                     row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(p.score, 0.0) DESC, x.article_id) AS rank
              FROM qt q JOIN sqb USING (query_id) JOIN tax x USING (taxonomy) LEFT JOIN pop_b p ON p.article_id = x.article_id
              LEFT JOIN sprices r ON r.article_id = x.article_id
              WHERE sqb.budget IS NULL OR coalesce(r.price_k, 0) <= sqb.budget) WHERE rank <= 10),
named AS (SELECT article_id, min(prod_name) AS product_name, min(product_group_name) AS product_group,
                 min(coalesce(nullif(item_text, ''), detail_desc)) AS description FROM items GROUP BY article_id)"""


@register("search_catalog", with_ctes("""
SELECT b.query_id, h.rank, h.article_id, h.score, n.product_name, n.product_group, '~$' || CAST(r.price_k AS VARCHAR) AS price_label,
       n.description, 'catalog_text_search' AS strategy,
       CASE WHEN h.article_id IS NULL THEN 'No catalog product type matches \u201c' || said || '\u201d.'
            ELSE 'Popular catalog products matching \u201c' || said || '\u201d' || CASE WHEN budget IS NOT NULL THEN ' under $40000' ELSE '' END || '.' END AS explanation,
       CASE WHEN h.article_id IS NOT NULL THEN 'Matches your request for \u201c' || said || '\u201d.' END AS reason,
       CASE WHEN h.article_id IS NOT NULL THEN 1.0::DOUBLE END AS catalog_text_match
FROM sqb b LEFT JOIN bhits h USING (query_id) LEFT JOIN named n USING (article_id) LEFT JOIN sprices r USING (article_id)""",
                                      "items", "pop_b", "train_b", extra=SEARCH_SQL + ",\n" + _BUDGETS))
def q_search_catalog(spark, d):
    from tastebud.operators.serving import median_price
    f = Frames(spark, d)
    asked = _search_queries(spark, d).withColumn("max_budget", F.when(F.col("query_id").startswith("t:"), F.lit(40000.0)))
    prices = median_price(f.train)
    ranked = S.search_catalog(asked, f.items, f.pop, 10, prices, "max_budget")
    out = S.search_responses(asked, ranked, f.items, prices, "max_budget")
    return out.select("query_id", "rank", "article_id", "score", "product_name", "product_group", "price_label", "description", "strategy",
                      "explanation", "reason", F.col("signals")[S.SEARCH_SIGNAL].alias("catalog_text_match"))


# --- intent over conversation turns -------------------------------------------
def _rx(p: str) -> str:
    return p.replace("'", "''")


def _first_word_sql(text: str, vocab: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower({text}), '\\b{w}\\b') THEN '{w}' END"
                                   for w in sorted(vocab)) + ")"


def _intent_cols_sql(text: str, prefix: str = "") -> str:
    col = _first_word_sql(text, I.COLOURS)
    return (f"CASE WHEN {col} = 'gray' THEN 'grey' ELSE {col} END AS {prefix}colour, "
            f"{_first_word_sql(text, I.STYLES)} AS {prefix}style, "
            f"TRY_CAST(regexp_extract({text}, '{_rx(I.BUDGET)}', 1) AS DOUBLE) AS {prefix}max_budget, "
            f"CASE WHEN TRY_CAST(regexp_extract({text}, '{_rx(I.LIMIT)}', 1) AS INTEGER) IS NULL THEN 6 "
            f"ELSE greatest(least(TRY_CAST(regexp_extract({text}, '{_rx(I.LIMIT)}', 1) AS INTEGER), 20), 1) END AS {prefix}limit")


_GROUPS = "grp AS (SELECT DISTINCT product_group_name AS g FROM items WHERE product_group_name IS NOT NULL AND product_group_name <> '')"


def _group_sql(src: str, text: str, out: str) -> str:
    return f"""(SELECT arg_min(g.g, (-length(g.g), g.g)) FROM grp g WHERE contains(lower({src}.{text}), lower(g.g))) AS {out}"""


_CTX = f"""
turns AS (SELECT conv_id, turn, role, text,
                 CASE WHEN role = 'user' AND NOT coalesce(regexp_matches(text, '{_rx(I.GREETING)}'), false) THEN text END AS usable
          FROM {CHAT}),
ctx AS (SELECT conv_id, turn, text AS message,
               array_to_string(list_concat(list_filter(hist, lambda x: x IS NOT NULL), [text]), chr(10)) AS intent_text
        FROM (SELECT *, list(usable ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
                                                          ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS hist FROM turns)
        WHERE role = 'user')"""


@register("guardrail_flag", with_ctes(f"""
SELECT conv_id, turn, coalesce(regexp_matches(text, '{_rx(I.UNSAFE)}'), false) AS unsafe FROM {CHAT}"""))
def q_guardrail_flag(spark, d):
    c = shopping_messages(spark, d)
    return c.select("conv_id", "turn", I.unsafe_flag(F.col("text")).alias("unsafe"))


@register("greeting_flag", with_ctes(f"""
SELECT conv_id, turn, coalesce(regexp_matches(text, '{_rx(I.GREETING)}'), false) AS greeting FROM {CHAT}"""))
def q_greeting_flag(spark, d):
    c = shopping_messages(spark, d)
    return c.select("conv_id", "turn", I.greeting_flag(F.col("text")).alias("greeting"))


@register("extract_budget", with_ctes(f"""
SELECT conv_id, turn, TRY_CAST(regexp_extract(text, '{_rx(I.BUDGET)}', 1) AS DOUBLE) AS max_budget FROM {CHAT}"""))
def q_extract_budget(spark, d):
    c = shopping_messages(spark, d)
    return c.select("conv_id", "turn", I.extract_budget(F.col("text")).alias("max_budget"))


@register("extract_limit", with_ctes(f"""
SELECT conv_id, turn, CASE WHEN n IS NULL THEN 6 ELSE greatest(least(n, 20), 1) END AS "limit"
FROM (SELECT conv_id, turn, TRY_CAST(regexp_extract(text, '{_rx(I.LIMIT)}', 1) AS INTEGER) AS n FROM {CHAT})"""))
def q_extract_limit(spark, d):
    c = shopping_messages(spark, d)
    return c.select("conv_id", "turn", I.extract_limit(F.col("text")).alias("limit"))


@register("extract_colour_style", with_ctes(f"""
SELECT conv_id, turn, CASE WHEN c = 'gray' THEN 'grey' ELSE c END AS colour, s AS style
FROM (SELECT conv_id, turn, {_first_word_sql('text', I.COLOURS)} AS c, {_first_word_sql('text', I.STYLES)} AS s
      FROM {CHAT})"""))
def q_extract_colour_style(spark, d):
    c = shopping_messages(spark, d)
    return c.select("conv_id", "turn", I.extract_colour(F.col("text")).alias("colour"),
                    I.extract_style(F.col("text")).alias("style"))


@register("extract_product_group", with_ctes(f"""
SELECT c.article_id AS msg_id, {_group_sql('c', 'item_text', 'product_group')} FROM items c""", "items", extra=_GROUPS))
def q_extract_product_group(spark, d):
    """Longest group name inside each catalog text (brand#17 beats brand#1)."""
    f = Frames(spark, d)
    msgs = f.items.select(F.col("article_id").alias("msg_id"), F.col("item_text").alias("text"))
    return I.extract_product_group(msgs, I.product_groups(f.items))


@register("context_window", with_ctes("SELECT conv_id, turn, message, intent_text FROM ctx", extra=_CTX))
def q_context_window(spark, d):
    return I.context_window(shopping_messages(spark, d))


@register("merge_intent", with_ctes(f"""
SELECT conv_id, turn, message,
       CASE WHEN unsafe THEN 'unsafe_or_prompt_injection' END AS guardrail, greet AS is_greeting,
       CASE WHEN NOT unsafe AND NOT greet THEN coalesce(cur_product_group, product_group) END AS product_group,
       CASE WHEN NOT unsafe AND NOT greet THEN style END AS style,
       CASE WHEN NOT unsafe AND NOT greet THEN colour END AS colour,
       CASE WHEN NOT unsafe AND NOT greet THEN max_budget END AS max_budget,
       CASE WHEN NOT unsafe AND NOT greet THEN "limit" ELSE 6 END AS "limit",
       (NOT unsafe AND NOT greet AND coalesce(cur_product_group, product_group) IS NULL) AS use_demographics
FROM (SELECT x.*, {_intent_cols_sql('x.intent_text')},
             {_group_sql('x', 'intent_text', 'product_group')}, {_group_sql('x', 'message', 'cur_product_group')},
             coalesce(regexp_matches(x.message, '{_rx(I.UNSAFE)}'), false) AS unsafe,
             coalesce(regexp_matches(x.message, '{_rx(I.GREETING)}'), false) AS greet
      FROM ctx x)""", "items", extra=_CTX + ",\n" + _GROUPS))
def q_merge_intent(spark, d):
    f = Frames(spark, d)
    return I.assistant_intents(shopping_messages(spark, d), I.product_groups(f.items))
