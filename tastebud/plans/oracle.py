"""Independent DuckDB SQL for every SQL-checkable query.

The adapters and cleaning rules are re-stated here as SQL CTEs over the
pre-registered test tables. ``with_ctes(body, *names)`` pulls in the named
CTEs and their dependencies in order.
"""

from __future__ import annotations

from tastebud.sources.adapters import SHOPPING_TURNS

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (deps, sql)


def with_ctes(body: str, *names: str, extra: str | None = None) -> str:
    """``WITH`` the named CTEs (dependencies first), then ``extra`` inline CTEs, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order]
    if extra:
        parts.append(extra.strip())
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce(CAST({c} AS VARCHAR), '')), '\\s+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


def uniform(seed, *keys: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(CAST(('0x' || substr(md5({parts}), 1, 8)) AS BIGINT) / 4294967296.0)"


def age_band(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 'unknown' WHEN {c} < 25 THEN '16-24' "
            f"WHEN {c} < 35 THEN '25-34' WHEN {c} < 50 THEN '35-49' ELSE '50+' END")


CAT_COLS = ["prod_name", "product_type_name", "product_group_name", "department_name",
            "section_name", "garment_group_name", "detail_desc"]

# --- adapters -------------------------------------------------------------
cte("items_raw", (), """
SELECT CAST(p_partkey AS VARCHAR) AS article_id, p_name AS prod_name, p_type AS product_type_name,
       p_brand AS product_group_name, 'size ' || CAST(p_size AS VARCHAR) AS department_name,
       p_type AS section_name, p_brand AS garment_group_name,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS detail_desc
FROM part""")

cte("customers_raw", (), """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
       CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE END AS FN,
       CASE WHEN c_custkey % 2 = 1 THEN 1.0::DOUBLE END AS Active,
       CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS club_member_status,
       'Regularly' AS fashion_news_frequency,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(16 + c_custkey % 60 AS DOUBLE) END AS age
FROM customer""")

CHANNEL = ("CASE WHEN event_type IN ('view','click') THEN 1 "
           "WHEN event_type IN ('purchase','signup') THEN 2 ELSE 3 END")

cte("raw_b", (), f"""
SELECT CAST(user_id AS VARCHAR) AS customer_id, json_extract_string(props, '$.k') AS article_id,
       ts AS t_dat, value AS price, {CHANNEL} AS sales_channel_id
FROM events""")

cte("raw_a", (), """
SELECT CAST(o.o_custkey AS VARCHAR) AS customer_id, CAST(l.l_partkey AS VARCHAR) AS article_id,
       o.o_orderdate - to_days((SELECT CASE WHEN CAST(max(o_orderdate) AS DATE) = last_day(max(o_orderdate)) THEN 0
                                 ELSE day(max(o_orderdate)) END FROM orders)::INTEGER) AS t_dat, l.l_extendedprice / l.l_quantity AS price,
       CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 2 END AS sales_channel_id
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")

cte("dirty_raw", (), f"""
WITH base AS (
  SELECT event_id,
         CASE WHEN event_id % 83 = 0 THEN '' WHEN event_id % 71 = 0 THEN '  C' || CAST(user_id AS VARCHAR) || ' '
              ELSE CAST(user_id AS VARCHAR) END AS customer_id,
         CASE WHEN event_id % 79 = 0 THEN 'x' || json_extract_string(props, '$.k')
              ELSE json_extract_string(props, '$.k') END AS article_id,
         CASE WHEN event_id % 73 = 0 THEN 'not-a-date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t_dat,
         CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN CAST(-value AS VARCHAR)
              ELSE CAST(value AS VARCHAR) END AS price,
         CAST({CHANNEL} AS VARCHAR) AS sales_channel_id
  FROM events)
SELECT customer_id, article_id, t_dat, price, sales_channel_id FROM base
UNION ALL
SELECT customer_id, article_id, t_dat, price, sales_channel_id FROM base WHERE event_id % 67 = 0""")

# --- cleaning ---------------------------------------------------------------
_norm_cols = ", ".join(f"{norm(c)} AS {c}" for c in CAT_COLS)
cte("items", ("items_raw",), f"""
SELECT article_id, {", ".join(CAT_COLS)}, CAST(NULL AS VARCHAR) AS image_path, false AS has_image,
       trim(regexp_replace(concat_ws(' ', {", ".join(CAT_COLS)}), '\\s+', ' ', 'g')) AS item_text
FROM (SELECT {strip('article_id')} AS article_id, {_norm_cols} FROM items_raw)
WHERE article_id IS NOT NULL AND article_id <> ''""")

cte("customers", ("customers_raw",), f"""
SELECT {norm('customer_id')} AS customer_id, CAST(FN AS DOUBLE) AS FN, CAST(Active AS DOUBLE) AS Active,
       CASE WHEN {norm('club_member_status')} = '' THEN 'none' ELSE {norm('club_member_status')} END AS club_member_status,
       fashion_news_frequency,
       coalesce(CAST(age AS DOUBLE), (SELECT median(CAST(age AS DOUBLE)) FROM customers_raw)) AS age
FROM customers_raw""")


def _coerce(src: str, text_dates: bool) -> str:
    ts = "TRY_CAST(t_dat AS TIMESTAMP)" if text_dates else "CAST(t_dat AS TIMESTAMP)"
    return f"""
SELECT {norm('customer_id')} AS customer_id, {strip('article_id')} AS article_id, t_dat,
       TRY_CAST(price AS DOUBLE) AS price, TRY_CAST(sales_channel_id AS BIGINT) AS sales_channel_id,
       strftime({ts}, '%Y-%m-%d') AS event_date, {ts} AS event_ts
FROM {src}"""


def label_sql(src: str) -> str:
    return f"""
SELECT *, CASE WHEN month_number BETWEEN 1 AND 5 OR (month_number = 6 AND week_of_month <= 2) THEN 'train'
               WHEN month_number = 6 AND week_of_month = 3 THEN 'val'
               WHEN month_number = 6 AND week_of_month = 4 THEN 'test' END AS split
FROM (SELECT c.*, 6 - ((year(m.mx) - year(c.event_ts)) * 12 + (month(m.mx) - month(c.event_ts))) AS month_number,
             (day(c.event_ts) - 1) // 7 + 1 AS week_of_month
      FROM {src} c, (SELECT max(event_ts) AS mx FROM {src}) m)"""


def _reject(src: str) -> str:
    return f"""
SELECT s.*, CASE WHEN customer_id IS NULL OR article_id IS NULL OR event_ts IS NULL OR price IS NULL
                      OR customer_id = '' OR article_id = '' THEN 'missing'
                 WHEN price <= 0 THEN 'invalid_price'
                 WHEN article_id NOT IN (SELECT article_id FROM items) THEN 'orphan' END AS reject_reason
FROM {src} s"""


for tag, raw, text in (("b", "raw_b", False), ("a", "raw_a", False), ("d", "dirty_raw", True)):
    cte(f"coerced_{tag}", (raw,), _coerce(raw, text))
    cte(f"split_{tag}", (f"coerced_{tag}",), label_sql(f"coerced_{tag}"))
    cte(f"labelled_{tag}", (f"split_{tag}", "items"), _reject(f"split_{tag}"))
    cte(f"clean_{tag}", (f"labelled_{tag}",),
        f"SELECT * EXCLUDE (reject_reason, month_number, week_of_month) FROM labelled_{tag} "
        f"WHERE split IS NOT NULL AND reject_reason IS NULL")
    for s in ("train", "val", "test"):
        cte(f"{s}_{tag}", (f"clean_{tag}",), f"SELECT * FROM clean_{tag} WHERE split = '{s}'")
    cte(f"pop_{tag}", (f"train_{tag}",), f"""
SELECT article_id, score, row_number() OVER (ORDER BY score DESC, article_id) AS pop_rank
FROM (SELECT article_id, CAST(count(*) AS DOUBLE) AS score FROM train_{tag} GROUP BY article_id)""")
    cte(f"seen_{tag}", (f"train_{tag}",), f"SELECT DISTINCT customer_id, article_id FROM train_{tag}")
    for s in ("val", "test"):
        cte(f"truth_{s}_{tag}", (f"{s}_{tag}", f"train_{tag}", f"seen_{tag}"), f"""
SELECT DISTINCT v.customer_id, v.article_id FROM {s}_{tag} v
WHERE v.customer_id IN (SELECT customer_id FROM train_{tag}) AND v.article_id IN (SELECT article_id FROM train_{tag})
  AND NOT EXISTS (SELECT 1 FROM seen_{tag} z WHERE z.customer_id = v.customer_id AND z.article_id = v.article_id)""")


def _chat() -> str:
    said = "c.text"
    for k, pattern in enumerate(SHOPPING_TURNS):
        words = (f"replace(replace('{pattern}', concat(chr(123), 'type', chr(125)), coalesce(p.p_type, 'SMALL')), "
                 "concat(chr(123), 'brand', chr(125)), coalesce(p.p_brand, 'Brand#1'))")
        words = words.replace("{type}", "' || chr(123) || 'type' || chr(125) || '") \
                     .replace("{brand}", "' || chr(123) || 'brand' || chr(125) || '")
        said = f"CASE WHEN c.role = 'user' AND (c.conv_id + c.turn) % 8 = {k} THEN {words} ELSE {said} END"
    return (f"(SELECT c.conv_id, c.turn, c.role, {said} AS text "
            "FROM conversations c LEFT JOIN part p ON p.p_partkey = c.conv_id)")


# The chat messages as a derived table; free of braces, so it fits into format strings.
CHAT = _chat()
