"""Shopping-intent extraction over message rows (regex and vocabulary, all JVM-side).

Chat messages become rows ``(conv_id, turn, role, text)``; every rule of the
assistant is a column expression or a window over the conversation, so a
million conversations are one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vocabularies and patterns of the intent rules.
COLOURS = ["black", "white", "orange", "red", "blue", "green", "yellow", "pink",
           "purple", "brown", "beige", "grey", "gray", "navy", "cream", "gold", "silver"]
STYLES = ["casual", "formal", "sporty", "minimal", "classic", "streetwear", "oversized",
          "slim", "elegant", "party", "office", "summer", "winter", "vintage"]
UNSAFE = (r"(?i)\b(?:ignore (?:all |the )?(?:previous|system)|system prompt|developer message|"
          r"steal|weapon|explosive|self[- ]?harm|suicide)\b")
GREETING = r"(?i)^\s*(?:hi|hello|hey|good\s+(?:morning|afternoon|evening)|howdy)[!.?\s]*$"
BUDGET = r"(?i)(?:under|below|less than|max(?:imum)?|budget(?: of| is)?|up to)\s*(?:[$£€]\s*)?(\d+(?:\.\d{1,2})?)"
LIMIT = r"(?i)\b(?:show|find|give|recommend)(?:\s+me)?\s+(\d{1,2})\b"
DEFAULT_LIMIT, MAX_LIMIT, CONTEXT_TURNS = 6, 20, 6
NAME_BYTES, NAME_OVERHEAD = 4 * 1024 * 1024, 64  # names of one automaton; bytes of a name besides its text


def product_groups(items: DataFrame) -> DataFrame:
    """Distinct non-empty product groups of the catalog."""
    g = F.col("product_group_name")
    return items.select(g).where(g.isNotNull() & (g != "")).distinct()


def unsafe_flag(text: Column) -> Column:
    return F.coalesce(text.rlike(UNSAFE), F.lit(False))


def greeting_flag(text: Column) -> Column:
    return F.coalesce(text.rlike(GREETING), F.lit(False))


def extract_budget(text: Column) -> Column:
    return F.regexp_extract(text, BUDGET, 1).try_cast("double")


def extract_limit(text: Column) -> Column:
    """First count after show/find/give/recommend [me], capped at 20, default 6; 0 -> 1."""
    n = F.regexp_extract(text, LIMIT, 1).try_cast("int")
    return F.when(n.isNull(), F.lit(DEFAULT_LIMIT)).otherwise(F.greatest(F.least(n, F.lit(MAX_LIMIT)), F.lit(1)))


def _first_word(text: Column, vocab: list[str]) -> Column:
    """Alphabetically first vocabulary word present at word boundaries (deterministic)."""
    low = F.lower(text)
    hits = [F.when(low.rlike(rf"\b{w}\b"), F.lit(w)) for w in sorted(vocab)]
    return F.coalesce(*hits)


def extract_colour(text: Column) -> Column:
    c = _first_word(text, COLOURS)
    return F.when(c == "gray", F.lit("grey")).otherwise(c)


def extract_style(text: Column) -> Column:
    return _first_word(text, STYLES)


def name_blocks(names: DataFrame, max_bytes: int) -> tuple[DataFrame, int]:
    """``names`` (group, g) with a block number; blocks hold about ``max_bytes`` of names."""
    size = names.agg(F.sum(F.octet_length("g") + NAME_OVERHEAD)).first()[0] or 0
    blocks = max(1, -(-int(size) // max_bytes))
    return names.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(blocks))), blocks


def extract_product_group(messages: DataFrame, groups: DataFrame, text_col: str = "text",
                          key: str = "msg_id", max_bytes: int = NAME_BYTES) -> DataFrame:
    """(key, product_group): the longest group name contained in the text, case-insensitive.

    The names of a block (about ``max_bytes``; a catalog's are one block as a rule)
    become an Aho-Corasick automaton in each task, which reads a message once,
    whatever prefixes the names share, and keeps the best name it meets: no pair
    of message and name is formed. Length ties go to the alphabetically first name.
    """
    names = groups.select(F.col("product_group_name").alias("group"), F.lower("product_group_name").alias("g")).where(F.col("g") != "")
    blocked, blocks = name_blocks(names.distinct(), max_bytes)
    lowered = messages.select(key, F.lower(F.col(text_col)).alias("low")).where(F.col("low").isNotNull())
    schema = T.StructType([messages.schema[key], T.StructField("group", T.StringType())])
    hits = None
    for k in range(blocks):
        best_of = {}
        for r in blocked.where(F.col("block") == k).collect():  # about max_bytes
            held = best_of.get(r["g"])
            best_of[r["g"]] = r["group"] if held is None else min(held, r["group"], key=lambda x: (-len(x), x))
        found = lowered.mapInPandas(_automaton_search(best_of, key, messages.sparkSession), schema)
        hits = found if hits is None else hits.unionByName(found)
    best = hits.groupBy(key).agg(F.min_by("group", F.struct(-F.length("group"), F.col("group"))).alias("product_group"))
    return messages.select(key).distinct().join(best, key, "left")


def _automaton_search(names: dict[str, str], key: str, spark: SparkSession):
    """A function over batches (key, low) that yields (key, group) of the longest name in each text."""
    known = spark.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for g, group in known.value.items():
            automaton.add_word(g, ((-len(group), group), group))
        automaton.make_automaton() if len(automaton) else None
        for b in batches:
            rows = []
            for at, low in zip(b[key], b["low"], strict=True):
                best = min((value for _, value in automaton.iter(low)), default=None) if len(automaton) else None
                if best is not None:
                    rows.append((at, best[1]))
            yield pd.DataFrame(rows, columns=[key, "group"])

    return run


def local_intent(df: DataFrame, text_col: str, groups: DataFrame, key: str, prefix: str = "") -> DataFrame:
    t = F.col(text_col)
    out = df.select(key, extract_colour(t).alias(f"{prefix}colour"), extract_style(t).alias(f"{prefix}style"),
                    extract_budget(t).alias(f"{prefix}max_budget"), extract_limit(t).alias(f"{prefix}limit"))
    pg = extract_product_group(df.select(key, text_col), groups, text_col, key).withColumnRenamed(
        "product_group", f"{prefix}product_group")
    return out.join(pg, key, "left")


def context_window(turns: DataFrame) -> DataFrame:
    """For each user turn: the intent text = last 6 history turns' user texts (greetings
    skipped) joined by newline, then the current message.

    Frames are per conversation and bounded (rowsBetween(-6, -1)).
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-CONTEXT_TURNS, -1)
    usable = F.when((F.col("role") == "user") & ~greeting_flag(F.col("text")), F.col("text"))
    ctx = F.collect_list(F.struct(F.col("turn"), usable.alias("t"))).over(w)
    ctx_text = F.transform(F.filter(ctx, lambda x: x["t"].isNotNull()), lambda x: x["t"])
    out = turns.withColumn("_ctx", ctx_text)
    return (out.where(F.col("role") == "user")
            .select("conv_id", "turn", F.col("text").alias("message"),
                    F.array_join(F.concat(F.col("_ctx"), F.array(F.col("text"))), "\n").alias("intent_text")))


def assistant_intents(turns: DataFrame, groups: DataFrame) -> DataFrame:
    """Guardrail, greeting, merged intent per user message.

    Intent comes from the context text; an explicit product group in the
    newest message overrides the historical one; a group turns demographics off.
    """
    ctx = context_window(turns).withColumn("msg_id", F.concat_ws(":", "conv_id", "turn"))
    hist = local_intent(ctx, "intent_text", groups, "msg_id")
    cur = extract_product_group(ctx, groups, "message", "msg_id").withColumnRenamed("product_group", "cur_product_group")
    j = ctx.join(hist, "msg_id").join(cur, "msg_id")
    unsafe = unsafe_flag(F.col("message"))
    greet = greeting_flag(F.col("message"))
    plain = ~unsafe & ~greet
    group = F.coalesce(F.col("cur_product_group"), F.col("product_group"))
    return j.select(
        "conv_id", "turn", "message",
        F.when(unsafe, F.lit("unsafe_or_prompt_injection")).alias("guardrail"),
        greet.alias("is_greeting"),
        F.when(plain, group).alias("product_group"),
        F.when(plain, F.col("style")).alias("style"),
        F.when(plain, F.col("colour")).alias("colour"),
        F.when(plain, F.col("max_budget")).alias("max_budget"),
        F.when(plain, F.col("limit")).otherwise(F.lit(DEFAULT_LIMIT)).alias("limit"),
        (plain & group.isNull()).alias("use_demographics"))


def constraint_filter(products: DataFrame, intents: DataFrame, key: str = "msg_id") -> DataFrame:
    """Filter a candidate pool per message, then keep the first ``limit`` by pool rank.

    group substring filter is skipped for catalog-search pools; colour must
    appear in colour + name + description, style in name + description.
    """
    j = products.join(intents.select(key, "product_group", "colour", "style", "limit"), key)
    low = lambda *cs: F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs]))
    ok_group = (F.col("product_group").isNull() | F.col("catalog_search")
                | F.lower(F.coalesce("product_group_name", F.lit(""))).contains(F.lower("product_group")))
    ok_colour = F.col("colour").isNull() | low("colour_text", "prod_name", "description").contains(F.lower("colour"))
    ok_style = F.col("style").isNull() | low("prod_name", "description").contains(F.lower("style"))
    kept = j.where(ok_group & ok_colour & ok_style)
    w = Window.partitionBy(key).orderBy("rank")
    return kept.withColumn("final_rank", F.row_number().over(w).cast("long")).where(F.col("final_rank") <= F.col("limit"))


def result_message(n: Column, colour: Column, style: Column, group: Column, budget: Column) -> Column:
    """'I found N grounded recommendation(s)[ for a · b].' plus a hint when empty."""
    budget_txt = F.when(budget.isNotNull(), F.concat(F.lit("under $"), budget.cast("long").cast("string")))
    parts = F.concat_ws(" · ", colour, style, group, budget_txt)
    qual = F.when(parts != "", F.concat(F.lit(" for "), parts)).otherwise(F.lit(""))
    msg = F.concat(F.lit("I found "), n.cast("string"), F.lit(" grounded recommendation(s)"), qual, F.lit("."))
    return F.when(n == 0, F.concat(msg, F.lit(" Try a broader category or fewer constraints."))).otherwise(msg)


def build_request(controls: DataFrame) -> DataFrame:
    """UI controls -> request rows.

    Personalized mode keeps only the user id; 'Not specified' / 'All products'
    are dropped; the session text splits on commas, trimmed, at most 50 ids.
    """
    personalized = F.col("mode") == "Personalized"
    drop = lambda c, sentinel: F.when(~personalized & ~F.col(c).isin(sentinel, ""), F.col(c))
    session = F.slice(F.filter(F.transform(F.split(F.coalesce("session_text", F.lit("")), ","), lambda s: F.trim(s)),
                               lambda s: s != ""), 1, 50)
    return controls.select(
        "request_id",
        F.when(personalized, F.nullif(F.trim("user_id"), F.lit(""))).alias("user_id"),
        F.col("limit").cast("int").alias("limit"),
        F.when(~personalized, F.col("age")).alias("age"),
        F.lower(drop("membership", "Not specified")).alias("club_member_status"),
        drop("product_group", "All products").alias("preferred_product_group"),
        F.when(personalized, F.array().cast("array<string>")).otherwise(session).alias("session_article_ids"))


def intent_eval(labelled: DataFrame, groups: DataFrame) -> DataFrame:
    """Field accuracy of local extraction against labelled queries, and unsafe recall."""
    lab = labelled.withColumn("msg_id", F.col("query_id").cast("string"))
    got = local_intent(lab, "query", groups, "msg_id")
    j = lab.join(got, "msg_id")
    eq = lambda a, b: F.when(F.col(a).eqNullSafe(F.col(b)), 1.0).otherwise(0.0)
    acc = j.agg(F.avg(eq("product_group", "expected_product_group")).alias("product_group_accuracy"),
                F.avg(eq("colour", "expected_colour")).alias("colour_accuracy"),
                F.avg(eq("max_budget", "expected_max_budget")).alias("budget_accuracy"),
                F.avg(eq("limit", "expected_limit")).alias("limit_accuracy"))
    return acc
