"""Query understanding, rewriting, context, routing and extractive answers, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.config import DEFAULTS, Config
from sparkloom.functions import text as T

# What tells a query's intent and breadth, and filler that a rewrite drops.
QUESTION_WORDS = ("what", "when", "where", "which", "who", "why", "how")
SUMMARY_TERMS = ("summarize", "summarise", "summary", "overview", "brief")
ANALYSIS_TERMS = ("compare", "analyze", "analyse", "impact", "reason", "explain", "pros", "cons")
BREADTH_TERMS = ("all", "multiple", "across", "every")
FILLER_TERMS = (
    "hey", "hi", "hello", "dude", "bro", "please", "pls", "thanks",
    "tell", "me", "about", "like", "that", "just", "kinda", "really",
    "wanna", "gimme", "ok", "okay",
)
# The three variants' strategy, wording and confidence.
VARIANTS = (
    ("expand", "What do the indexed documents say about {subject}?", 0.72),
    ("disambiguate", "Which document or policy section covers {subject}?", 0.68),
    ("specify", "What are the specific rules, limits, and conditions for {core}?", 0.66),
)
# Fixed value: the answer where nothing was retrieved.
NO_CONTEXT = "I could not find relevant indexed content for this question."


def _any(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def understood(queries: DataFrame) -> DataFrame:
    """query_id, query with intent, entities (ten at most), language, complexity, token_count, entity_count, has_question_word."""
    rows = queries.withColumn("tokens", T.words(F.col("query"))).withColumn("every", T.phrases(F.col("query")))
    intent = (
        F.when(_any(F.col("tokens"), SUMMARY_TERMS), "summarization")
        .when(_any(F.col("tokens"), ANALYSIS_TERMS), "analysis")
        .when(_any(F.col("tokens"), QUESTION_WORDS), "question_answering")
        .otherwise("lookup")
    )
    rows = rows.withColumn("intent", intent)
    # What each sign adds to the complexity.
    score = (
        F.lit(0.15)
        + F.least(F.size("tokens") / 80, F.lit(0.35))
        + F.when(F.col("intent").isin("analysis", "summarization"), 0.20).otherwise(0.0)
        + F.when(F.size("every") > 2, 0.15).otherwise(0.0)
        + F.when(_any(F.col("tokens"), BREADTH_TERMS), 0.15).otherwise(0.0)
    )
    return rows.select(
        "query_id", "query", "intent", F.slice("every", 1, 10).alias("entities"), F.lit("en").alias("language"), F.round(F.least(score, F.lit(1.0)), 3).alias("complexity"),
        F.size("tokens").alias("token_count"), F.size("every").alias("entity_count"), _any(F.col("tokens"), QUESTION_WORDS).alias("has_question_word"),
    )


def rewritten(queries: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """Three variants of each query: query_id, variant_no, strategy, rewrite, confidence. The first is the best."""
    filler = F.array(*map(F.lit, FILLER_TERMS))
    tokens = T.words(F.col("query"))
    left = F.array_join(F.filter(tokens, lambda t: ~F.array_contains(filler, t)), " ")
    core = F.when(F.length(left) > 0, left).otherwise(T.strip(F.col("query")))
    subject = core
    if synonyms:
        known = F.create_map(*[F.lit(x) for k, v in synonyms.items() for x in (k.lower(), v)])
        words = F.array_distinct(F.split(F.array_join(F.transform(F.filter(F.array_distinct(tokens), lambda t: known[t].isNotNull()), lambda t: known[t]), " "), " "))
        subject = T.strip(F.concat(core, F.lit(" "), F.array_join(words, " ")))
    made = []
    for i, (strategy, wording, confidence) in enumerate(VARIANTS):
        before, _, after = wording.partition("{subject}" if "{subject}" in wording else "{core}")
        made.append(F.struct(F.lit(i).alias("variant_no"), F.lit(strategy).alias("strategy"), F.concat(F.lit(before), subject if "{subject}" in wording else core, F.lit(after)).alias("rewrite"), F.lit(confidence).alias("confidence")))
    return queries.select("query_id", F.inline(F.array(*made)))


def context(matches: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Matches (query_id, rank, text) that fit the budget, numbered from 1 as citation_id: the first of equal texts, in order, up to the first that doesn't fit; the best always."""
    same = Window.partitionBy("query_id", "condensed").orderBy("rank")
    ranked = Window.partitionBy("query_id").orderBy("rank")
    rows = matches.withColumn("condensed", T.condensed(F.col("text"), 1 << 30)).withColumn("again", F.row_number().over(same)).where("again = 1")
    rows = rows.withColumn("used", F.sum(F.length("text")).over(ranked.rowsBetween(Window.unboundedPreceding, 0))).withColumn("citation_id", F.row_number().over(ranked))
    budget = config.context_tokens * config.chars_per_token
    return rows.where((F.col("used") <= budget) | (F.col("citation_id") == 1)).drop("again", "used", "condensed")


def context_text(selected: DataFrame) -> DataFrame:
    """query_id, context: ``[n] text`` of all selected chunks."""
    rows = F.array_sort(F.collect_list(F.struct("citation_id", "text")))
    return selected.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), r["citation_id"], F.lit("] "), r["text"])), "\n\n").alias("context"))


def routed(understanding: DataFrame, selected: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """query_id, route, reason, confidence: the best chunk's score, clamped and rounded to three digits, and the query's intent and complexity decide."""
    best = selected.where("citation_id = 1").select("query_id", F.greatest(F.least(F.col("score"), F.lit(1.0)), F.lit(0.0)).alias("best"))
    rows = understanding.join(best, "query_id", "left").withColumn("confidence", F.round(F.coalesce("best", F.lit(0.0)), 3))
    direct = (F.col("confidence") >= config.route_confidence) & F.col("intent").isin("lookup", "question_answering")
    complicated = F.col("complexity") >= config.route_complexity
    empty = F.col("best").isNull()
    route = F.when(empty, "local_llm").when(direct, "direct").when(complicated, "online_llm").otherwise("local_llm")
    reason = F.when(empty, "nothing was found").when(direct, "the best chunk answers a plain question").when(complicated, "the question is complex").otherwise("chunks were found, but an answer must be put together")
    return rows.select("query_id", route.alias("route"), reason.alias("reason"), "confidence")


def extractive_answers(queries: DataFrame, selected: DataFrame) -> DataFrame:
    """query_id, answer: the first three chunks, condensed, each with its citation."""
    first = selected.where("citation_id <= 3")
    rows = F.array_sort(F.collect_list(F.struct("citation_id", "text")))
    made = first.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(T.condensed(r["text"], 500), F.lit(" ["), r["citation_id"], F.lit("]"))), " ").alias("made"))
    return queries.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce("made", F.lit(NO_CONTEXT)).alias("answer"))
