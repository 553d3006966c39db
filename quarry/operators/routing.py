"""Routing of questions by keywords and patterns, intents, unit conversion, evaluation of a router."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that route, and how questions for a definition begin.
MONITOR = ("monitor", "track", "notify", "alert")
NOTES = ("notes", "study notes", "summarize as notes", "store this")
DEFINITIONS = r"\b(what is|what are|who is|who are|who was|define|explain)\b"
MODES = ("ask", "monitor", "notes", "research")


def held(lowered: Column, terms) -> Column:
    """Distinct terms that a lowered text holds, sorted: those with a space anywhere, others as whole words."""
    own = sorted({t.strip().lower() for t in terms if t.strip()})
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(t)) if " " in t else lowered.rlike(rf"(?U)\b{re.escape(t)}\b"), F.lit(t)) for t in own]))


def is_arithmetic(question: Column, most: int = 3) -> Column:
    """Digits, one to most operators or none, parentheses, = and ? alone, with operands between the operators and parentheses that close."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(question, r"[=?]", " "), r"\s+", " "))
    number = r"[+\-]?(\d+(\.\d*)?|\.\d+)"
    flat = F.regexp_replace(plain, r"[\s]", "")
    # innermost parentheses are taken away, as often as operators allow
    for _ in range(most + 1):
        flat = F.regexp_replace(flat, rf"\({number}([+\-*/]{number})*\)", "1")
    fits = flat.rlike(rf"^{number}([+\-*/]{number})*$") & ~plain.rlike(r"[\d.] +[\d.]")
    return question.rlike(r"\d") & question.rlike(r"^[\d\s+\-*/().=?]+$") & fits & (F.length(F.regexp_replace(plain, r"[^+\-*/]", "")) <= most)


def routed(questions: DataFrame, short: int = 14) -> DataFrame:
    """qid, mode, confidence, reason of questions(qid, question, explicit): explicit mode, monitoring, notes, arithmetic, units or a short question for a definition, else research."""
    q = questions.select("qid", F.trim(F.coalesce("question", F.lit(""))).alias("q"), F.lower(F.trim("explicit")).alias("explicit"))
    low = F.lower("q")
    told = q.select("qid", "q", "explicit", low.alias("t"), F.size(held(low, MONITOR)).alias("m"), F.size(held(low, NOTES)).alias("n"))
    few = F.size(F.filter(F.split("q", r"\s+"), lambda w: w != "")) <= short
    unit = F.col("t").rlike(r"\b(km/?h|kph|m/?s|mps|percent|%)\b") & F.col("t").rlike(r"\b(to|in|as)\b") & F.col("t").rlike(r"\d")
    start = F.col("t").rlike(r"^(what is|what are|define|explain)( |$)")
    asked = unit | ((start | F.col("t").rlike(DEFINITIONS)) & few)
    row = lambda mode, confidence, reason: F.struct(F.lit(mode).alias("mode") if isinstance(mode, str) else mode.alias("mode"), confidence.cast("double").alias("confidence"), F.lit(reason).alias("reason"))
    hits = lambda c: F.round(F.least(F.lit(1.0), 0.6 + 0.1 * F.col(c)), 4)
    made = (
        F.when(F.col("explicit").isin(*MODES), row(F.col("explicit"), F.lit(1.0), "explicit"))
        .when(F.col("m") > 0, row("monitor", hits("m"), "keywords"))
        .when(F.col("n") > 0, row("notes", hits("n"), "keywords"))
        .when(is_arithmetic(F.col("q")), row("ask", F.lit(0.95), "arithmetic"))
        .when(asked, row("ask", F.when(start, 0.8).otherwise(0.75), "pattern"))
        .otherwise(row("research", F.lit(0.7), "default"))
    )
    return told.select("qid", made.alias("r")).select("qid", "r.*")


def confusion(pairs: DataFrame, labels=MODES) -> DataFrame:
    """expected, a count for each predicted label, rows, right of pairs(expected, predicted); labels that never occur have a row of zeros."""
    every = pairs.sparkSession.createDataFrame([(m,) for m in labels], "expected string")
    counts = pairs.groupBy("expected").agg(*(F.count_if(F.col("predicted") == m).alias(m) for m in labels), F.count("*").alias("rows"), F.count_if(F.col("expected") == F.col("predicted")).alias("right"))
    return every.join(counts, "expected", "left").na.fill(0)


def intents(questions: DataFrame, terms: dict[str, tuple[str, ...]]) -> DataFrame:
    """qid, intent, confidence, matched: the intent with most terms in a question, the first of terms on a tie; general without any."""
    low = F.lower(F.coalesce("question", F.lit("")))
    found = F.array(*[F.struct(F.size(held(low, words)).alias("n"), F.lit(-i).alias("turn"), F.lit(name).alias("intent"), held(low, words).alias("matched")) for i, (name, words) in enumerate(terms.items())])
    best = questions.select("qid", F.array_max(found).alias("b"))
    none = F.col("b.n") == 0
    return best.select("qid", F.when(none, "general").otherwise(F.col("b.intent")).alias("intent"), F.when(none, 0.0).otherwise(F.round(F.least(F.lit(1.0), 0.4 + 0.2 * F.col("b.n")), 4)).alias("confidence"), F.array_join(F.when(none, F.array().cast("array<string>")).otherwise(F.col("b.matched")), ",").alias("matched"))


def sources_for(found: DataFrame, configured: DataFrame, enabled: DataFrame) -> DataFrame:
    """qid, sources: the enabled ones of configured(intent, sources array) in their order; of found(qid, intent)."""
    one = found.join(configured, "intent").select("qid", F.posexplode("sources").alias("at", "source")).join(enabled, "source", "left_semi")
    return one.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x.source), ",").alias("sources"))


def shown(x: Column) -> Column:
    """A number without zeros at its end, whole if it is."""
    near = F.abs(x - F.round(x)) < 1e-9
    cut = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", x), "0+$", ""), r"\.$", "")
    return F.when(near, F.round(x).cast("long").cast("string")).otherwise(cut)


def converted(question: Column) -> Column:
    """The answer to a question for km/h in m/s, m/s in km/h, percent as decimal or decimal as percent; null for others."""
    low, number = F.lower(F.trim(question)), r"([-+]?\d+(?:\.\d+)?)\s*"
    out = F.lit(None).cast("string")
    for pattern, by, unit in reversed(((rf"{number}(?:km/?h|kph)\s*(?:to|in|as)\s*(?:m/?s|mps)", 1 / 3.6, " m/s"), (rf"{number}(?:m/?s|mps)\s*(?:to|in|as)\s*(?:km/?h|kph)", 3.6, " km/h"), (rf"{number}%\s*(?:to|in|as)?\s*decimal", 0.01, ""), (rf"{number}decimal\s*(?:to|in|as)\s*percent", 100.0, "%"))):
        value = F.regexp_extract(low, pattern, 1)
        x = value.try_cast("double")
        out = F.when(value != "", F.concat(shown(x / 3.6 if by == 1 / 3.6 else x / 100 if by == 0.01 else x * by), F.lit(unit))).otherwise(out)
    return out
