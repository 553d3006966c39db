"""Queries on routing and page layout, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.jobs.catalogue import query
from quarry.operators import layout, routing
from quarry.sources import views

#: Questions from turns of conversations, with a phrase in front of some.
PHRASES = ("what is ", "Track the ", "make study notes, store this: ", "12 km/h to m/s ", "please ", "define ")
ASKED = f"""qs AS (SELECT conv_id * 100 + turn AS qid, conv_id % 5 AS kind, CASE WHEN (conv_id + turn) % 11 = 0 THEN '(' || conv_id || ' + 2.5) * ' || turn || ' = ?' WHEN (conv_id + turn) % 11 = 1 THEN conv_id || ' + * 2' ELSE {list(PHRASES)!r}[CAST((conv_id + turn) % 6 AS INT) + 1] || text END AS question,
  CASE WHEN conv_id % 13 = 0 THEN ' Notes' WHEN conv_id % 13 = 1 THEN 'auto' END AS explicit FROM conversations)"""


def _asked(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), ((c + t) % 6 + 1).cast("int"))
    question = F.when((c + t) % 11 == 0, F.concat(F.lit("("), c.cast("string"), F.lit(" + 2.5) * "), t.cast("string"), F.lit(" = ?"))).when((c + t) % 11 == 1, F.concat(c.cast("string"), F.lit(" + * 2"))).otherwise(F.concat(phrase, "text"))
    return views.table(spark, sf_dir, "conversations").select((c * 100 + t).alias("qid"), (c % 5).alias("kind"), question.alias("question"), F.when(c % 13 == 0, " Notes").when(c % 13 == 1, "auto").alias("explicit"))


#: A word's edges by all letters, not by those of ASCII alone.
EDGE = (r"(^|[^\p{L}\p{N}\p{M}_])", r"($|[^\p{L}\p{N}\p{M}_])")


def _hits(terms) -> str:
    return " + ".join(f"CAST(contains(t, '{w}') AS INT)" if " " in w else rf"CAST(regexp_matches(t, '\b{w}\b') AS INT)" for w in terms)


ROUTES = rf"""{ASKED}, l AS (SELECT qid, kind, trim(question) AS q, lower(trim(question)) AS t, lower(trim(explicit)) AS x FROM qs), h AS (SELECT *, {_hits(routing.MONITOR)} AS m, {_hits(routing.NOTES)} AS n,
    regexp_matches(t, '^(what is|what are|define|explain)( |$)') AS start, len(list_filter(string_split_regex(q, '\s+'), lambda w: w <> '')) <= 14 AS few FROM l),
  rt AS (SELECT qid, kind, CASE WHEN x IN ('ask', 'monitor', 'notes', 'research') THEN {{'mode': x, 'confidence': 1.0::DOUBLE, 'reason': 'explicit'}} WHEN m > 0 THEN {{'mode': 'monitor', 'confidence': round(least(1, 0.6 + 0.1 * m), 4)::DOUBLE, 'reason': 'keywords'}}
    WHEN n > 0 THEN {{'mode': 'notes', 'confidence': round(least(1, 0.6 + 0.1 * n), 4)::DOUBLE, 'reason': 'keywords'}} WHEN regexp_matches(q, '^\(\d+ \+ 2\.5\) \* \d+ = \?$') THEN {{'mode': 'ask', 'confidence': 0.95::DOUBLE, 'reason': 'arithmetic'}}
    WHEN (regexp_matches(t, '\b(km/?h|kph|m/?s|mps|percent|%)\b') AND regexp_matches(t, '\b(to|in|as)\b') AND regexp_matches(t, '\d')) OR ((start OR regexp_matches(t, '{routing.DEFINITIONS}')) AND few) THEN {{'mode': 'ask', 'confidence': CASE WHEN start THEN 0.8 ELSE 0.75 END::DOUBLE, 'reason': 'pattern'}}
    ELSE {{'mode': 'research', 'confidence': 0.7::DOUBLE, 'reason': 'default'}} END AS r FROM h)"""


@query(f"WITH {ROUTES} SELECT qid, r.mode AS mode, r.confidence AS confidence, r.reason AS reason FROM rt")
def route_queries(spark, sf_dir):
    return routing.routed(_asked(spark, sf_dir))


@query(f"""WITH {ROUTES}, p AS (SELECT ['ask', 'monitor', 'notes', 'research', 'ask'][CAST(kind AS INT) + 1] AS expected, r.mode AS predicted FROM rt), e AS (SELECT unnest(['ask', 'monitor', 'notes', 'research']) AS expected),
  c AS (SELECT expected, count(*) FILTER (predicted = 'ask') AS ask, count(*) FILTER (predicted = 'monitor') AS monitor, count(*) FILTER (predicted = 'notes') AS notes, count(*) FILTER (predicted = 'research') AS research, count(*) AS "rows", count(*) FILTER (predicted = expected) AS "right" FROM p GROUP BY expected)
  SELECT expected, coalesce(ask, 0) AS ask, coalesce(monitor, 0) AS monitor, coalesce(notes, 0) AS notes, coalesce(research, 0) AS research, coalesce("rows", 0) AS "rows", coalesce("right", 0) AS "right" FROM e LEFT JOIN c USING (expected)""")
def router_eval(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    expected = F.element_at(F.array(*map(F.lit, ("ask", "monitor", "notes", "research", "ask"))), (F.col("kind") + 1).cast("int"))
    return routing.confusion(routing.routed(asked).join(asked.select("qid", expected.alias("expected")), "qid").select("expected", F.col("mode").alias("predicted")))


TERMS = {"science": ("the", "of the", "paper"), "daily": ("please", "la que", "und die"), "speed": ("km/h", "track the")}


@query(f"""WITH {ASKED}, l AS (SELECT qid, lower(question) AS t FROM qs), n AS (SELECT qid, t, {_hits(TERMS["science"])} AS a, {_hits(TERMS["daily"])} AS b, CAST(regexp_matches(t, '{EDGE[0]}km/h{EDGE[1]}') AS INT) + CAST(contains(t, 'track the') AS INT) AS c FROM l),
  x AS (SELECT *, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a >= b AND a >= c THEN 'science' WHEN b >= c THEN 'daily' ELSE 'speed' END AS intent, greatest(a, b, c) AS k FROM n)
  SELECT qid, intent, CASE WHEN k = 0 THEN 0 ELSE round(least(1, 0.4 + 0.2 * k), 4) END::DOUBLE AS confidence, CASE intent WHEN 'general' THEN NULL WHEN 'science' THEN 'beta,alpha' WHEN 'daily' THEN 'alpha' END AS sources FROM x""")
def live_intents(spark, sf_dir):
    """Intents with their sources that are enabled (alpha and beta)."""
    found = routing.intents(_asked(spark, sf_dir), TERMS)
    configured = spark.createDataFrame([("science", ["beta", "gamma", "alpha"]), ("daily", ["alpha"]), ("speed", ["gamma"])], "intent string, sources array<string>")
    enabled = spark.createDataFrame([("alpha",), ("beta",)], "source string")
    return found.join(routing.sources_for(found, configured, enabled), "qid", "left").select("qid", "intent", "confidence", "sources")


@query("""WITH v AS (SELECT event_id, event_type, value, CASE event_id % 4 WHEN 0 THEN value / 3.6 WHEN 1 THEN value * 3.6 WHEN 2 THEN value / 100 ELSE value * 100 END AS x FROM events),
  s AS (SELECT *, CASE WHEN abs(x - round(x)) < 1e-9 THEN CAST(CAST(round(x) AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.8f', x), '0+$', ''), '\\.$', '') END AS t FROM v)
  SELECT event_id, t || CASE event_id % 4 WHEN 0 THEN ' m/s' WHEN 1 THEN ' km/h' WHEN 2 THEN '' ELSE '%' END AS answer FROM s""")
def unit_answers(spark, sf_dir):
    told = F.expr("CASE event_id % 4 WHEN 0 THEN ' km/h in m/s' WHEN 1 THEN ' mps to kph' WHEN 2 THEN ' % as decimal' ELSE ' decimal to percent' END")
    return views.table(spark, sf_dir, "events").select("event_id", routing.converted(F.concat(F.lit("How much is "), F.format_string("%.2f", "value"), told)).alias("answer"))


#: The lines of a document as blocks of a page, alternately left and right on two pages of three.
BLOCKS = """bk AS (SELECT doc_id AS page, i, CASE WHEN doc_id % 3 <> 0 AND i % 2 = 1 THEN 320.0 ELSE 40.0 END::DOUBLE AS x0, CASE WHEN doc_id % 3 = 0 THEN 500.0 WHEN i % 2 = 1 THEN 580.0 ELSE 290.0 END::DOUBLE AS x1, (i // 2) * 30.0::DOUBLE + i % 2 AS y0, (i // 2) * 30.0::DOUBLE + 20 AS y1, 600.0::DOUBLE AS width, 800.0::DOUBLE AS height,
    CASE i % 13 WHEN 5 THEN 'Table 2 ' || ls[i + 1] WHEN 7 THEN 'a | b' || i WHEN 11 THEN '* note ' || i WHEN 12 THEN '..' ELSE ls[i + 1] END AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
  tx AS (SELECT *, trim(text) AS t, lower(trim(text)) AS low, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM bk)"""
CAP = "regexp_matches(low, '^(fig\\.|figure |table |tab\\.|algorithm )')"


def _blocks(spark, sf_dir):
    i, page = F.col("i"), F.col("page")
    lines = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    told = F.expr("CASE i % 13 WHEN 5 THEN concat('Table 2 ', line) WHEN 7 THEN concat('a | b', i) WHEN 11 THEN concat('* note ', i) WHEN 12 THEN '..' ELSE line END")
    right = (page % 3 != 0) & (i % 2 == 1)
    y = F.floor(i / 2) * F.lit(30.0)
    return lines.select("page", F.when(right, 320.0).otherwise(40.0).alias("x0"), F.when(page % 3 == 0, 500.0).when(i % 2 == 1, 580.0).otherwise(290.0).alias("x1"), (y + i % 2).alias("y0"), (y + 20).alias("y1"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), told.alias("text"))


KEPT = f"""kp AS (SELECT * FROM tx WHERE length(c) > 2 AND length(regexp_replace(c, '[^\\p{{L}}\\p{{N}}]', '', 'g')) > 0 AND length(regexp_replace(c, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(c) >= 0.2 AND NOT {CAP} AND NOT ((y1 < 48 OR y0 > 752) AND length(t) < 120)),
  ce AS (SELECT page, list_sort(list((x0 + x1) / 2)) AS ms, list((x0 + x1) / 2) FILTER (y0 < 440) AS top, count(*) AS n FROM kp GROUP BY page), sp AS (SELECT page, n, top, ms[greatest(1, n // 2)] AS a, ms[n // 2 + 1] AS b FROM ce),
  co AS (SELECT page, n AS blocks, n >= 8 AND b - a >= 48 AND (top IS NULL OR (list_min(top) <= (a + b) / 2 AND list_max(top) > (a + b) / 2)) AS two_columns, (a + b) / 2 AS m FROM sp)"""


@query(f"WITH {BLOCKS}, {KEPT} SELECT page, blocks, two_columns, CASE WHEN two_columns THEN m ELSE 0 END::DOUBLE AS split FROM co")
def two_columns(spark, sf_dir):
    return layout.columns(layout.kept(_blocks(spark, sf_dir)))


@query(f"""WITH {BLOCKS}, {KEPT} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE WHEN two_columns AND (x0 + x1) / 2 > m THEN 1 ELSE 0 END, CASE WHEN two_columns THEN floor(y0 / 24) ELSE 0 END, y0, x0, kp.text) AS INT) AS place, t AS text FROM kp JOIN co USING (page)""")
def layout_reading_order(spark, sf_dir):
    return layout.reading_order(_blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS}, lb AS (SELECT *, CASE WHEN y1 < 48 AND length(t) < 140 THEN 'header' WHEN y0 > 760 AND length(t) < 140 THEN 'footer' WHEN {CAP} THEN 'caption'
    WHEN y0 > 672 AND (regexp_matches(t, '^\\d+[\\].)]\\s') OR regexp_matches(t, '^[*†‡]\\s') OR regexp_matches(low, '^(notes?:|footnote|\\*)') OR (length(t) < 220 AND regexp_matches(low, '\\bdoi\\b|\\bhttp\\b|\\barxiv\\b'))) THEN 'footnote'
    WHEN contains(c, '|') OR contains(text, chr(9)) OR (length(c) > 25 AND length(regexp_replace(c, '[^0-9]', '', 'g')) >= 6 AND length(regexp_replace(c, '[^:;,_%-]', '', 'g')) >= 4) THEN 'table' WHEN (x0 + x1) / 2 <= 300 THEN 'body_left' ELSE 'body_right' END AS label FROM tx WHERE t <> ''),
  pg AS (SELECT page, coalesce(string_agg(CASE WHEN label IN ('table', 'footnote') THEN c ELSE t END, chr(10) ORDER BY CASE label WHEN 'body_left' THEN 1 WHEN 'body_right' THEN 2 WHEN 'table' THEN 3 WHEN 'caption' THEN 4 ELSE 5 END, floor(y0 / 24), y0, x0) FILTER (label NOT IN ('header', 'footer')), '') AS text, count(*) AS total,
    count(*) FILTER (label LIKE 'body%') AS body, count(*) FILTER (label = 'table') AS tables, count(*) FILTER (label = 'footnote') AS footnotes, count(*) FILTER (label = 'caption') AS captions, count(*) FILTER (label IN ('header', 'footer')) AS edges, count(*) FILTER (label LIKE 'body%' AND x0 < 210 AND x1 > 390) AS wide FROM lb GROUP BY page)
  SELECT page, text, round(greatest(0, least(1, (0.45 * body / total + 0.20 * (1 - edges / total) + 0.20 * least(1, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) / 2200) + 0.15 * (1 - least(0.9, (tables + footnotes + captions) / total))) * (1 - least(0.4, wide / total))))::DOUBLE, 9) AS confidence, body, tables, footnotes, captions, edges FROM pg""")
def layout_confidence(spark, sf_dir):
    return layout.page_texts(_blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS} SELECT CASE WHEN x0 < 100 THEN 'left' ELSE 'right' END AS label, count(*) AS n FROM bk GROUP BY 1""")
def region_counts(spark, sf_dir):
    side = F.when(F.col("x0") < 100, "left").otherwise("right")
    pages = _blocks(spark, sf_dir).groupBy("page", side.alias("side")).agg(F.count("*").cast("int").alias("n")).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("side", "n"))).alias("counts"))
    return layout.region_counts(pages)
