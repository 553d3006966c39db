"""Items of feeds and JSON services as rows; each item keeps its own fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text

_ITEM = "struct<title:string,link:array<struct<_VALUE:string,_href:string>>,description:string,summary:string,pubDate:string,published:string>"
#: What is read of an RSS, RDF or Atom document, whatever its outer element.
FEED = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ITEM}>"


def ident(source: Column, url: Column, body: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, F.coalesce(url, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 120)), 256), 1, 16)


def _stripped(c: Column, letters: str = r"\s") -> Column:
    return F.regexp_replace(c, f"^[{letters}]+|[{letters}]+$", "")


def feed_items(feeds: DataFrame, most: int = 20) -> DataFrame:
    """source, at, id, title, url, text, published of feeds(source, url, payload): the first items of each RSS, RDF or Atom document.

    Items stand where their document has them, from 0. Without a link the feed's own url is an item's; its text is title and
    description. A document that can't be read has no items.
    """
    read = F.from_xml("payload", F.lit(FEED), {"mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE"})
    none = F.array().cast(f"array<{_ITEM}>")
    some = lambda *cs: F.coalesce(*[F.when(F.size(c) > 0, c) for c in cs], none)
    docs = feeds.where(F.col("payload").rlike("<")).select("source", "url", read.alias("d")).select("source", "url", some(F.col("d.channel.item"), F.col("d.item"), F.col("d.entry")).alias("items"))
    rows = docs.select("source", "url", F.posexplode(F.slice("items", 1, max(1, most))).alias("at", "i"))
    told = lambda *names: F.coalesce(*[F.when(F.trim(F.col(f"i.{n}")) != "", _stripped(F.col(f"i.{n}"))) for n in names], F.lit(""))
    links = F.coalesce("i.link", F.array().cast("array<struct<_VALUE:string,_href:string>>"))
    first = F.get(links, F.lit(0))
    link = F.coalesce(F.when(F.trim(first["_VALUE"]) != "", F.trim(first["_VALUE"])), F.when(F.trim(first["_href"]) != "", F.trim(first["_href"])), F.col("url"))
    named = rows.select("source", "at", told("title").alias("title"), link.alias("link"), told("description", "summary").alias("about"), told("pubDate", "published").alias("published"))
    body = _stripped(F.concat("title", F.lit(": "), "about"), ": ")
    full = named.withColumn("text", body)
    or_null = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return full.select("source", "at", ident(F.col("source"), F.col("link"), F.col("text")).alias("id"), or_null("title"), F.col("link").alias("url"), "text", or_null("published"))


def rest_items(answers: DataFrame, path: str = "", template: str = "{value}", most: int = 20) -> DataFrame:
    """source, at, id, url, text of answers(source, url, payload), JSON each: the values at path (a list's, or the one) in the template; without a path the whole answer, cut at 2,000 characters.

    An answer that isn't JSON has no items; nor has one without anything at path.
    """
    json = F.try_parse_json("payload")
    rows = answers.where(json.isNotNull())
    if path:
        held = F.get_json_object("payload", f"$.{path}")
        values = F.when(held.rlike(r"^\s*\["), F.from_json(held, "array<string>")).otherwise(F.array(held))
        parts = rows.select("source", "url", F.posexplode(F.slice(values, 1, max(1, most))).alias("at", "value")).where("value IS NOT NULL")
        before, _, after = template.partition("{value}")
        parts = parts.select("source", "url", "at", F.concat(F.lit(before), "value", F.lit(after)).alias("text"))
    else:
        parts = rows.select("source", "url", F.lit(0).alias("at"), F.substring(F.to_json(json), 1, 2000).alias("text"))
    return parts.select("source", "at", ident(F.col("source"), F.col("url"), F.col("text")).alias("id"), "url", "text")


def scraped_items(pages: DataFrame, query: str = "") -> DataFrame:
    """source, id, url, text of pages(source, url, payload): the page's text; one that doesn't hold the query is cut at 3,000 characters."""
    body = text.strip_html(F.col("payload"))
    held = F.contains(F.lower(body), F.lit(query.lower())) if query else F.lit(True)
    return pages.select("source", "url", F.when(held, body).otherwise(F.substring(body, 1, 3000)).alias("text")).select("source", ident(F.col("source"), F.col("url"), F.col("text")).alias("id"), "url", "text")
