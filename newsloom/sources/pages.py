"""[A4 to A8, A15, A16] Stored pages in place of a live crawl: fields, link rules, task calendar, paging boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_fields(pages: DataFrame) -> DataFrame:
    """[A6, G1] url_hash, title, text length and link count of each page; a page without a title is ``Unknown Title``."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    text = F.trim(F.regexp_replace(body, r"\s+", " "))
    return pages.select("page_id", "url", F.md5("url").alias("url_hash"), F.when(title == "", "Unknown Title").otherwise(title).alias("title"), text.alias("content_text"))


def page_links(pages: DataFrame) -> DataFrame:
    """[A4] The absolute links of each page; a link from the root gets the page's host."""
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    links = pages.select("page_id", host.alias("host"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"#]+)"'), 1))).alias("link"))
    return links.select("page_id", F.when(F.col("link").startswith("/"), F.concat("host", "link")).otherwise(F.col("link")).alias("link"))


def json_links(replies: DataFrame) -> DataFrame:
    """[A5] (page_id, link) of replies (page_id, body) that are JSON lists of posts; posts without a link and other replies give none."""
    posts = F.from_json("body", "array<struct<link: string>>")
    return replies.select("page_id", F.explode(posts.link).alias("link")).where(F.coalesce("link", F.lit("")) != "")


def calendar(spark: SparkSession, outlets: DataFrame, start: str, end: str) -> DataFrame:
    """[A15] One task for each day and outlet."""
    return outlets.select(F.col("id").alias("outlet_id"), F.explode(F.expr(f"sequence(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)")).alias("day"))


def next_pages(found: DataFrame, today: str, days: int = 2) -> DataFrame:
    """[A16, X28] Pages whose oldest dated link is recent enough, with the next page. found: outlet_id, page, published_on."""
    oldest = found.groupBy("outlet_id", "page").agg(F.min("published_on").alias("oldest"))
    return oldest.where(F.col("oldest") >= F.date_sub(F.lit(today).cast("date"), days)).select("outlet_id", (F.col("page") + 1).alias("page"))
