"""News: which articles belong to which symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidepanel.functions.scalars import article_text


def relevant(articles: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(symbol, text, published, url) for every alias an article mentions.

    The ticker is matched as written, the company name in any case. The aliases
    are configuration and become one literal array, so the match is a single
    map-side pass over the articles, without a join.
    """
    table = F.array(*[
        F.struct(F.lit(t).alias("symbol"), F.lit(n.lower()).alias("name"))
        for t, n in aliases.items()])
    text = article_text("title", "description")
    rows = articles.select("published", "url", text.alias("text"), F.lower(text).alias("_low"))
    hits = F.filter(
        table, lambda a: F.contains(F.col("text"), a["symbol"]) | F.contains(F.col("_low"), a["name"]))
    return rows.select(F.explode(F.transform(hits, lambda a: a["symbol"])).alias("symbol"),
                       "text", "published", "url")


def latest(news: DataFrame, count: int = 5) -> DataFrame:
    """Newest ``count`` articles per symbol, ties by address.

    The rank limit is applied before the shuffle as well, so a symbol with most of
    the articles sends only ``count`` rows per task.
    """
    w = W.partitionBy("symbol").orderBy(F.col("published").desc(), "url")
    return news.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count)


def shown(news: DataFrame) -> DataFrame:
    return news.withColumn("day", F.substring(F.col("published").cast("string"), 1, 10))
