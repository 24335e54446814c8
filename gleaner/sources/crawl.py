"""Crawl over a table of pages, in the order in which links are found.

A round takes all addresses of one depth: the frontier, which carries addresses
and ranks only.  It is joined with the table for the links of its pages; their
html is read once more at the end, for the pages that are returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.html import page_hrefs, page_text
from gleaner.functions.web import in_scope, normal_url
from gleaner.operators.cuts import stored

MOST_PAGES, DEEPEST, MOST_LINKS = 50, 3, 80


def crawl(
    pages: DataFrame, root: str, most_pages: int = MOST_PAGES, deepest: int = DEEPEST, most_links: int = MOST_LINKS, link_selector: str = ""
) -> DataFrame:
    """rank, url, depth, html, text of the pages reached from ``root`` inside
    its scope, ranked as a queue would take them: first found, first read.

    A page without text does not count against ``most_pages``, but its links
    are followed.  A page adds at most ``most_links`` addresses, of those not
    read before it.  Of rows with one address the one of the smallest raw
    address counts.
    """
    spark = pages.sparkSession
    at = F.col("url")
    whole = pages.select(at.alias("raw"), normal_url(at, at).alias("url"), "html").where("url is not null")
    start = spark.createDataFrame([(root,)], "url string").select(normal_url(F.col("url"), F.col("url")).alias("url"), F.lit(0).cast("long").alias("rank"))
    frontier = stored(start.where("url is not null"))
    popped, taken, depth = frontier, None, 0
    left, ranks = most_pages, 1
    while left > 0:
        # addresses are few; the table is read where it is
        here = whole.join(frontier, "url").groupBy("url", "rank").agg(F.min_by("html", "raw").alias("html"))
        here = here.where(in_scope(F.lit(root), F.col("url")))
        read = here.select("url", "rank", (page_text(F.col("html"), F.col("url"))["text"].isNotNull()).alias("says"), F.coalesce(page_hrefs(F.col("html"), link_selector), F.array().cast("array<string>")).alias("hrefs"))
        read = stored(read)
        # the page that fills the budget is the last one that is read
        last = read.where("says").orderBy("rank").limit(left).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("r")).first()
        if last["n"] >= left:
            read = read.where(F.col("rank") <= last["r"])
        got = read.where("says").select("url", "rank", F.lit(depth).alias("depth"))
        taken = got if taken is None else taken.unionByName(got)
        left -= last["n"]
        if left <= 0 or depth == deepest:
            break
        found = read.select(F.col("url").alias("from"), "rank", F.posexplode("hrefs").alias("p", "href"))
        found = found.withColumn("link", normal_url(F.col("href"), F.col("from"))).where("link is not null")
        found = found.groupBy("from", "rank", "link").agg(F.min("p").alias("p")).where(in_scope(F.lit(root), F.col("link")))
        # what was read before this page is no link; what is read after it, on the same depth, fills a place
        before = popped.select(F.col("url").alias("link"), F.col("rank").alias("then"))
        found = found.join(before, "link", "left").where(F.col("then").isNull() | (F.col("then") > F.col("rank")))
        nth = F.row_number().over(Window.partitionBy("from").orderBy("p"))
        found = found.withColumn("n", nth).where((F.col("n") <= most_links) & F.col("then").isNull())
        first = found.groupBy("link").agg(F.min(F.struct("rank", "p")).alias("k"))
        # some pages times their links: the frontier's addresses, not the table
        order = F.row_number().over(Window.orderBy("k.rank", "k.p"))
        frontier = stored(first.select(F.col("link").alias("url"), (order + (ranks - 1)).cast("long").alias("rank")))
        n = frontier.count()
        if not n:
            break
        ranks += n
        popped = stored(popped.unionByName(frontier))
        depth += 1
    if taken is None:
        taken = frontier.where("false").select("url", "rank", F.lit(0).alias("depth"))
    chosen = stored(taken.withColumn("rank", F.row_number().over(Window.orderBy("rank"))))  # most_pages rows
    out = whole.join(chosen, "url").groupBy("rank", "url", "depth").agg(F.min_by("html", "raw").alias("html"))
    return out.withColumn("text", page_text(F.col("html"), F.col("url"))["text"])


def subset(pages: DataFrame, root: str, wanted: list[str]) -> DataFrame:
    """url, html, text, error of chosen addresses of a site, in their order:
    those outside its scope are left out, those not in the table are missing
    pages, those without text say so."""
    spark = pages.sparkSession
    at = F.col("url")
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(wanted)], "position int, asked string")
    asked = asked.select("position", normal_url(F.col("asked"), F.lit(root)).alias("url")).where("url is not null")
    asked = asked.groupBy("url").agg(F.min("position").alias("position")).where(in_scope(F.lit(root), F.col("url")))
    whole = pages.select(at.alias("raw"), normal_url(at, at).alias("url"), "html").where("url is not null")
    found = whole.join(stored(asked), "url").groupBy("url").agg(F.min_by("html", "raw").alias("html"))
    rows = asked.join(found, "url", "left").withColumn("r", page_text(F.col("html"), F.col("url")))
    error = F.when(F.col("html").isNull(), "missing").otherwise(F.col("r.error"))
    return rows.select("position", "url", "html", F.col("r.text").alias("text"), error.alias("error"))
