"""An offline crawl over a table of pages and their links, and link extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .html import html_links


def links(pages: DataFrame) -> DataFrame:
    """page_id, place, href: targets of anchors in order, resolved against the page's address."""
    return pages.select("page_id", F.posexplode(html_links("html", "url")).alias("place", "href"))


def crawl(pages: DataFrame, web: DataFrame, seeds: DataFrame, max_depth: int = 4, max_pages: int | None = None, domains: list[str] | None = None, allow_query: bool = False, download_pdfs: bool = False, skip: DataFrame | None = None, **filters) -> DataFrame:
    """url, depth, place, status, reason, resource_type of what is visited from the seeds, breadth first, each address once.

    pages: url and, where it is known, content_type; web: url, place, href; seeds: place, url. Status is
    ok; error for an address without a page; or skipped for one of another content type than HTML, or PDF
    where these are wanted. Links of HTML pages only are followed. A level's addresses come in order of the
    page that links to them and of their place there; max_pages, counted over all that is visited, cuts the last level
    by that order. domains and filters (see passes_filters) hold for seeds and links; addresses of `skip`
    (url) count as visited. The session needs a checkpoint folder that all executors share; each level is
    checkpointed there.
    """
    spark = web.sparkSession
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir") and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")

    def fit(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("url").rlike("^https?://")).where(T.passes_filters(F.col("url"), **filters))
        return rows.where(T.domain_allowed(F.col("url"), domains)) if domains else rows

    canonical = lambda c: T.canonical_url(F.col(c), allow_query)
    known = fit(web.select(canonical("url").alias("source"), "place", canonical("href").alias("url")))
    kind = F.lower(F.coalesce("content_type", F.lit(""))) if "content_type" in pages.columns else F.lit("text/html")
    known_pages = pages.select(canonical("url").alias("url"), kind.alias("kind")).groupBy("url").agg(F.min("kind").alias("kind"))
    html = F.contains("kind", F.lit("text/html"))
    pdf = F.contains("kind", F.lit("application/pdf")) | F.endswith(F.lower("url"), F.lit(".pdf"))
    taken = F.when(html, "html").when(pdf & F.lit(download_pdfs), "pdf")
    skipped = skip.select(canonical("url").alias("url")).distinct() if skip is not None else None

    def level(found: DataFrame, depth: int) -> DataFrame:
        """Addresses with status and place; places ascend over the level's partitions, sorted by parent and place of the link."""
        found = found.join(skipped, "url", "left_anti") if skipped is not None else found
        first = found.groupBy("url").agg(F.min(F.struct("parent", "link")).alias("o")).orderBy("o", "url").select("url", F.lit(depth).alias("depth"), F.monotonically_increasing_id().alias("place"))
        found_pages = first.join(known_pages, "url", "left").withColumn("resource_type", F.when(F.col("kind").isNotNull(), taken))
        status = F.when(F.col("kind").isNull(), "error").when(F.col("resource_type").isNull(), "skipped").otherwise("ok")
        reason = F.when(status == "skipped", "unsupported_content_type")
        return found_pages.select("url", "depth", "place", status.alias("status"), reason.alias("reason"), "resource_type").checkpoint()

    frontier = level(fit(seeds.select(canonical("url").alias("url"), F.lit(0).cast("long").alias("parent"), F.col("place").cast("long").alias("link"))), 0)
    levels, left = [], max_pages
    for depth in range(1, max_depth + 2):
        if left is not None:
            n = frontier.count()
            frontier = frontier if n <= left else frontier.orderBy("place").limit(left).checkpoint()
            left -= min(n, left)
        levels.append(frontier)
        if depth > max_depth or left == 0 or frontier.isEmpty():
            break
        step = frontier.where("resource_type = 'html'").select(F.col("url").alias("source"), F.col("place").alias("parent")).join(known.withColumnRenamed("place", "link"), "source")
        visited = reduce(DataFrame.unionByName, levels).select("url")
        frontier = level(step.join(visited, "url", "left_anti").select("url", "parent", F.col("link").cast("long").alias("link")), depth)
    return reduce(DataFrame.unionByName, levels)


def summary(visited: DataFrame) -> DataFrame:
    """Counts of a crawl's rows by status and, where they have a resource_type, by that."""
    kind = F.col("resource_type") if "resource_type" in visited.columns else F.lit("html")
    n = lambda c: F.count(F.when(c, 1))
    ok = F.col("status") == "ok"
    return visited.agg(n(ok).alias("ok"), n(ok & (kind == "html")).alias("html"), n(ok & (kind == "pdf")).alias("pdf"), n(F.col("status") == "skipped").alias("skipped"), n(F.col("status") == "error").alias("errors"))


def filter_jobs(jobs: DataFrame, groups=(), include=(), exclude=()) -> DataFrame:
    """Jobs (name, group) of the groups and names that are given, without those excluded, in any case of letters."""
    low = lambda values: [v.lower() for v in values]
    if groups:
        jobs = jobs.where(F.lower("group").isin(*low(groups)))
    if include:
        jobs = jobs.where(F.lower("name").isin(*low(include)))
    if exclude:
        jobs = jobs.where(~F.lower("name").isin(*low(exclude)))
    return jobs
