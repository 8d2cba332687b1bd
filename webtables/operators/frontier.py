"""What to capture next: seeds, fallbacks and sitemap entries as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from webtables.functions import entities
from webtables.sources.tables import materialise

# Where a site's sitemap is looked for, in order.
SITEMAP_SUFFIXES = ("/robots.txt", "/sitemap.xml")
# Nested sitemaps worth reading.
FOLLOWED = (r"\.nz/",)
# Page rules as (pattern, page type); the first match decides.
PAGE_RULES = (
    ("/about-?us", "about_us"),
    ("/(contact-?us)|(contact)", "about_us"),
)


def seed_slice(seeds: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Homepages of the seeds on lines ``[start, end)``; no end means all.

    The first three lines of a seed list are no sites.
    """
    try:
        start = int(start)
        end = end if end is None else int(end)
    except (TypeError, ValueError):
        raise ValueError("the bounds of a slice are line numbers, so integers") from None
    if start <= 3:
        raise ValueError("the first site is on line 4, so no slice starts before it")
    line = F.col("txt_line_num")
    chosen = seeds.filter(line >= start)
    if end is not None:
        if start > end:
            raise ValueError("the slice ends before it starts")
        last = seeds.agg(F.coalesce(F.max("txt_line_num"), F.lit(0))).first()[0]
        if end > last + 1:
            raise ValueError(f"the list ends at line {last}, so no slice reaches beyond {last + 1}")
        chosen = chosen.filter(line < end)
    return chosen.select(
        "txt_line_num", "netloc", F.concat(F.lit("https://"), "netloc").alias("homepage")
    )


def start_requests(
    homepages: DataFrame, suffixes: Sequence[str] = SITEMAP_SUFFIXES
) -> DataFrame:
    """Each seed's homepage and the first place to look for its sitemap."""
    home = F.col("homepage")
    wanted = F.array(
        F.struct(F.lit("homepage").alias("kind"), home.alias("url"), F.lit(None).cast("string").alias("suffix")),
        F.struct(
            F.lit("sitemap").alias("kind"),
            F.concat(home, F.lit(suffixes[0])).alias("url"),
            F.lit(suffixes[0]).alias("suffix"),
        ),
    )
    return homepages.select("txt_line_num", "homepage", F.inline(wanted))


def fallback_requests(
    fetch_log: DataFrame, suffixes: Sequence[str] = SITEMAP_SUFFIXES
) -> DataFrame:
    """The next place to look, for sitemap attempts that ended in a 404."""
    following = F.lit(None).cast("string")
    for tried, then in zip(suffixes, suffixes[1:]):
        following = F.when(F.col("suffix") == tried, then).otherwise(following)
    return (
        fetch_log.filter((F.col("kind") == "sitemap") & (F.col("status") == 404))
        .select("homepage", following.alias("suffix"))
        .filter(F.col("suffix").isNotNull())
        .select("homepage", "suffix", F.concat("homepage", "suffix").alias("url"))
    )


def sitemap_locations(bodies: DataFrame) -> DataFrame:
    """Locations listed by robots files and sitemaps: url, kind, loc.

    ``kind`` is ``robots``, ``sitemapindex`` or ``urlset``; others list nothing.
    """
    body = F.col("body")
    root = F.lower(
        F.regexp_extract(body, r"(?is)<(?:[a-z0-9]+:)?(sitemapindex|urlset)(?:[ \t\n\f\r][^>]*)?>", 1)
    )
    robots = F.regexp_extract_all(
        body, F.lit(r"(?im)^[ \t\f]*sitemap:[ \t\f]*([^\r\n]*?)[ \t\f]*\r?$"), F.lit(1)
    )
    listed = F.transform(
        F.regexp_extract_all(
            body, F.lit(r"(?is)<loc(?:[ \t\n\f\r][^>]*)?>[ \t\n\f\r]*(.*?)[ \t\n\f\r]*</loc>"), F.lit(1)
        ),
        lambda loc: entities.decode(
            F.regexp_replace(loc, r"(?s)^<!\[CDATA\[[ \t\n\f\r]*(.*?)[ \t\n\f\r]*\]\]>$", "$1"),
            loose=False,
        ),
    )
    kind = F.when(F.col("url").endswith("/robots.txt"), "robots").when(root != "", root)
    locations = F.when(F.col("kind") == "robots", robots).otherwise(listed)
    return (
        bodies.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select("url", "kind", F.explode(locations).alias("loc"))
    )


def followed_sitemaps(
    locations: DataFrame, patterns: Sequence[str] = FOLLOWED
) -> DataFrame:
    """Sitemaps to read next: all that robots files name, and matching nested ones."""
    matches = F.lit(False)
    for pattern in patterns:
        matches = matches | F.col("loc").rlike(pattern)
    return locations.filter(
        (F.col("kind") == "robots") | ((F.col("kind") == "sitemapindex") & matches)
    )


def sitemap_closure(bodies: DataFrame, patterns: Sequence[str] = FOLLOWED) -> DataFrame:
    """Every sitemap reached from the robots files, followed to the end: url, depth.

    Robots files have depth 0; a location that a reached robots file names, or a
    reached sitemap index lists and ``patterns`` match, is reached one deeper.
    A semi-naive fixpoint: each round joins only the sitemaps first reached in
    the round before with the edges, and keeps those never reached (an anti-join
    with the written rounds), so a cycle ends and depth is the least. Reached
    locations without a body are kept and end there. Each round is written once,
    so the lineage is one round deep and the result a union of written rounds.
    """
    locations = sitemap_locations(bodies)
    edges = materialise(
        followed_sitemaps(locations, patterns)
        .filter(F.col("loc") != "")
        .select(F.col("url").alias("_from"), F.col("loc").alias("_to"))
        .distinct()
    )
    frontier = materialise(
        locations.filter(F.col("kind") == "robots").select("url").distinct().withColumn("depth", F.lit(0))
    )
    rounds = [frontier]
    depth = 0
    while frontier.take(1):
        depth += 1
        reached = rounds[0]
        for earlier in rounds[1:]:
            reached = reached.unionByName(earlier)
        following = frontier.join(edges, frontier["url"] == edges["_from"]).select(F.col("_to").alias("url")).distinct()
        frontier = materialise(following.join(reached, "url", "left_anti").withColumn("depth", F.lit(depth)))
        rounds.append(frontier)
    result = rounds[0]
    for later in rounds[1:]:
        result = result.unionByName(later)
    return result


def first_rule(url: Column, rules: Sequence[tuple[str, str]] = PAGE_RULES) -> Column:
    """Page type of the first rule whose pattern occurs in the URL, else null."""
    result = F.lit(None).cast("string")
    for pattern, page_type in reversed(rules):
        result = F.when(url.rlike(pattern), page_type).otherwise(result)
    return result


def routed_pages(
    locations: DataFrame, rules: Sequence[tuple[str, str]] = PAGE_RULES
) -> DataFrame:
    """Pages that a rule wants, with the page type it gives them."""
    return (
        locations.filter(F.col("kind") == "urlset")
        .select("url", "loc", first_rule(F.col("loc"), rules).alias("page_type"))
        .filter(F.col("page_type").isNotNull())
    )
