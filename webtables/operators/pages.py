"""Records about single pages. Nothing here shuffles page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webtables.functions import ecommerce, html as H, urls
from webtables.functions.text import nfkd
from webtables.operators.frontier import PAGE_RULES, first_rule

CACHED = "*cached copy*"
_TAG_NEEDLES = (
    *ecommerce.CART_NEEDLES,
    *H.SOCIAL_NETWORKS,
    "payment",
    "author",
    "description",
)


def page_tags(pages: DataFrame) -> DataFrame:
    """One row per attribute: page_id, pos, tag, attr, value."""
    tags = pages.select("page_id", F.explode(H.tag_array(F.col("html"))).alias("t"))
    return tags.select(
        "page_id", "t.pos", "t.tag", F.explode(H.attribute_rows(F.col("t"))).alias("a")
    ).select("page_id", "pos", "tag", F.col("a.name").alias("attr"), F.col("a.value"))


def with_tags(pages: DataFrame, needles: tuple[str, ...] = _TAG_NEEDLES) -> DataFrame:
    """Add the page with its raw text blanked, and the tags of pages that may
    hold one of the texts."""
    html = F.col("html")
    blanked = pages.withColumn("blanked", H.blank_raw_text(html))
    return blanked.withColumn("tags", H.tags_if(H.may_hold(html, needles), F.col("blanked")))


def page_type(url: Column) -> Column:
    """``homepage`` for a site's root, else what the page rules say."""
    return F.when(urls.level(url) == 1, "homepage").otherwise(first_rule(url, PAGE_RULES))


def page_texts(pages: DataFrame, normalise: bool = False) -> DataFrame:
    """url and readable text of every page."""
    text = H.page_text(F.col("html"))
    return pages.select("page_id", "url", (nfkd(text) if normalise else text).alias("text"))


def generic_records(pages: DataFrame, fetch_log: DataFrame | None = None) -> DataFrame:
    """The columns that every kind of page gets."""
    extracted = with_tags(pages, H.SOCIAL_NETWORKS).select(
        "page_id", *_generic_columns(), *_optional(pages, "page_type")
    )
    return _with_fetch(extracted, fetch_log).select(
        "page_id",
        "url",
        "level",
        "referer",
        "website",
        "status_code",
        "phone_numbers",
        "social_links",
    )


def page_records(pages: DataFrame, fetch_log: DataFrame | None = None) -> DataFrame:
    """Records of all pages in one layout, homepage columns null elsewhere.

    ``pages`` may bring its own ``page_type`` and ``capture_url`` columns. The
    page text is read in one pass and dropped before the log is joined.
    """
    kind = F.col("page_type") if "page_type" in pages.columns else page_type(F.col("url"))
    is_home = F.col("page_type") == "homepage"
    body, tags = F.col("html"), F.col("tags")
    homepage = {
        "title": H.title_of(F.col("blanked")),
        "description": H.meta_content(tags, "description"),
        "author": H.meta_content(tags, "author"),
        "copyright": H.copyright_lines(body),
        "cart_software": ecommerce.cart_software(tags, body),
        "has_card": ecommerce.has_card(tags, body),
        "payment_systems": ecommerce.payment_systems(body),
    }
    capture = F.col("capture_url") if "capture_url" in pages.columns else F.lit(None).cast("string")
    extracted = (
        with_tags(pages)
        .withColumn("page_type", kind)
        .select(
            "page_id",
            "page_type",
            *_generic_columns(),
            *[F.when(is_home, value).alias(name) for name, value in homepage.items()],
            capture.alias("wayback_url"),
            urls.capture_time(capture).alias("wayback_dt"),
        )
    )
    text = F.lit(None).cast("string")
    return _with_fetch(extracted, fetch_log).select(
        "page_id",
        "url",
        "level",
        "referer",
        "website",
        "status_code",
        "page_type",
        text.alias("html"),
        text.alias("text"),
        "phone_numbers",
        "social_links",
        *homepage,
        *[
            F.when(is_home, F.col(name)).alias(name)
            for name in ("ip_address", "ssl_certificate", "protocol", "as_number", "reverse_dns_lookup")
        ],
        "wayback_url",
        "wayback_dt",
        text.alias("test"),
    )


def hosting(fetch_log: DataFrame) -> DataFrame:
    """Hosting columns of the fetch log, masked where the copy was cached.

    The address itself stays visible.
    """

    def masked(value: Column) -> Column:
        return F.when(F.col("cached"), CACHED).otherwise(value.cast("string"))

    return fetch_log.select(
        "page_id",
        F.col("status").alias("status_code"),
        "referer",
        "ip_address",
        masked(F.coalesce("ssl_certificate", F.lit(False))).alias("ssl_certificate"),
        masked(F.col("protocol")).alias("protocol"),
        F.lit(None).cast("string").alias("as_number"),
        masked(F.coalesce("reverse_dns", F.lit("Unknown"))).alias("reverse_dns_lookup"),
    )


def _generic_columns() -> list[Column]:
    url = F.col("url")
    return [
        url,
        urls.level(url).alias("level"),
        urls.domain(url).alias("website"),
        F.when(H.may_hold(F.col("html"), ["tel:"]), H.phones_of(F.col("blanked")))
        .otherwise(F.array().cast("array<string>"))
        .alias("phone_numbers"),
        H.social_links(F.col("tags")).alias("social_links"),
    ]


def _optional(pages: DataFrame, *names: str) -> list[str]:
    return [name for name in names if name in pages.columns]


def _with_fetch(extracted: DataFrame, fetch_log: DataFrame | None) -> DataFrame:
    if fetch_log is not None:
        return extracted.join(hosting(fetch_log.filter("page_id is not null")), "page_id", "left")
    empty = dict.fromkeys(
        ("referer", "ip_address", "ssl_certificate", "protocol", "as_number", "reverse_dns_lookup"),
        F.lit(None).cast("string"),
    )
    return extracted.withColumns({**empty, "status_code": F.lit(None).cast("int")})
