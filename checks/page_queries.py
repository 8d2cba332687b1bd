"""Queries over captured pages: URLs, frontier, HTML, shops, roll-up."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import inputs
from checks.html_sql import decode, html_ctes
from checks.inputs import FIRST_STAMP, LAST_STAMP, NETLOC
from checks.registry import query
from webtables.functions import ecommerce, html as H, urls
from webtables.operators import frontier, pages as P, rollup

SHOP = html_ctes("shop")
_STAMP = (
    "try_cast(regexp_extract(capture_url, '^https://web[.]archive[.]org/web/([0-9]{14})id_/', 1) AS BIGINT)"
)
_DOMAIN = f"replace({NETLOC.format('url')}, 'www.', '')"
_PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_LEVEL = f"len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) + 1"


def joined(column: str | Column, mark: str = "|") -> Column:
    return F.array_join(column, mark, "<null>")


def sql_joined(column: str, mark: str = "|") -> str:
    return f"array_to_string(list_transform({column}, lambda x: coalesce(x, '<null>')), '{mark}')"


# ------------------------------------------------------------------ URLs


@query("captured_pages", "SELECT page_id, url, md5(html) AS html_md5, length(html) AS n_chars FROM pages")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.pages(spark, sf).select(
        "page_id", "url", F.md5("html").alias("html_md5"), F.length("html").alias("n_chars")
    )


@query("url_netloc", f"SELECT page_id, {NETLOC.format('url')} AS netloc FROM shop")
def _(spark, sf):
    return inputs.shop_pages(spark, sf).select("page_id", urls.netloc(F.col("url")).alias("netloc"))


@query("url_domain", f"SELECT page_id, {_DOMAIN} AS domain FROM shop")
def _(spark, sf):
    return inputs.shop_pages(spark, sf).select("page_id", urls.domain(F.col("url")).alias("domain"))


@query("url_level", f"SELECT page_id, {_LEVEL} AS level FROM shop")
def _(spark, sf):
    return inputs.shop_pages(spark, sf).select("page_id", urls.level(F.col("url")).alias("level"))


@query(
    "url_short_name",
    f"""SELECT page_id, CASE WHEN mark IS NULL THEN host WHEN mark = 1 THEN parts[-1] ELSE parts[mark - 1] END AS name
    FROM (SELECT *, coalesce(list_position(parts, 'co'), list_position(parts, 'com'),
                             list_position(parts, 'org'), list_position(parts, 'nz')) AS mark
          FROM (SELECT page_id, host, string_split(host, '.') AS parts
                FROM (SELECT page_id, {NETLOC.format("url")} AS host FROM shop)))""",
)
def _(spark, sf):
    return inputs.shop_pages(spark, sf).select("page_id", urls.short_name(F.col("url")).alias("name"))


@query("capture_times", f"SELECT page_id, {_STAMP} AS wayback_dt FROM shop")
def _(spark, sf):
    return inputs.shop_pages(spark, sf).select(
        "page_id", urls.capture_time(F.col("capture_url")).alias("wayback_dt")
    )


@query(
    "captures_in_range",
    f"SELECT page_id, capture_url FROM shop WHERE {_STAMP} BETWEEN {FIRST_STAMP} AND {LAST_STAMP}",
)
def _(spark, sf):
    wanted = urls.captured_between(F.col("capture_url"), FIRST_STAMP, LAST_STAMP)
    return inputs.shop_pages(spark, sf).filter(wanted).select("page_id", "capture_url")


# -------------------------------------------------------------- frontier


@query(
    "seed_slice",
    "SELECT txt_line_num, netloc, 'https://' || netloc AS homepage FROM seeds WHERE txt_line_num >= 4",
)
def _(spark, sf):
    return frontier.seed_slice(inputs.seeds(spark, sf), 4)


@query(
    "bounded_seed_slice",
    """SELECT txt_line_num, netloc, 'https://' || netloc AS homepage FROM seeds
    WHERE txt_line_num >= 4 AND txt_line_num < (SELECT max(txt_line_num) FROM seeds) // 2""",
)
def _(spark, sf):
    seeds = inputs.seeds(spark, sf)
    half = seeds.agg(F.floor(F.max("txt_line_num") / 2).alias("half")).first()["half"]
    return frontier.seed_slice(seeds, 4, half)


@query(
    "start_requests",
    """SELECT txt_line_num, 'https://' || netloc AS homepage, kind, 'https://' || netloc || coalesce(suffix, '') AS url, suffix
    FROM seeds, (VALUES ('homepage', NULL), ('sitemap', '/robots.txt')) AS v(kind, suffix)
    WHERE txt_line_num >= 4""",
)
def _(spark, sf):
    return frontier.start_requests(frontier.seed_slice(inputs.seeds(spark, sf), 4))


@query(
    "fallback_requests",
    """SELECT homepage, next AS suffix, homepage || next AS url
    FROM fetch_log JOIN (VALUES ('/robots.txt', '/sitemap.xml')) AS v(tried, next) ON suffix = tried
    WHERE status = 404 AND kind = 'sitemap'""",
)
def _(spark, sf):
    return frontier.fallback_requests(inputs.fetch_log(spark, sf))


_LOCATIONS = {
    "locations": f"""
        SELECT url, kind, {decode("raw", loose=False)} AS loc FROM (
            SELECT url, kind, unnest(CASE kind
                WHEN 'robots' THEN regexp_extract_all(body, '(?im)^[ \\t\\f]*sitemap:[ \\t\\f]*([^\\r\\n]*?)[ \\t\\f]*\\r?$', 1)
                ELSE list_transform(regexp_extract_all(body, '(?is)<loc(?:[ \\t\\n\\f\\r][^>]*)?>[ \\t\\n\\f\\r]*(.*?)[ \\t\\n\\f\\r]*</loc>', 1),
                    lambda l: regexp_replace(l, '(?s)^<!\\[CDATA\\[[ \\t\\n\\f\\r]*(.*?)[ \\t\\n\\f\\r]*\\]\\]>$', '\\1')) END) AS raw
            FROM (SELECT url, body, CASE WHEN ends_with(url, '/robots.txt') THEN 'robots'
                         WHEN contains(body, '<sitemapindex') THEN 'sitemapindex'
                         WHEN contains(body, '<urlset') THEN 'urlset' END AS kind FROM sitemaps)
            WHERE kind IS NOT NULL)"""
}


@query("sitemap_locations", "SELECT url, kind, loc FROM locations", _LOCATIONS)
def _(spark, sf):
    return frontier.sitemap_locations(inputs.sitemaps(spark, sf))


@query(
    "followed_sitemaps",
    """SELECT url, kind, loc FROM locations
    WHERE kind = 'robots' OR (kind = 'sitemapindex' AND regexp_matches(loc, '[.]nz/'))""",
    _LOCATIONS,
)
def _(spark, sf):
    return frontier.followed_sitemaps(frontier.sitemap_locations(inputs.sitemaps(spark, sf)))


@query(
    "routed_pages",
    """SELECT url, loc, 'about_us' AS page_type FROM locations
    WHERE kind = 'urlset' AND (regexp_matches(loc, '/about-?us') OR contains(loc, 'contact'))""",
    _LOCATIONS,
)
def _(spark, sf):
    return frontier.routed_pages(frontier.sitemap_locations(inputs.sitemaps(spark, sf)))


# ------------------------------------------------------------------ HTML

_ATTRIBUTE_ROWS = """
    SELECT page_id, pos, tag, attr,
           unnest(CASE WHEN attr IN ('class', 'rel') AND len(parts) > 0 THEN parts ELSE [value] END) AS value
    FROM (SELECT *, list_filter(string_split_regex(value, '[ \\t\\n\\f\\r]+'), lambda x: x <> '') AS parts
          FROM attributes)"""


@query("page_tags", _ATTRIBUTE_ROWS, SHOP)
def _(spark, sf):
    return P.page_tags(inputs.shop_pages(spark, sf))


@query("page_titles", "SELECT page_id, title FROM titles", SHOP)
def _(spark, sf):
    return inputs.shop_pages(spark, sf).select("page_id", H.title(F.col("html")).alias("title"))


def _meta(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tagged = P.with_tags(inputs.shop_pages(spark, sf), (name,))
    return tagged.select("page_id", H.meta_content(F.col("tags"), name).alias(name))


@query("page_authors", "SELECT page_id, author FROM pages LEFT JOIN metas USING (page_id)", SHOP)
def _(spark, sf):
    return _meta(spark, sf, "author")


@query("page_descriptions", "SELECT page_id, description FROM pages LEFT JOIN metas USING (page_id)", SHOP)
def _(spark, sf):
    return _meta(spark, sf, "description")


@query("copyright_lines", f"SELECT page_id, {sql_joined('lines')} AS copyright FROM footers", SHOP)
def _(spark, sf):
    return inputs.shop_pages(spark, sf).select(
        "page_id", joined(H.copyright_lines(F.col("html"))).alias("copyright")
    )


@query(
    "phone_numbers",
    f"""SELECT page_id, coalesce({sql_joined("phone_numbers")}, '') AS phone_numbers
    FROM pages LEFT JOIN phones USING (page_id)""",
    SHOP,
)
def _(spark, sf):
    return inputs.shop_pages(spark, sf).select(
        "page_id", joined(H.phone_numbers(F.col("html"))).alias("phone_numbers")
    )


@query(
    "social_links",
    f"""SELECT page_id, coalesce({sql_joined("social_links")}, '') AS social_links
    FROM pages LEFT JOIN socials USING (page_id)""",
    SHOP,
)
def _(spark, sf):
    tagged = P.with_tags(inputs.shop_pages(spark, sf), H.SOCIAL_NETWORKS)
    return tagged.select("page_id", joined(H.social_links(F.col("tags"))).alias("social_links"))


@query("page_texts", "SELECT page_id, md5(text) AS text_md5, length(text) AS n_chars FROM texts", SHOP)
def _(spark, sf):
    return P.page_texts(inputs.shop_pages(spark, sf)).select(
        "page_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars")
    )


# Spark has no normal forms and DuckDB only NFC, so the query takes apart what
# the given texts hold of composed characters, and the SQL puts it together again.
@query(
    "normalised_page_texts",
    "SELECT page_id, md5(nfc_normalize(replace(text, chr(160), ' '))) AS text_md5, length(text) AS n_composed FROM texts",
    SHOP,
)
def _(spark, sf):
    apart = P.page_texts(inputs.shop_pages(spark, sf), normalise=True)
    together = F.col("text")
    for mark in ("\u0300", "\u0301", "\u0302", "\u0303", "\u0308", "\u0327"):
        for letter in "aeiouncAEIOUNC":
            whole = unicodedata.normalize("NFC", letter + mark)
            if len(whole) == 1:
                together = F.replace(together, F.lit(letter + mark), F.lit(whole))
    return apart.select("page_id", F.md5(together).alias("text_md5"), F.length(together).alias("n_composed"))


_RECORDS = {
    **SHOP,
    "hosted": """
        SELECT page_id, status AS status_code, referer, ip_address,
               CASE WHEN cached THEN '*cached copy*' ELSE coalesce(ssl_certificate, false)::VARCHAR END AS ssl_certificate,
               CASE WHEN cached THEN '*cached copy*' ELSE protocol END AS protocol,
               CASE WHEN cached THEN '*cached copy*' ELSE coalesce(reverse_dns, 'Unknown') END AS reverse_dns_lookup
        FROM fetch_log""",
    "records": f"""
        SELECT page_id, shop.url, {_LEVEL.replace("url", "shop.url")} AS level, referer, {_DOMAIN.replace("url", "shop.url")} AS website,
               status_code, page_type, coalesce(phone_numbers, []) AS phone_numbers, coalesce(social_links, []) AS social_links,
               CASE WHEN home THEN title END AS title, CASE WHEN home THEN description END AS description,
               CASE WHEN home THEN author END AS author, CASE WHEN home THEN lines END AS copyright,
               CASE WHEN home THEN cart_software END AS cart_software, CASE WHEN home THEN has_card END AS has_card,
               CASE WHEN home THEN payment_systems END AS payment_systems,
               CASE WHEN home THEN ip_address END AS ip_address, CASE WHEN home THEN ssl_certificate END AS ssl_certificate,
               CASE WHEN home THEN protocol END AS protocol, CASE WHEN home THEN reverse_dns_lookup END AS reverse_dns_lookup,
               capture_url AS wayback_url, {_STAMP} AS wayback_dt
        FROM (SELECT *, coalesce(page_type = 'homepage', false) AS home FROM shop) AS shop
        LEFT JOIN hosted USING (page_id) LEFT JOIN phones USING (page_id) LEFT JOIN socials USING (page_id)
        LEFT JOIN titles USING (page_id) LEFT JOIN metas USING (page_id) LEFT JOIN footers USING (page_id)
        LEFT JOIN (SELECT page_id, cart_software, has_card, payment_systems FROM carts) USING (page_id)""",
}
_LISTS = ("phone_numbers", "social_links", "copyright", "cart_software", "payment_systems")


def _flat(records: DataFrame) -> DataFrame:
    empty = [c for c in ("html", "text", "test", "as_number") if c in records.columns]
    lists = [c for c in _LISTS if c in records.columns]
    return records.drop(*empty).withColumns({c: joined(c) for c in lists})


@query(
    "generic_records",
    f"""SELECT page_id, url, level, referer, website, status_code,
        {sql_joined("phone_numbers")} AS phone_numbers, {sql_joined("social_links")} AS social_links FROM records""",
    _RECORDS,
)
def _(spark, sf):
    return _flat(P.generic_records(inputs.shop_pages(spark, sf), inputs.fetch_log(spark, sf)))


_RECORD_LISTS = ", ".join(f"{sql_joined(c)} AS {c}" for c in _LISTS)


@query(
    "page_records",
    f"SELECT * REPLACE ({_RECORD_LISTS}) FROM (SELECT * EXCLUDE (wayback_url, wayback_dt) FROM records)",
    _RECORDS,
)
def _(spark, sf):
    shop = inputs.shop_pages(spark, sf).drop("capture_url")
    records = P.page_records(shop, inputs.fetch_log(spark, sf))
    return _flat(records).drop("wayback_url", "wayback_dt")


@query("wayback_records", f"SELECT * REPLACE ({_RECORD_LISTS}) FROM records", _RECORDS)
def _(spark, sf):
    return _flat(P.page_records(inputs.shop_pages(spark, sf), inputs.fetch_log(spark, sf)))


@query("hosting_columns", "SELECT * FROM hosted", _RECORDS)
def _(spark, sf):
    return P.hosting(inputs.fetch_log(spark, sf)).drop("as_number")


# ----------------------------------------------------------------- shops

_DETECTORS = {
    "demandware": "Demandware",
    "magento": "Magento",
    "nosto": "nosto",
    "shopify": "Shopify",
    "sitecore": "Sitecore Experience Commerce",
    "squarespace": "Squarespace",
    "wix": "Wix Stores",
    "woocommerce": "WooCommerce",
}


def _detector(name: str, software: str) -> None:
    @query(f"detect_{name}", f"SELECT page_id, {name} AS found FROM flags", SHOP)
    def _(spark, sf):
        tagged = P.with_tags(inputs.shop_pages(spark, sf), ecommerce.CART_NEEDLES)
        found = ecommerce.cart_flags(F.col("tags"), F.col("html"))[software]
        return tagged.select("page_id", found.alias("found"))


for _name, _software in _DETECTORS.items():
    _detector(_name, _software)


@query("cart_software", f"SELECT page_id, {sql_joined('cart_software')} AS cart_software FROM carts", SHOP)
def _(spark, sf):
    tagged = P.with_tags(inputs.shop_pages(spark, sf), ecommerce.CART_NEEDLES)
    found = ecommerce.cart_software(F.col("tags"), F.col("html"))
    return tagged.select("page_id", joined(found).alias("cart_software"))


@query("has_card", "SELECT page_id, has_card FROM carts", SHOP)
def _(spark, sf):
    tagged = P.with_tags(inputs.shop_pages(spark, sf), ("payment",))
    found = ecommerce.has_card(F.col("tags"), F.col("html"))
    return tagged.select("page_id", found.alias("has_card"))


@query("payment_systems", f"SELECT page_id, {sql_joined('payment_systems')} AS payment_systems FROM carts", SHOP)
def _(spark, sf):
    found = ecommerce.payment_systems(F.col("html"))
    return inputs.shop_pages(spark, sf).select("page_id", joined(found).alias("payment_systems"))


@query(
    "alternative_rules",
    """SELECT page_id, shopify, wix, woocommerce, woocommerce_script, woocommerce_link, wix_script, wix_text,
        len(list_filter(bodies, lambda b: contains(b, 'var Shopify ='))) > 0 AS shopify_script
    FROM flags JOIN scripts USING (page_id)""",
    SHOP,
)
def _(spark, sf):
    needles = (*ecommerce.CART_NEEDLES, "woocommerce", "static.parastorage.com")
    tagged = P.with_tags(inputs.shop_pages(spark, sf), needles)
    tags, html = F.col("tags"), F.col("html")
    rules = ecommerce.cart_flags(tags, html)
    return tagged.select(
        "page_id",
        rules["Shopify"].alias("shopify"),
        rules["Wix Stores"].alias("wix"),
        rules["WooCommerce"].alias("woocommerce"),
        *[flag.alias(name) for name, flag in ecommerce.alternative_flags(tags, html).items()],
    )


@query(
    "cart_hints",
    f"""SELECT page_id,
        coalesce(array_to_string(list(title ORDER BY pos) FILTER (tag = 'a' AND contains(lower(title), 'cart')), '|'), '') AS cart_titles,
        coalesce(array_to_string(flatten(list(list_filter(string_split_regex(class, '[ \\t\\n\\f\\r]+'), lambda c: contains(c, 'cart')) ORDER BY pos) FILTER (tag = 'div' AND class IS NOT NULL)), '|'), '') AS cart_classes,
        coalesce(array_to_string(list(id ORDER BY pos) FILTER (tag = 'div' AND id IS NOT NULL), '|'), '') AS div_ids
    FROM pages LEFT JOIN tags USING (page_id) GROUP BY page_id""",
    SHOP,
)
def _(spark, sf):
    tagged = P.with_tags(inputs.shop_pages(spark, sf), ("<",))
    hints = ecommerce.cart_hints(F.col("tags"))
    return tagged.select("page_id", *[joined(h).alias(name) for name, h in hints.items()])


@query(
    "card_evidence_counts",
    """SELECT count(*) FILTER (add_to_cart) AS add_to_cart, count(*) FILTER (payment_link) AS payment_link,
        count(*) FILTER (payment_item) AS payment_item FROM flags WHERE page_id NOT IN (
            SELECT page_id FROM pages WHERE url IN (SELECT url FROM errors))""",
    SHOP,
)
def _(spark, sf):
    from webtables.operators.evaluate import evidence_counts

    # Under the URLs they were given, which the errors name.
    shown = F.concat("html", inputs.pick(inputs.PIECES)).alias("html")
    pages = inputs.pages(spark, sf).select("page_id", "url", shown)
    return evidence_counts(pages, inputs.errors(spark, sf))


# --------------------------------------------------------------- roll-up

_FIELDS = [f for f in rollup.FIELDS if f not in ("html", "text", "test", "as_number")]


def _as_value(field: str) -> str:
    if field in _LISTS:
        return f"CASE WHEN len({field}) > 0 THEN to_json({field})::VARCHAR END"
    return f"{field}::VARCHAR"


_ROLLUP = {
    **_RECORDS,
    "site_vals": f"""
        SELECT website, field, value, min(page_id) AS first_ord
        FROM (SELECT website, page_id, unnest([{", ".join(f"'{f}'" for f in _FIELDS)}]) AS field,
                     unnest([{", ".join(_as_value(f) for f in _FIELDS)}]) AS value FROM records)
        WHERE value <> '' AND website <> '' GROUP BY website, field, value""",
    "site_parts": """
        SELECT *, ((row_number() OVER (PARTITION BY website ORDER BY first_ord, field, value) - 1) // 50)::INT AS part
        FROM site_vals""",
    "site_rows": "SELECT website, part, "
    + ", ".join(
        f"coalesce(array_to_string(list(value ORDER BY first_ord) FILTER (field = '{f}'), ' ; '), '') AS {f}"
        for f in _FIELDS
    )
    + " FROM site_parts GROUP BY website, part",
}


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_records(inputs.shop_pages(spark, sf), inputs.fetch_log(spark, sf))


def _shown(column: str, kind: str) -> Column:
    """A typed array as one text, lists in it as JSON."""
    nested = kind.startswith("array<array")
    return F.array_join(
        F.transform(column, lambda v: F.to_json(v) if nested else v.cast("string")), " ; "
    )


def _lists_joined(sites: DataFrame) -> DataFrame:
    kinds = dict(sites.dtypes)
    return sites.withColumns({f: _shown(f, kinds[f]) for f in _FIELDS})


@query("site_values", "SELECT website, field, value, first_ord FROM site_vals", _ROLLUP)
def _(spark, sf):
    return rollup.site_values(_records(spark, sf), _FIELDS)


@query("site_table", "SELECT * FROM site_rows", _ROLLUP)
def _(spark, sf):
    return _lists_joined(rollup.site_table(_records(spark, sf), _FIELDS, limit=50))


_ALIGNED = "seeds LEFT JOIN site_rows ON replace(netloc, 'www.', '') = website"


@query(
    "sites_by_seed",
    f"SELECT txt_line_num, netloc AS website, part, {', '.join(_FIELDS)} FROM {_ALIGNED}",
    _ROLLUP,
)
def _(spark, sf):
    sites = rollup.site_table(_records(spark, sf), _FIELDS, limit=50)
    return _lists_joined(rollup.align_to_seeds(sites, inputs.seeds(spark, sf)))


@query(
    "sites_by_seed_strict",
    """SELECT txt_line_num, netloc AS website, part, coalesce(url, '') AS url FROM seeds LEFT JOIN (
        SELECT website, part, string_agg(value, ' ; ' ORDER BY first_ord) AS url FROM (
            SELECT *, ((row_number() OVER (PARTITION BY website ORDER BY first_ord, value) - 1) // 50)::INT AS part
            FROM site_vals WHERE field = 'url') GROUP BY website, part) ON netloc = website""",
    _ROLLUP,
)
def _(spark, sf):
    sites = rollup.site_table(_records(spark, sf), ["url"], limit=50)
    aligned = rollup.align_to_seeds(sites, inputs.seeds(spark, sf), strict=True)
    url = F.coalesce(F.array_join("url", " ; "), F.lit(""))
    return aligned.select("txt_line_num", "website", "part", url.alias("url"))


@query(
    "grouped_sites",
    f"SELECT txt_line_num, part, netloc AS website, {', '.join(_FIELDS)} FROM {_ALIGNED}",
    _ROLLUP,
)
def _(spark, sf):
    from webtables.plans.jobs import website_table

    grouped = website_table(
        inputs.shop_pages(spark, sf), inputs.seeds(spark, sf), inputs.fetch_log(spark, sf), limit=50
    )
    place = {f: group for group, fields in rollup.FIELD_GROUPS.items() for f in fields}
    flat = grouped.select(
        "txt_line_num",
        "part",
        "General.website",
        *[F.col(f"{place[f]}.{f}").alias(f) for f in _FIELDS],
    )
    return _lists_joined(flat)


# Sitemap indexes nested four deep, with a cycle, followed to the end; SQL walks the
# same bodies by a recursive CTE whose paths exclude revisits.
_NESTED_H = "'https://' || " + inputs.NETLOC.format("url") + " || '.nz'"


@query(
    "sitemap_closure",
    f"""
    WITH RECURSIVE hs AS (SELECT DISTINCT {_NESTED_H} AS h FROM pages WHERE {inputs.NETLOC.format("url")} <> ''),
    bodies AS (
        SELECT h || '/robots.txt' AS url, 'Sitemap: ' || h || '/n0.xml' || chr(10) AS body FROM hs
        UNION ALL SELECT h || '/n0.xml', '<sitemapindex><sitemap><loc>' || h || '/n1.xml</loc></sitemap><sitemap><loc>' || h || '/gone.xml</loc></sitemap></sitemapindex>' FROM hs
        UNION ALL SELECT h || '/n1.xml', '<sitemapindex><sitemap><loc>' || h || '/n2.xml</loc></sitemap></sitemapindex>' FROM hs
        UNION ALL SELECT h || '/n2.xml', '<sitemapindex><sitemap><loc>' || h || '/n3.xml</loc></sitemap><sitemap><loc>' || h || '/n0.xml</loc></sitemap></sitemapindex>' FROM hs
        UNION ALL SELECT h || '/n3.xml', '<sitemapindex><sitemap><loc>' || h || '/n4.xml</loc></sitemap></sitemapindex>' FROM hs
        UNION ALL SELECT h || '/n4.xml', '<urlset>' || string_agg('<url><loc>' || url || '</loc></url>', '' ORDER BY url) || '</urlset>'
            FROM (SELECT {_NESTED_H} AS h, url FROM pages) GROUP BY h),
    edges AS (
        SELECT DISTINCT url AS f, t FROM (
            SELECT url, unnest(CASE WHEN ends_with(url, '/robots.txt')
                THEN regexp_extract_all(body, '(?im)^[ \t\f]*sitemap:[ \t\f]*([^\r\n]*?)[ \t\f]*\r?$', 1)
                WHEN contains(body, '<sitemapindex') THEN list_filter(regexp_extract_all(body, '<loc>(.*?)</loc>', 1), lambda l: regexp_matches(l, '[.]nz/'))
                ELSE [] END) AS t FROM bodies) WHERE t <> ''),
    walk(url, depth, path) AS (
        SELECT DISTINCT url, 0, [url] FROM bodies WHERE ends_with(url, '/robots.txt')
        UNION ALL
        SELECT e.t, w.depth + 1, list_append(w.path, e.t) FROM walk w JOIN edges e ON e.f = w.url
        WHERE NOT list_contains(w.path, e.t))
    SELECT url, min(depth) AS depth FROM walk GROUP BY url""",
)
def _(spark, sf):
    return frontier.sitemap_closure(inputs.nested_sitemaps(spark, sf))

