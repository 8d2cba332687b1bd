"""Inputs that Spark derives from the given tables, and the same in SQL.

The given pages show no shop, phone or social marks, and no crawl log comes
with them. So every page gets one of the pieces of HTML and one of the URL
forms below, by its number, and the logs, seeds and labels follow from the
pages. All of them grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webtables.functions import urls
from webtables.sources.tables import read_pages

# The marker strings in these pieces are what the detectors look for.
PIECES = [
    """<img src="https://x.demandware.net/a.png">""",
    """<!-- <img src="demandware"> --><p>x</p>""",
    """<script>var t = "<img src='demandware'>";</script>""",
    """<script type="text/x-magento-init">{"a": "<div class='minicart'>"}</script>""",
    """<span class='x nosto_cart'></span>""",
    """<span class='nosto_cart2'></span>""",
    """<LINK REL='stylesheet preload' HREF='//cdn.shopify.com/a.css'>""",
    """<link rel=icon href=//cdn.shopify.com/i.png><script>var Shopify = {};</script>""",
    """<div class="a sitecore-link-wrapper"></div>""",
    """<div class="sitecore-link-wrapper-2"></div>""",
    """<script>var k = "SITECORE_APIKEY";</script>""",
    """<link rel=preconnect href=https://images.squarespace-cdn.com>""",
    """<link rel=preconnect href=https://images.squarespace-cdn.com/>""",
    """<meta name="generator" content="Wix.com Website Builder">""",
    """<script src="https://static.parastorage.com/a.js"></script><p>WIX.com</p>""",
    """<style id='woocommerce-inline-inline-css' type='text/css'>p{}</style>""",
    """<style id='woocommerce-inline-inline-css'></style>""",
    """<style type="text/css" id="woocommerce-inline-inline-css"></style>"""
    """<span class=nosto_cart></span><img src=//a.demandware.net/1.gif />""",
    """<p>AddToCart</p>""",
    """<a href="/payment/x">p</a>""",
    """<a href="/Payment">p</a>""",
    """<ul><li class='x my-payment'>v</li></ul>""",
    """<p>VISA and Klarna</p>""",
    """<p>apple pay</p>""",
    """<a href='tel:+64 4'>a</a><a href="tel:+64 4">b</a><a href='tel:'> 09 123</a>""",
    """<a href="tel:"><span><i><b><u>x</u></b></i><br></span>09 123<i>y</i></a><a href='tel&colon;5'>z</a>""",
    """<footer>a (c) copyright 1<footer>copyright in</footer><p>copyright 2 &copy2021</p>\n&copyA&#00000169; B&#150;"""
    """&notit; &CounterClockwiseContourIntegral;&bne;&#x110000;</footer></footer>copyright no""",
    """<a href='tel:'></a><a href="tel:"><i class="icon"></i>09&nbsp;55<b>x</b></a>""",
    """<a href='https://facebook.com/a>b'>f</a><a href='https://FACEBOOK.com'>g</a>""",
    """<a href="https://youtube.com/?a=1&amp;b=2">y</a><A HREF=https://linkedin.com/x>l</A>""",
    """<a title='Your Cart' href='/c'>c</a><div class='minicart top' id='x'></div>""",
    """<meta name=author content='A &quot;B&quot; &#67;'><meta name="description" content="one">"""
    """<meta name="description" content="two">""",
    """<footer>\n\t<p>Copy<b>Right</b> 2020 </p>\tnothing\n\r&copy;&#160; us <!-- © no -->"""
    """<script>w("(c) copyright")</script></footer>""",
    """<img src="&#100;emandware.png">""",
    """<div class hidden class="" id=a id=b></div><a name=x>no link</a>""",
    """<script src="/woocommerce/a.js"></script>"""
    """<link rel="stylesheet" id="woocommerce-css" href="/w.css">""",
    """<script src="a.js"/><img src="demandware.gif">""",
    """<my-cart data-x="1"></my-cart><div class="cart-page cart-top"></div>""",
    """<title>&lt;second&gt;</title><!-- never closed <img src="demandware">""",
]

# SQL that Spark and DuckDB both read; by page_id % number of forms.
URL_FORMS = [
    "url",
    "replace(url, '://', '://www.')",
    "replace(url, '://', '://www.shop.www.')",
    "replace(url, '.example.', '.co.')",
    "replace(url, '://', '://me:pw@')",
    "replace(url, '.com/', '.com:8080/')",
    "concat(url, '/')",
    "split_part(url, '://', 2)",
    "concat(split_part(url, '/', 1), '//', split_part(url, '/', 3))",
    "concat(split_part(split_part(url, '#', 1), '?', 1), '/about-us')",
    "concat(split_part(url, '/', 1), '//', split_part(url, '/', 3), '/contact/x')",
    "concat(split_part(url, '#', 1), '?a=/b/c#/d/e')",
    "concat('https://co.', split_part(url, '/', 3), '/')",
]

STATUSES = [200, 404, 404, 403, None, 200, 404]
# Suffixes and stamps of the crawl.
SUFFIXES = [None, "/robots.txt", "/sitemap.xml"]
STAMPS = [
    "20200101120000",
    "20200301120000",
    "20200301120001",
    "20191231235959",
    "20200215083000",
    "2020",
    "x0200215083000",
]
FIRST_STAMP, LAST_STAMP = 20200101120000, 20200301120000
LABELS = [
    "Demandware",
    "?",
    "Magento",
    "nosto",
    "custom",
    "Shopify",
    "Wix Stores",
    "WooCommerce|nosto|Demandware",
    "Demandware|WooCommerce",
    "Squarespace|Magento",
    "Sitecore Experience Commerce",
]
STOP_WORDS = ["the", "and", "of", "to", "de", "que", "la", "der", "die", "und", "el", "en"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(choices: list, kind: str = "string") -> Column:
    """The choice that falls to the page's number."""
    options = F.array(*[F.lit(c).cast(kind) for c in choices])
    return F.element_at(options, (F.col("page_id") % len(choices) + 1).cast("int"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def _url_form() -> str:
    cases = [f"when {i} then {form}" for i, form in enumerate(URL_FORMS)]
    return f"case page_id % {len(URL_FORMS)} {' '.join(cases)} end"


def shop_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All pages, each with a piece of HTML and a URL form, and a page type."""
    return pages(spark, sf).select(
        "page_id",
        F.expr(_url_form()).alias("url"),
        F.concat("html", pick(PIECES)).alias("html"),
        pick(["homepage", "homepage", "about_us", None]).alias("page_type"),
        F.concat(
            F.lit("https://web.archive.org/web/"), pick(STAMPS), F.lit("id_/"), "url"
        ).alias("capture_url"),
    )


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """One line per captured host, and one per host that was never captured."""
    hosts = (
        shop_pages(spark, sf)
        .select("page_id", urls.netloc(F.col("url")).alias("host"))
        .filter("host <> ''")
        .groupBy("host")
        .agg(F.min("page_id").alias("first_page"))
    )
    line = 2 * F.col("first_page") + 1
    return hosts.select(
        F.inline(
            F.array(
                F.struct(line.alias("txt_line_num"), F.col("host").alias("netloc")),
                F.struct((line + 1).alias("txt_line_num"), F.concat(F.lit("gone."), "host").alias("netloc")),
            )
        )
    )


def fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    source = table(spark, sf, "pages").select("page_id", "url")
    homepage = F.concat(F.lit("https://"), urls.netloc(F.col("url")))
    suffix = pick(SUFFIXES)
    return source.select(
        "page_id",
        F.expr(_url_form()).alias("url"),
        homepage.alias("homepage"),
        suffix.alias("suffix"),
        F.when(suffix.isNull(), "homepage").otherwise("sitemap").alias("kind"),
        pick(STATUSES, "int").alias("status"),
        pick([None, "https://from.example/"]).alias("referer"),
        F.concat(F.lit("10.0.0."), F.col("page_id") % 256).alias("ip_address"),
        pick([True, False, None], "boolean").alias("ssl_certificate"),
        pick(["h2", "http/1.1", None]).alias("protocol"),
        pick([True, False, False, False, False], "boolean").alias("cached"),
        pick([None, "host.example"]).alias("reverse_dns"),
    )


def sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """Robots files, sitemap indexes and sitemaps in turn, naming the page."""
    host = F.concat(F.lit("https://"), urls.netloc(F.col("url")))
    robots = F.concat(
        F.lit("User-agent: *\nSitemap: "), host, F.lit("/a.xml\r\n  sitemap:"), host, F.lit("/b.xml \n")
    )
    index = F.concat(
        F.lit("<?xml version='1.0'?>\n<sitemapindex xmlns='x'><sitemap>\n<loc> "), host,
        F.lit("/c.xml?a=1&amp;b=2 </loc></sitemap><sitemap><loc><![CDATA["), host,
        F.lit(".nz/d.xml]]></loc></sitemap></sitemapindex>"),
    )
    listed = F.concat_ws(
        "",
        *[
            x
            for tail in ("/about-us", "/aboutus", "/contact", "/xcontacty", "/shop", "/about-us/contact")
            for x in (F.lit("<url><loc>"), F.col("url"), F.lit(f"{tail}</loc><image:loc>n</image:loc></url>"))
        ],
    )
    urlset = F.concat(F.lit("<urlset>"), listed, F.lit("</urlset>"))
    turn = F.col("page_id") % 4
    return table(spark, sf, "pages").select(
        "page_id",
        F.concat(host, pick(["/robots.txt", "/s.xml", "/t.xml", "/page"])).alias("url"),
        F.when(turn == 0, robots)
        .when(turn == 1, index)
        .when(turn == 2, urlset)
        .otherwise("<html><loc>no</loc></html>")
        .alias("body"),
    )


def nested_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """Per host of the pages: a robots file, sitemap indexes nested four deep with
    a cycle back to the first, and a sitemap listing the host's pages."""
    pages = table(spark, sf, "pages").select("url")
    hosts = pages.select(F.concat(F.lit("https://"), urls.netloc(F.col("url")), F.lit(".nz")).alias("h"))
    hosts = hosts.filter(F.col("h") != "https://.nz").distinct()
    h = F.col("h")

    def index(*tails: str) -> Column:
        parts = [x for t in tails for x in (F.lit("<sitemap><loc>"), h, F.lit(f"{t}</loc></sitemap>"))]
        return F.concat(F.lit("<sitemapindex>"), *parts, F.lit("</sitemapindex>"))

    listed = pages.select(
        F.concat(F.lit("https://"), urls.netloc(F.col("url")), F.lit(".nz")).alias("h"),
        F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("</loc></url>")).alias("entry"),
    )
    urlsets = listed.groupBy("h").agg(F.concat_ws("", F.array_sort(F.collect_list("entry"))).alias("entries"))
    def entry(name: str, body: Column) -> Column:
        return F.struct(F.concat(h, F.lit(name)).alias("url"), body.alias("body"))

    bodies = hosts.select(
        F.inline(
            F.array(
                entry("/robots.txt", F.concat(F.lit("Sitemap: "), h, F.lit("/n0.xml\n"))),
                entry("/n0.xml", index("/n1.xml", "/gone.xml")),
                entry("/n1.xml", index("/n2.xml")),
                entry("/n2.xml", index("/n3.xml", "/n0.xml")),
                entry("/n3.xml", index("/n4.xml")),
            )
        )
    )
    sets = urlsets.select(F.concat("h", F.lit("/n4.xml")).alias("url"), F.concat(F.lit("<urlset>"), "entries", F.lit("</urlset>")).alias("body"))
    return bodies.unionByName(sets)


# Added to the number of a page, or of an error, that comes again later.
LATER = 1_000_000


def _never_captured(url: Column) -> Column:
    return F.replace(url, F.lit("://"), F.lit("://gone."))


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """A label for every page's URL, and for some URLs that were never captured."""
    url, labels = F.col("url"), F.split(pick(LABELS), "[|]").alias("actual")
    source = table(spark, sf, "pages")
    gone = source.filter("page_id % 7 = 3").select(_never_captured(url).alias("url"), labels)
    return source.select("url", labels).union(gone)


def captured_sites(spark: SparkSession, sf: str) -> DataFrame:
    """All pages under their own URLs, some captured again with another piece of HTML."""
    again = F.when(F.col("page_id") % 9 == 4, F.array(F.lit(0), F.lit(LATER))).otherwise(F.array(F.lit(0)))
    captures = pages(spark, sf).withColumn("later", F.explode(again))
    numbered = captures.select((F.col("page_id") + F.col("later")).alias("page_id"), "url", "html")
    return numbered.withColumn("html", F.concat("html", pick(PIECES)))


def errors(spark: SparkSession, sf: str) -> DataFrame:
    """Capture errors in order, some URLs with two and those never captured with one."""
    url, ordinal = F.col("url"), F.col("page_id")
    source = table(spark, sf, "pages").select("url", "page_id")
    error = F.when(url.contains("/fr/"), "ConnectTimeout").when(url.contains("/m."), "SSLError")
    first = source.select("url", error.alias("error"), ordinal.alias("ord")).filter("error is not null")
    second = source.filter("page_id % 5 = 1 and (contains(url, '/fr/') or contains(url, '/m.'))").select(
        "url", F.lit("ReadTimeout").alias("error"), (ordinal + LATER).alias("ord")
    )
    gone = source.filter("page_id % 7 = 3").select(
        _never_captured(url).alias("url"), F.lit("DNSLookupError").alias("error"), ordinal.alias("ord")
    )
    return first.union(second).union(gone)


def blocked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("url").filter(F.col("url").rlike("/ads-track[.]|/m[.]th"))


# --------------------------------------------------------------------------
# The same inputs in SQL.


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_pick(choices: list, kind: str = "VARCHAR") -> str:
    shown = [
        "NULL" if c is None else text(c) if isinstance(c, str) else str(c).upper() for c in choices
    ]
    return f"([{', '.join(shown)}]::{kind}[])[(page_id % {len(choices)} + 1)::INT]"


NETLOC = r"regexp_extract({}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"
_HOST = f"'https://' || {NETLOC.format('url')}"
_TAILS = ("/about-us", "/aboutus", "/contact", "/xcontacty", "/shop", "/about-us/contact")
_URLSET = " || ".join(
    f"'<url><loc>' || url || '{tail}</loc><image:loc>n</image:loc></url>'" for tail in _TAILS
)

CTES = {
    "shop": f"""
        SELECT page_id, {_url_form()} AS url, html || {_sql_pick(PIECES)} AS html,
               {_sql_pick(["homepage", "homepage", "about_us", None])} AS page_type,
               'https://web.archive.org/web/' || {_sql_pick(STAMPS)} || 'id_/' || url AS capture_url
        FROM pages""",
    "seeds": f"""
        SELECT 2 * first_page + k AS txt_line_num, CASE k WHEN 1 THEN host ELSE 'gone.' || host END AS netloc
        FROM (SELECT {NETLOC.format("url")} AS host, min(page_id) AS first_page
              FROM shop GROUP BY 1), (VALUES (1), (2)) AS v(k)
        WHERE host <> ''""",
    "fetch_log": f"""
        SELECT page_id, {_url_form()} AS url, {_HOST} AS homepage, {_sql_pick(SUFFIXES)} AS suffix,
               CASE WHEN {_sql_pick(SUFFIXES)} IS NULL THEN 'homepage' ELSE 'sitemap' END AS kind,
               {_sql_pick(STATUSES, "INT")} AS status,
               {_sql_pick([None, "https://from.example/"])} AS referer,
               '10.0.0.' || (page_id % 256) AS ip_address,
               {_sql_pick([True, False, None], "BOOLEAN")} AS ssl_certificate,
               {_sql_pick(["h2", "http/1.1", None])} AS protocol,
               {_sql_pick([True, False, False, False, False], "BOOLEAN")} AS cached,
               {_sql_pick([None, "host.example"])} AS reverse_dns
        FROM pages""",
    "sitemaps": f"""
        SELECT page_id, {_HOST} || {_sql_pick(["/robots.txt", "/s.xml", "/t.xml", "/page"])} AS url,
               CASE page_id % 4
               WHEN 0 THEN 'User-agent: *' || chr(10) || 'Sitemap: ' || {_HOST} || '/a.xml' || chr(13)
                   || chr(10) || '  sitemap:' || {_HOST} || '/b.xml ' || chr(10)
               WHEN 1 THEN '<?xml version=''1.0''?>' || chr(10) || '<sitemapindex xmlns=''x''><sitemap>'
                   || chr(10) || '<loc> ' || {_HOST} || '/c.xml?a=1&amp;b=2 </loc></sitemap><sitemap><loc><![CDATA['
                   || {_HOST} || '.nz/d.xml]]></loc></sitemap></sitemapindex>'
               WHEN 2 THEN '<urlset>' || {_URLSET} || '</urlset>'
               ELSE '<html><loc>no</loc></html>' END AS body
        FROM pages""",
    "truth": f"""
        SELECT url, string_split({_sql_pick(LABELS)}, '|') AS actual FROM pages
        UNION ALL SELECT replace(url, '://', '://gone.'), string_split({_sql_pick(LABELS)}, '|') FROM pages WHERE page_id % 7 = 3""",
    "sites": f"""
        SELECT page_id, url, html || {_sql_pick(PIECES)} AS html
        FROM (SELECT page_id, url, html FROM pages
              UNION ALL SELECT page_id + {LATER}, url, html FROM pages WHERE page_id % 9 = 4)""",
    "errors": f"""
        SELECT * FROM (SELECT url, CASE WHEN contains(url, '/fr/') THEN 'ConnectTimeout'
                                   WHEN contains(url, '/m.') THEN 'SSLError' END AS error, page_id AS ord FROM pages)
        WHERE error IS NOT NULL
        UNION ALL SELECT url, 'ReadTimeout', page_id + {LATER} FROM pages
        WHERE page_id % 5 = 1 AND (contains(url, '/fr/') OR contains(url, '/m.'))
        UNION ALL SELECT replace(url, '://', '://gone.'), 'DNSLookupError', page_id FROM pages WHERE page_id % 7 = 3""",
    "blocked": "SELECT url FROM pages WHERE regexp_matches(url, '/ads-track[.]|/m[.]th')",
}
