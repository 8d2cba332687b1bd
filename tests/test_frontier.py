import pytest
from pyspark.sql import functions as F

from webtables.operators import frontier


@pytest.fixture(scope="module")
def seeds(spark):
    lines = ["# a", "# b", "# c", "www.a.nz", "b.nz", "c.nz"]
    return spark.createDataFrame(
        [(i + 1, line) for i, line in enumerate(lines)], "txt_line_num bigint, netloc string"
    )


def test_seed_slice(seeds):
    rows = frontier.seed_slice(seeds, 4, 6).collect()
    assert [(r["txt_line_num"], r["homepage"]) for r in rows] == [
        (4, "https://www.a.nz"),
        (5, "https://b.nz"),
    ]
    assert frontier.seed_slice(seeds, "4", "7").count() == 3
    assert frontier.seed_slice(seeds, 4).count() == 3
    assert frontier.seed_slice(seeds, 5, 5).count() == 0


@pytest.mark.parametrize(
    "start, end, message",
    [("x", 5, "integers"), (4, None.__class__, "integers"), (3, 5, "line 4"), (6, 5, "before it starts"), (4, 8, "beyond 7")],
)
def test_seed_slice_errors(seeds, start, end, message):
    with pytest.raises(ValueError, match=message):
        frontier.seed_slice(seeds, start, end)


def test_start_requests(seeds):
    rows = frontier.start_requests(frontier.seed_slice(seeds, 5, 6)).collect()
    assert [(r["kind"], r["url"]) for r in rows] == [
        ("homepage", "https://b.nz"),
        ("sitemap", "https://b.nz/robots.txt"),
    ]


def test_fallbacks(spark):
    log = spark.createDataFrame(
        [
            ("https://a.nz", "/robots.txt", "sitemap", 404),
            ("https://b.nz", "/sitemap.xml", "sitemap", 404),
            ("https://c.nz", "/robots.txt", "sitemap", 403),
            ("https://d.nz", "/robots.txt", "sitemap", None),
            ("https://e.nz", None, "homepage", 404),
        ],
        "homepage string, suffix string, kind string, status int",
    )
    assert [r["url"] for r in frontier.fallback_requests(log).collect()] == ["https://a.nz/sitemap.xml"]
    longer = frontier.fallback_requests(log, ("/robots.txt", "/sitemap.xml", "/map.xml"))
    assert {r["url"] for r in longer.collect()} == {"https://a.nz/sitemap.xml", "https://b.nz/map.xml"}


def test_sitemaps(spark):
    bodies = spark.createDataFrame(
        [
            ("https://a.nz/robots.txt", "User-agent: *\nSitemap: https://a.nz/1.xml\r\n sitemap:https://a.nz/2.xml\nNot-sitemap: x"),
            ("https://a.nz/i.xml", "<?xml?><sitemapindex><sitemap><loc>\n https://a.nz/s.xml?a&amp;b </loc></sitemap>"
                                   "<sitemap><loc>https://a.com/s.xml</loc></sitemap></sitemapindex>"),
            ("https://a.nz/u.xml", "<urlset xmlns='x'>" + "".join(
                f"<url><loc>https://a.nz{p}</loc><image:loc>no</image:loc></url>"
                for p in ("/about-us", "/aboutus", "/contact", "/xcontacty", "/shop", "/about-us/contact")) + "</urlset>"),
            ("https://a.nz/page", "<html><loc>no</loc></html>"),
        ],
        "url string, body string",
    )
    locations = frontier.sitemap_locations(bodies)
    assert locations.groupBy("kind").count().orderBy("kind").collect() == [
        ("robots", 2), ("sitemapindex", 2), ("urlset", 6)
    ]
    followed = {r["loc"] for r in frontier.followed_sitemaps(locations).collect()}
    assert followed == {"https://a.nz/1.xml", "https://a.nz/2.xml", "https://a.nz/s.xml?a&b"}
    routed = {r["loc"][12:] for r in frontier.routed_pages(locations).collect()}
    assert routed == {"/about-us", "/aboutus", "/contact", "/xcontacty", "/about-us/contact"}


def test_the_first_rule_decides(one):
    rules = (("/about-us", "first"), ("contact", "second"))
    assert one("/about-us/contact", lambda u: frontier.first_rule(u, rules)) == "first"
    assert one("/contact", lambda u: frontier.first_rule(u, rules)) == "second"
    assert one("/shop", lambda u: frontier.first_rule(u, rules)) is None
    assert one(None, lambda u: frontier.first_rule(F.col("x"), rules)) is None
