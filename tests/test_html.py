"""HTML functions, against the standard library's parser and by example."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from webtables.functions import entities, html as H
from webtables.operators import pages as P


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.pos = [], -1

    def handle_starttag(self, tag, attrs):
        self.pos += 1
        for name, value in attrs:
            value = value or ""
            parts = value.split() if name in ("class", "rel") and value.split() else [value]
            self.rows += [(self.pos, tag, name, part) for part in parts]


def parsed(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return sorted(reader.rows)


PIECES = [
    "<p>text</p>", "<br>", "<br/>", "text & more &amp; &copy;", "<a href='/x?a=1&amp;b=2'>l</a>",
    '<a href="a>b" title=\'q "x"\'>t</a>', "<img src=/a/b.png alt>", "<img src='a.png' />",
    "<div class='a  b\nc' id=x></div>", "<DIV CLASS=Top ID='Y'>z</DIV>", "<!-- <img src='no'> -->",
    "<script>if (a<b) x('<img src=no>');</script>", "<script type='t/x' src=s.js></script>",
    "<style id='s'>p > a {color:'<b>'}</style>", "<my-el data-a='1' data-b>x</my-el>",
    "<link rel='stylesheet preload' href=//x/y.css>", "<a href = 'spaced' >s</a>",
    "<input disabled value=''>", "< notatag>", "a < b > c", "<svg viewBox='0 0 1 1'/>",
    "<a\nhref='x'\n\tclass='y'>n</a>", "<b x=&#65;&#x42;>n</b>", "</p attr='no'>", "<!DOCTYPE html>",
    "<p @click='go' :a='1' *ngIf='x' [b]='2'>v</p>", "<scripty a=1>x</scripty>",
]


def test_tags_agree_with_a_parser(spark):
    random.seed(5)
    pages = {i: "".join(random.choices(PIECES, k=random.randint(1, 12))) for i in range(300)}
    frame = spark.createDataFrame(
        [(i, "u", page) for i, page in pages.items()], "page_id bigint, url string, html string"
    )
    found = {i: [] for i in pages}
    for row in P.page_tags(frame).collect():
        found[row["page_id"]].append((row["pos"], row["tag"], row["attr"], row["value"]))
    for i, page in pages.items():
        assert sorted(found[i]) == parsed(page), page


def test_long_and_broken_pages_do_not_hurt(spark):
    pages = [
        "<p " + "a " * 100_000 + ">",
        "<p " + "a=1 " * 100_000,
        "<a href='" + "x" * 200_000 + "'>",
        "<" * 50_000,
        "<script>" + "x<" * 100_000,
        "<!-- " + "-" * 100_000,
        "<a href='tel:'>" + "<i>x</i>" * 20_000,
        "<footer>" * 1000 + "© a",
    ]
    frame = spark.createDataFrame(
        [(i, "https://x.nz", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string"
    )
    assert P.page_records(frame).filter("website = 'x.nz'").count() == len(pages)
    assert P.page_tags(frame).filter("page_id = 2").first()["value"] == "x" * 200_000


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("a &amp; b", "a & b"),
        ("&amp;lt;", "&lt;"),
        ("&#65;&#x42;&#X1F600;", "AB😀"),
        ("&nbsp;&copy;&bogus;&", " ©&bogus;&"),
        ("&#0;&#xD800;&#1114112;&#99999999999;", "\ufffd" * 4),
        ("&copy 2021 &copyright &notit; &amp", "© 2021 ©right ¬it; &"),
        ("&#00000169;&#x0000a9 &#150;&#129;", "©© –\x81"),
        ("&CounterClockwiseContourIntegral;&bne;", "∳=⃥"),
        ("", ""),
        (None, None),
    ],
)
def test_entities(one, text, wanted):
    assert one(text, entities.decode) == wanted


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<title>A &amp; B</title><title>C</title>", "A & B"),
        ("<TITLE class=x> x </TITLE>", " x "),
        ("<title></title><svg><title>second</title></svg>", "second"),
        ("<!-- <title>no</title> --><p>x", None),
        ("<script>'<title>no</title>'</script>", None),
        ("", None),
        (None, None),
    ],
)
def test_title(one, page, wanted):
    assert one(page, H.title) == wanted


def test_meta_takes_the_first_with_content(one):
    page = "<meta name=author><meta name='author' content=''><meta name=author content=b>"
    assert one(page, lambda x: H.meta_content(H.tag_array(x), "author")) == ""
    assert one("<meta name=Author content=b>", lambda x: H.meta_content(H.tag_array(x), "author")) is None


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<footer>\n\t<p>&copy; 2020</p>\n CopyRight <b>x</b> \nother</footer>", ["© 2020", "CopyRight x"]),
        ("<footer><script>w('copyright <b>')</script></footer>", ["w('copyright <b>')"]),
        ("<footer><!-- copyright --></footer>", []),
        ("<footer>© a</footer><p>© no</p><footer> © b", ["© a© b".replace("a©", "a ©")]),
        ("<p>copyright</p>", []),
    ],
)
def test_copyright_lines(one, page, wanted):
    assert one(page, H.copyright_lines) == wanted


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<a href='tel:+64 4'>x</a><a href=\"tel:+64 4\">y</a>", ["+64 4"]),
        ("<a href='tel:'> 09 123</a>", [" 09 123"]),
        ("<a href='tel:'></a>", [None]),
        ("<a href='tel:'><i class='p'></i> 09</a>", [" 09"]),
        ("<a href='tel:'><span><b>1</b>2</span>3</a>", ["3"]),
        ("<a href='&#116;el:5'>x</a>", ["5"]),
        ("<a title='tel:9' href='/x'>x</a><a>tel:</a>", []),
        ("<a href='Tel:9'>x</a>", []),
    ],
)
def test_phone_numbers(one, page, wanted):
    assert one(page, H.phone_numbers) == wanted


def test_social_links(one):
    page = (
        "<a href='https://facebook.com/a>b'>f</a><a href=https://FACEBOOK.com>g</a>"
        "<a href='https://facebook.com/a>b'>f</a><link href='https://twitter.com'>"
        "<a href='https://youtube.com/?a&amp;b'>y</a><a name=linkedin>n</a>"
    )
    wanted = ["https://facebook.com/a>b", "https://youtube.com/?a&b"]
    assert one(page, lambda x: H.social_links(H.tag_array(x))) == wanted


def test_page_text(spark):
    page = "<p>a &amp; b</p>\n\n<script>no</script><style>no</style><!-- no -->\n<b>c</b><p>ﬁ</p>\n"
    frame = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    assert P.page_texts(frame).first()["text"] == "a & b\ncﬁ"
    assert P.page_texts(frame, normalise=True).first()["text"] == "a & b\ncfi"


def test_repeated_attributes_keep_either_end(one):
    page = "<a href=first href=last>"
    assert one(page, lambda x: H.attr(H.tag_array(x)[0], "href")) == "last"
    assert one(page, lambda x: H.attr(H.tag_array(x)[0], "href", "first")) == "first"


def test_records_by_page_type(spark):
    frame = spark.createDataFrame(
        [
            (1, "https://www.x.nz/", "<title>t</title><p>visa</p>"),
            (2, "https://x.nz/about-us", "<title>t</title>"),
            (3, "https://x.nz/contact", "<title>t</title>"),
            (4, "https://x.nz/shop", "<title>t</title>"),
        ],
        "page_id bigint, url string, html string",
    )
    log = spark.createDataFrame(
        [
            (1, 200, None, "1.2.3.4", True, "h2", False, "host"),
            (2, 200, "https://x.nz/", "1.2.3.4", None, "h2", True, None),
            (None, 404, None, None, None, None, False, None),
        ],
        "page_id bigint, status int, referer string, ip_address string, ssl_certificate boolean,"
        "protocol string, cached boolean, reverse_dns string",
    )
    rows = {r["page_id"]: r for r in P.page_records(frame, log).collect()}
    assert [rows[i]["page_type"] for i in (1, 2, 3, 4)] == ["homepage", "about_us", "about_us", None]
    assert rows[1]["title"] == "t" and rows[2]["title"] is None
    assert rows[1]["payment_systems"] == ["visa"] and rows[1]["ssl_certificate"] == "true"
    assert rows[2]["referer"] == "https://x.nz/" and rows[2]["ip_address"] is None
    assert rows[4]["status_code"] is None
    assert {r["website"] for r in rows.values()} == {"x.nz"}


def test_cached_copies_are_masked_but_for_the_address(spark):
    log = spark.createDataFrame(
        [(1, 200, None, "1.2.3.4", True, "h2", True, None), (2, 200, None, None, None, None, False, None)],
        "page_id bigint, status int, referer string, ip_address string, ssl_certificate boolean,"
        "protocol string, cached boolean, reverse_dns string",
    )
    first, second = P.hosting(log).orderBy("page_id").collect()
    assert first["ip_address"] == "1.2.3.4"
    assert first["ssl_certificate"] == first["protocol"] == first["reverse_dns_lookup"] == P.CACHED
    assert second["ssl_certificate"] == "false" and second["reverse_dns_lookup"] == "Unknown"


def test_wayback_columns(spark):
    capture = "https://web.archive.org/web/20200215083000id_/https://x.nz"
    frame = spark.createDataFrame(
        [(1, "https://x.nz/about", "<title>t</title>", capture, "about_us")],
        "page_id bigint, url string, html string, capture_url string, page_type string",
    )
    row = P.page_records(frame).first()
    assert (row["wayback_url"], row["wayback_dt"]) == (capture, 20200215083000)
    assert row["title"] is None


def test_tag_prefilter_changes_nothing(spark):
    from checks import inputs
    from webtables.functions import ecommerce

    pages = inputs.shop_pages(spark, "/root/testdata/sf0.001")
    found = ecommerce.cart_software(F.col("tags"), F.col("html"))
    quick = P.with_tags(pages, ecommerce.CART_NEEDLES).select("page_id", found.alias("c"))
    full = pages.withColumn("tags", H.tag_array(F.col("html"))).select("page_id", found.alias("c"))
    assert sorted(quick.collect()) == sorted(full.collect())
