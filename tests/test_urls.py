from urllib.parse import urlsplit

from webtables.functions import urls

URLS = [
    "https://www.shop.co.nz/a/b?x=/c#/d",
    "https://www.www.x.org:8080",
    "http://me:pw@host.nz/",
    "//host.com/a//b/",
    "not a url",
    "mailto:someone",
    "path/only/x",
    "https://x.com?q=1",
    "https://x.com#a/b",
    "",
    "https://co.first.com/",
    "https://localhost/a",
    "HTTPS://EXAMPLE.COM/A",
]


def _by_hand(url):
    parts = urlsplit(url)
    pieces = parts.netloc.split(".")
    marker = next((m for m in ("co", "com", "org", "nz") if m in pieces), None)
    name = parts.netloc if marker is None else pieces[pieces.index(marker) - 1]
    level = len([p for p in parts.path.split("/") if p]) + 1
    return parts.netloc, parts.netloc.replace("www.", ""), level, name


def test_url_parts_agree_with_urlsplit(spark):
    frame = spark.createDataFrame([(u,) for u in URLS], "u string")
    rows = frame.select(
        "u",
        urls.netloc(frame.u).alias("netloc"),
        urls.domain(frame.u).alias("domain"),
        urls.level(frame.u).alias("level"),
        urls.short_name(frame.u).alias("name"),
    ).collect()
    for row in rows:
        assert tuple(row)[1:] == _by_hand(row["u"]), row["u"]


def test_null_url_gives_nulls(one):
    assert one(None, urls.netloc) is None
    assert one(None, urls.short_name) is None


def test_capture_time(one):
    base = "https://web.archive.org/web/"
    assert one(f"{base}20200215083000id_/https://x.nz", urls.capture_time) == 20200215083000
    assert one(f"{base}2020021508300id_/https://x.nz", urls.capture_time) is None
    assert one(f"x{base}20200215083000id_/", urls.capture_time) is None


def test_capture_range_includes_both_ends(one):
    def inside(stamp):
        url = f"https://web.archive.org/web/{stamp}id_/https://x.nz"
        return one(url, lambda u: urls.captured_between(u, 20200101120000, 20200301120000))

    assert inside(20200101120000) and inside(20200301120000)
    assert not inside(20200101115959) and not inside(20200301120001)
