import pytest
from pyspark.sql import functions as F

from webtables.operators import rollup, skew
from webtables.operators.pages import page_records
from webtables.plans.jobs import website_table

SCHEMA = (
    "website string, page_id bigint, url string, title string, social_links array<string>,"
    "copyright array<string>, status_code int"
)
FIELDS = ["url", "title", "social_links", "copyright", "status_code"]


@pytest.fixture(scope="module")
def crawl(spark):
    return spark.createDataFrame(
        [
            ("a.nz", 3, "u3", "t", ["x", "y"], ["b", "a"], 200),
            ("a.nz", 1, "u1", "t", ["y", "x"], ["a", "b"], 404),
            ("a.nz", 2, "u2", "", [], None, 200),
            ("b.nz", 4, None, None, [], [], None),
            (None, 5, "u5", "t", None, None, 200),
            ("", 6, "u6", "t", None, None, 200),
        ],
        SCHEMA,
    )


def test_site_table(crawl):
    rows = {r["website"]: r for r in rollup.site_table(crawl, FIELDS).collect()}
    assert set(rows) == {"a.nz", "b.nz"}
    a = rows["a.nz"]
    assert a["url"] == ["u1", "u2", "u3"]
    assert a["title"] == ["t"]
    assert a["social_links"] == [["x", "y"]]
    assert a["copyright"] == [["a", "b"], ["b", "a"]]
    assert a["status_code"] == [404, 200]
    assert [rows["b.nz"][f] for f in FIELDS] == [[]] * 5


def test_a_large_site_is_cut_and_whole(spark):
    records = spark.range(5000).select(
        F.when(F.col("id") % 10 < 8, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("website"),
        F.col("id").alias("page_id"),
        F.concat(F.lit("u"), "id").alias("url"),
    )
    rows = rollup.site_table(records, ["url"], limit=500).collect()
    big = sorted((r for r in rows if r["website"] == "big"), key=lambda r: r["part"])
    assert len(big) > 1 and all(len(r["url"]) <= 500 for r in big)
    assert [u for r in big for u in r["url"]] == [f"u{i}" for i in range(5000) if i % 10 < 8]
    small = [r for r in rows if r["website"] != "big"]
    assert {r["part"] for r in small} == {0}
    assert sum(len(r["url"]) for r in rows) == 5000


@pytest.mark.parametrize("step", [1, 10**6, 2**55])
def test_parts_by_size(spark, step):
    sizes = [3, 0, 7, 20, 1, 1, 1, 9] * 5
    rows = spark.createDataFrame([("a", i * step, "x" * n) for i, n in enumerate(sizes)] + [("b", 1, "x"), (None, 1, "y")], "k string, i bigint, t string")
    got = skew.with_part(rows, "k", ["i"], 10, F.length("t")).collect()
    assert len(got) == 42
    begin = [sum(sizes[:i]) for i in range(len(sizes))]
    assert {r["i"] // step: r["part"] for r in got if r["k"] == "a"} == {i: b // 10 for i, b in enumerate(begin)}
    assert {r["part"] for r in got if r["k"] != "a"} == {0}


def test_align_to_seeds(spark, crawl):
    sites = rollup.site_table(crawl, ["url"])
    seeds = spark.createDataFrame(
        [(4, "www.a.nz"), (5, "gone.nz"), (6, "a.nz")], "txt_line_num bigint, netloc string"
    )
    rows = rollup.align_to_seeds(sites, seeds).orderBy("txt_line_num").collect()
    assert [(r["txt_line_num"], r["website"], r["url"]) for r in rows] == [
        (4, "www.a.nz", ["u1", "u2", "u3"]),
        (5, "gone.nz", None),
        (6, "a.nz", ["u1", "u2", "u3"]),
    ]
    strict = rollup.align_to_seeds(sites, seeds, strict=True).orderBy("txt_line_num").collect()
    assert [r["url"] is None for r in strict] == [True, True, False]


def test_every_field_needs_a_group(crawl):
    with pytest.raises(ValueError, match="brand_new"):
        rollup.group_fields(crawl, ["url", "brand_new"])


def test_website_table_groups(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.nz/", "<title>t</title><p>visa</p>")], "page_id bigint, url string, html string"
    )
    seeds = spark.createDataFrame([(4, "a.nz")], "txt_line_num bigint, netloc string")
    table = website_table(pages, seeds)
    assert table.columns == ["txt_line_num", "part", *rollup.FIELD_GROUPS]
    row = table.first()
    assert row["General"]["title"] == ["t"] and row["General"]["website"] == "a.nz"
    assert row["eCommerce"]["payment_systems"] == [["visa"]]
    assert row["Other"]["test"] == []
    covered = {f for fields in rollup.FIELD_GROUPS.values() for f in fields}
    assert set(page_records(pages).columns) - {"page_id", "page_type"} == covered
