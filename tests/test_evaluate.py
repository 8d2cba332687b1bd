import pytest

from webtables.operators import evaluate as E
from webtables.plans.jobs import detector_scores


@pytest.fixture(scope="module")
def tables(spark):
    truth = spark.createDataFrame(
        [
            ("https://www.same.co.nz/", ["A", "B"]),
            ("https://order.com/", ["B", "A"]),
            ("https://part.com/", ["A", "C"]),
            ("https://none.com/", ["custom"]),
            ("https://unknown.org/", ["?"]),
            ("https://missing.nz/", ["A"]),
            ("https://blocked.nz/", ["custom"]),
        ],
        "url string, actual array<string>",
    )
    pred = spark.createDataFrame(
        [
            ("https://www.same.co.nz/", ["A", "B"]),
            ("https://order.com/", ["A", "B"]),
            ("https://part.com/", ["A", "Z"]),
            ("https://none.com/", ["B"]),
            ("https://unknown.org/", ["A"]),
            ("https://blocked.nz/", []),
        ],
        "url string, pred array<string>",
    )
    errors = E.error_table(
        spark.createDataFrame(
            [("https://missing.nz/", "Timeout"), ("https://blocked.nz/", "SSLError")], "url string, error string"
        ),
        spark.createDataFrame([("https://blocked.nz/",), ("https://else.nz/",)], "url string"),
    )
    return truth, pred, errors, E.results(truth, pred, errors)


def test_errors(tables):
    assert sorted(tables[2].collect()) == [
        ("https://blocked.nz/", "robotblock"),
        ("https://else.nz/", "robotblock"),
        ("https://missing.nz/", "Timeout"),
    ]


def test_results(tables):
    rows = {r["name"]: r for r in tables[3].collect()}
    flags = {n: (r["correct"], r["partial"]) for n, r in rows.items()}
    assert flags == {
        "same": (True, True), "order": (False, True), "part": (False, True), "none": (False, False),
        "unknown": (None, None), "missing": (False, False), "blocked": (False, False),
    }
    assert rows["missing"]["pred"] == [] and rows["missing"]["error"] == "Timeout"
    assert rows["same"]["error"] == ""


def test_performance(tables):
    truth, _, _, results = tables
    performance = E.label_performance(results)
    assert {tuple(r) for r in performance.collect()} == {
        ("A", 4, 3, 1), ("B", 2, 2, 1), ("C", 1, 0, 0), ("custom", 2, 0, 0), ("?", 1, 0, 0),
    }
    assert {r["label"] for r in E.supported_labels(performance).collect()} == {"A", "B", "custom"}
    assert E.label_vocabulary(truth).count() == 5


def test_filters(tables):
    truth, _, errors, results = tables
    names = lambda table: {r["name"] for r in table.collect()}
    assert names(E.with_label(results, "B")) == {"same", "order", "none"}
    assert names(E.with_label(results, "custom", where="truth")) == {"none", "blocked"}
    assert names(E.without_errors(results, errors)) == {"same", "order", "part", "none", "unknown"}
    assert names(E.recheck_list(truth)) == {"unknown"}
    assert names(E.with_error(results)) == {"missing", "blocked"}


def test_whole_job(spark, tables):
    truth = tables[0]
    pages = spark.createDataFrame(
        [
            (1, "https://order.com/", "<p>addtocart Visa</p>"),
            (2, "https://blocked.nz/", "<p>addtocart Visa</p>"),
            (3, "https://part.com/", "<p>nothing</p>"),
            (4, "https://none.com/", "<span class=nosto_cart>"),
        ],
        "page_id bigint, url string, html string",
    )
    errors = spark.createDataFrame([("https://part.com/", "E")], "url string, error string")
    blocked = spark.createDataFrame([("https://blocked.nz/",)], "url string")
    results, _, joined = detector_scores(pages, truth, errors, blocked)
    assert results.count() == joined.count() == 7
    rows = {r["name"]: r for r in joined.collect()}
    assert rows["order"]["has_card"] and rows["order"]["payment_names"] == ["visa"]
    assert not rows["blocked"]["has_card"] and rows["blocked"]["payment_names"] == []
    empty = {r["name"] for r in E.nothing_detected(joined).collect()}
    assert empty == {"same", "part", "unknown", "missing", "blocked"}
    assert {r["name"] for r in E.with_card(joined).collect()} == {"order"}
    none = errors.limit(0)
    assert E.evidence_counts(pages, none).first().asDict() == {"add_to_cart": 2, "payment_link": 0, "payment_item": 0}
    failed = E.error_table(errors, blocked)
    assert E.evidence_counts(pages, failed).first()["add_to_cart"] == 1


def test_the_last_capture_and_error_count(spark):
    truth = spark.createDataFrame([("https://a.nz/", ["nosto"])], "url string, actual array<string>")
    pages = spark.createDataFrame(
        [(2, "https://a.nz/", "<span class=nosto_cart>"), (1, "https://a.nz/", "<p>addtocart Visa</p>")],
        "page_id bigint, url string, html string",
    )
    errors = spark.createDataFrame(
        [("https://a.nz/", "new", 9), ("https://a.nz/", "old", 1)], "url string, error string, ord int"
    )
    failed = E.error_table(errors, errors.limit(0).select("url"), "ord")
    rows = E.site_scores(truth, E.detector_table(pages), failed).collect()
    assert [(r["pred"], r["correct"], r["error"], r["has_card"]) for r in rows] == [(["nosto"], True, "new", False)]
