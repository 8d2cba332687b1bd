import random

import pytest

from checks import registry, word_queries  # noqa: F401
from webtables.operators import topics as K, words as W
from webtables.plans.jobs import website_topics
from webtables.sources.tables import materialise

# Only words the tests use.
KEYWORDS = {
    "Website design, developing": ["software", "graphic"],
    "Software products and services": ["software", "develop", "develop"],
    "App design, developing": ["iphone", "android"],
    "Hotels": ["hotel"],
    "Holidays": ["hotel", "trip"],
}


@pytest.fixture(scope="module")
def topics(spark):
    return K.taxonomy(spark, KEYWORDS)


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(
        [
            ("none", ["other"]),
            ("empty", []),
            ("tie", ["software", "develop", "iphone", "android"]),
            ("one", ["software", "develop"]),
            ("shared", ["hotel"]),
            ("mixed", ["hotel", "graphic"]),
        ],
        "site string, keywords array<string>",
    )


def test_taxonomy(topics):
    assert topics.count() == 35
    assert topics.select("category").distinct().count() == 2
    assert topics.orderBy("topic_ord").first()["topic"] == "Hotels"
    assert K.unmapped_topics(topics).count() == 30


def test_votes(sites, topics):
    votes = {(r["site"], r["topic"]): r["votes"] for r in K.topic_votes(sites, topics).collect()}
    assert votes[("tie", "Software products and services")] == 2
    assert votes[("tie", "App design, developing")] == 2
    assert votes[("tie", "Website design, developing")] == 1
    assert not [k for k in votes if k[0] in ("none", "empty")]


def test_topics_of_sites(sites, topics):
    rows = {r["site"]: r for r in K.site_topics(sites, topics).collect()}
    assert rows["tie"]["topics"] == ["App design, developing", "Software products and services"]
    assert rows["tie"]["subcategories"] == ["Hosting and cloud", "Software"]
    assert rows["one"]["topics"] == ["Software products and services"]
    assert rows["shared"]["topics"] == ["Hotels", "Holidays"]
    assert rows["shared"]["subcategories"] == ["Leisure"]
    assert rows["mixed"]["categories"] == ["D", "E"]
    assert rows["none"]["topics"] == rows["empty"]["topics"] == []


def test_coverage_and_filters(sites, topics):
    classified = K.site_topics(sites, topics)
    assert K.topic_coverage(classified).first().asDict() == {
        "n_sites": 6, "with_topic": 4, "multi_topic": 3, "multi_subcategory": 2, "multi_category": 1,
    }
    assert K.with_topics(classified).count() == 4
    assert K.with_topics(classified, 1).count() == 3
    assert [r["site"] for r in K.preview(classified, 2, "site").collect()] == ["empty", "mixed"]
    assert K.random_rows(classified, 3, seed=1).distinct().count() == 3


def test_website_topics(spark, topics):
    texts = spark.createDataFrame(
        [(1, "https://a.nz/x", "hotel hotel the the the"), (2, "https://a.nz/y", "trip"), (3, "https://b.nz", "zz")],
        "page_id bigint, url string, text string",
    )
    rows = {r["netloc"]: r["topics"] for r in website_topics(texts, topics, ["the"]).collect()}
    assert rows == {"a.nz": ["Holidays"], "b.nz": []}


def test_sample_is_independent_of_partitioning(spark):
    import hashlib

    rows = [(i, f"t{i % 13}") for i in range(500)] + [(7, "t7"), (7, "t7"), (None, "none")]
    frame = spark.createDataFrame(rows, "doc_id long, tag string")
    draws = [
        sorted(map(tuple, K.random_rows(frame.repartition(parts), 12, 5, key="doc_id").collect()), key=repr)
        for parts in (1, 5, 211)
    ]
    assert draws[0] == draws[1] == draws[2]
    # The least md5 priorities of "5:" and the key, computed in plain Python.
    order = sorted(rows, key=lambda r: hashlib.md5(f"5:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    assert draws[0] == sorted(order[:12], key=repr)
    # Without a key the whole row is hashed; repeated rows are drawn alike under any layout.
    whole = [sorted(map(tuple, K.random_rows(frame.repartition(p), 40, 1).collect()), key=repr) for p in (1, 211)]
    assert whole[0] == whole[1] and len(whole[0]) == 40
    assert K.random_rows(frame.limit(0), 3, 1).count() == 0


def test_topic_queries_shuffle_no_word_of_a_document_of_one_row(spark, topics):
    # Only keywords, votes and topics meet by key: no list of counted words is dealt out.
    docs = spark.createDataFrame([(1, 1, "cat dog cat"), (2, 2, "bird")], "k bigint, o bigint, text string")
    keywords = W.leading_words(docs, "k", "o", stop_words=["the"])
    plan = K.site_topics(keywords, topics, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and sorted(keywords.collect()) == [(1, ["cat", "dog"]), (2, ["bird"])]


def dealt_out(frame):
    """Bytes that the exchanges between tasks took in when the frame ran."""
    frame.collect()

    def below(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return below(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return below(node.plan())
        own = node.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(below(node.children().apply(i)) for i in range(node.children().size()))

    return below(frame._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["topic_votes", "site_topics", "sites_with_topics", "topic_coverage", "topic_preview"])
def test_topic_queries_deal_out_far_less_than_the_texts(spark, folder, monkeypatch, name):
    # Every word differs but one keyword a text, so that counts by (document, word) are as large as the texts.
    draw = random.Random(3)
    texts = [" ".join(["les", "les", *("".join(draw.choices("abcdefgh", k=9)) for _ in range(2000))]) for _ in range(20)]
    rows = [(i, t, "fr", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    written = []

    def recorded(table):
        written.append(table)
        return materialise(table)

    monkeypatch.setattr(W, "materialise", recorded, raising=False)
    result = registry.QUERIES[name](spark, folder)
    assert result.count() == {"topic_coverage": 1, "topic_preview": 10, "sites_with_topics": 0}.get(name, 20)
    size = sum(len(t) for t in texts)
    assert sum(dealt_out(f) for f in [*written, result]) < size / 10
