import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webtables.functions import text as X
from webtables.operators import words as W

TEXTS = [
    ("a", 1, "The café, the CAFÉ x1 _hidden 12 naïve über-Straße"),
    ("a", 2, "supercalifragilistic ab b café"),
    ("b", 3, "Zwei zwei drei 42x ⅷ under_score"),
    ("c", 4, "1 2 3 !"),
    ("b", 5, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "site string, page_id bigint, text string")


def words_by_hand(text):
    runs = re.findall(r"(?:(?!\d)\w)+", text.lower())
    return [w for w in runs if 2 <= len(w) <= 15 and not w.startswith("_")]


def test_words(docs):
    for row in docs.select("text", X.words(F.col("text")).alias("w")).filter("text is not null").collect():
        assert row["w"] == words_by_hand(row["text"])


def test_terms(docs):
    for row in docs.select("text", X.terms(F.col("text")).alias("w")).filter("text is not null").collect():
        assert row["w"] == re.findall(r"\b\w\w+\b", row["text"].lower())


def test_counting_pages_equals_counting_the_joined_text(docs):
    joined = {r["site"]: r["text"] for r in W.joined_texts(docs, "site", "page_id").collect()}
    assert joined["a"] == f"{TEXTS[0][2]} | {TEXTS[1][2]}"
    counts = {}
    for r in W.word_counts(docs, "site").collect():
        counts.setdefault(r["site"], {})[r["word"]] = r["n"]
    for site, words in counts.items():
        assert words == dict(Counter(words_by_hand(joined[site])))


def test_joined_texts_of_a_large_site_are_cut_and_whole(spark):
    rows = spark.range(3000).select(
        F.lit("big").alias("site"), F.col("id").alias("page_id"), F.col("id").cast("string").alias("text")
    )
    parts = W.joined_texts(rows, "site", "page_id", limit=1000).orderBy("part").collect()
    assert len(parts) == 11
    assert " | ".join(p["text"] for p in parts) == " | ".join(str(i) for i in range(3000))


def test_ties_go_to_the_first_occurrence(spark):
    docs = spark.createDataFrame(
        [("s", 2, "dd cc bb aa aa"), ("s", 1, "ee cc zz yy xx ww cc")], "site string, page_id bigint, text string"
    )
    top = W.top_words(W.ordered_word_counts(docs, "site", "page_id"), "site", 5)
    assert W.keyword_lists(top, "site").first()["keywords"] == ["cc", "aa", "ee", "zz", "yy"]
    order = Counter(words_by_hand("ee cc zz yy xx ww cc dd cc bb aa aa")).most_common(5)
    assert [w for w, _ in order] == ["cc", "aa", "ee", "zz", "yy"]


def test_stored_counts(one):
    assert one("{'a': 1, 'b': 2}", X.parse_counts) == {"a": 1, "b": 2}
    assert one("{}", X.parse_counts) == {}
    assert not one("{'a'", X.parse_counts)
    kept = one({"the": 3, "cat": 1}, lambda c: X.drop_stop_words(c, ["the"]), "map<string,bigint>")
    assert kept == {"cat": 1}


def test_count_maps_are_cut_and_whole(spark):
    counts = spark.range(1000).select(F.lit("s").alias("site"), F.concat(F.lit("w"), "id").alias("word"), F.col("id").alias("n"))
    maps = W.count_maps(counts, "site", limit=100).collect()
    assert len(maps) > 1
    merged = {}
    for row in maps:
        assert not merged.keys() & row["counts"].keys()
        merged.update(row["counts"])
    assert merged == {f"w{i}": i for i in range(1000)}
    whole = W.count_maps(counts, "site").collect()
    assert len(whole) == 1 and whole[0]["counts"] == merged


def test_default_stop_words(spark, docs):
    assert "the" in W.default_stop_words()
    left = {r["word"] for r in W.without_stop_words(W.word_counts(docs, "site")).collect()}
    assert "the" not in left and "café" in left


def test_tf_idf_by_hand(docs):
    texts = {"a": "", "b": "", "c": ""}
    for site, _, text in TEXTS:
        texts[site] += " " + (text or "")
    stops = {"the"}
    counts = {
        s: Counter(w for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in stops) for s, t in texts.items()
    }
    df = Counter(w for c in counts.values() for w in c)
    wanted = {}
    for site, c in counts.items():
        raw = {w: n * (math.log((1 + 3) / (1 + df[w])) + 1) for w, n in c.items()}
        length = math.sqrt(sum(v * v for v in raw.values()))
        wanted |= {(site, w): v / length for w, v in raw.items()}
    got = {(r["doc"], r["word"]): r["weight"] for r in W.tf_idf(docs, "site", stop_words=["the"]).collect()}
    assert got.keys() == wanted.keys()
    assert all(math.isclose(got[k], wanted[k], rel_tol=1e-12) for k in wanted)


def test_mean_word_frequency_by_hand(spark):
    docs = spark.createDataFrame([("a", "the cat the"), ("b", "dog cat")], "site string, text string")
    rows = W.mean_word_frequency(W.word_counts(docs, "site"), "site", ["the"]).collect()
    assert {r["word"]: r["mean_freq"] for r in rows} == {"cat": (1 / 2 + 1 / 2) / 2, "dog": (1 / 2) / 2}


def exchanged(frame):
    """The columns of all shuffles of a plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_leading_words_of_single_and_repeated_keys(spark):
    rows = [(1, "b a b c"), (2, "zwei drei"), (2, "drei vier vier drei"), (3, None), (4, "on"), (None, "xx yy yy"), (None, "xx xx")]
    docs = spark.createDataFrame([(k, " ".join(w * 2 if len(w) == 1 else w for w in (t or "").split()) or None) for k, t in rows], "k long, text string")
    got = {r["k"]: r["keywords"] for r in W.leading_words(docs, "k", "k", n=2, stop_words=["on"]).collect()}
    assert got == {1: ["bb", "aa"], 2: ["drei", "vier"], None: ["xx", "yy"]}


def test_words_of_single_rows_are_not_shuffled(spark):
    docs = spark.range(100).select(F.col("id"), F.lit("one two two three").alias("text"))
    found = W.leading_words(docs, "id", "id", stop_words=["none"])
    assert not exchanged(found)
    assert found.first()["keywords"] == ["two", "one", "three"]


def test_weights_of_rows_of_one_document_add_up(spark):
    def weights(rows):
        docs = spark.createDataFrame(rows, "site string, text string")
        return {(r["doc"], r["word"]): round(r["weight"], 9) for r in W.tf_idf(docs, "site", stop_words=["none"]).collect()}

    joined = weights([("a", "xx yy xx xx zz"), ("b", "yy"), (None, "xx")])
    assert joined == weights([("a", "xx yy"), ("a", "xx xx zz"), ("b", "yy"), ("b", None), (None, "xx")])
    assert len(joined) == 4
