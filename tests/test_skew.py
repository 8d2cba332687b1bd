"""A hot key that holds a third of all rows or more."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from webtables.operators import cluster as C, words as W
from webtables.operators.skew import frequent_keys, join_frequent


@pytest.fixture
def eager_skew_handling(spark):
    """Let adaptive execution treat small test data as large."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _docs(spark):
    # Every document has the word "hot", most of them nothing else.
    rare = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" w"), "id")).otherwise("")
    return spark.range(0, 40_000, 1, 16).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("hot"), rare).alias("text")
    )


def _plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def test_a_hot_word_is_split(spark, eager_skew_handling):
    weights = W.tf_idf(_docs(spark), "doc_id", stop_words=["none"])
    rows = weights.collect()
    assert "skew=true" in _plan(weights)
    assert len(rows) == 40_000 + 13_334
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc"], []).append(r["weight"])
    assert all(abs(sum(w * w for w in ws) - 1) < 1e-9 for ws in by_doc.values())


def test_a_hot_site_is_counted_in_parts(spark):
    docs = _docs(spark).withColumn("site", F.when(F.col("doc_id") % 2 == 0, "big").otherwise("other"))
    counts = W.ordered_word_counts(docs, "site", "doc_id")
    plan = _plan(counts)
    assert "partial_sum" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    top = W.top_words(counts, "site", 2)
    assert "WindowGroupLimit" in _plan(top) and "Partial" in _plan(top)
    assert {(r["site"], r["word"], r["n"]) for r in top.collect() if r["rank"] == 1} == {
        ("big", "hot", 20_000), ("other", "hot", 20_000)
    }


def test_top_words_of_a_hot_cluster_are_cut_before_the_shuffle(spark):
    weights = spark.range(5000).select(
        F.col("id").alias("doc"), F.concat(F.lit("w"), "id").alias("word"), (F.col("id") + 1.0).alias("weight")
    )
    labels = weights.select("doc", F.when(F.col("doc") % 3 == 0, 1).otherwise(0).alias("cluster"))
    top = C.top_cluster_words(weights, labels, 3)
    assert "WindowGroupLimit" in _plan(top)
    assert {r["word"] for r in top.collect()} == {"w4999", "w4997", "w4996", "w4998", "w4995", "w4992"}


@pytest.mark.parametrize("limit", [0, 1, 3, 100])
def test_frequent_keys_meet_without_a_shuffle(spark, limit):
    rows = spark.range(200).select(F.col("id").alias("doc"), F.concat(F.lit("w"), F.floor(F.sqrt("id")).cast("string")).alias("word"))
    rows = rows.union(spark.createDataFrame([(1, "x" * 100), (2, "x" * 100), (3, "absent")], "doc bigint, word string"))
    summary = rows.filter("word <> 'absent'").groupBy("word").agg(F.count("*").alias("df"))
    often, n, others = frequent_keys(summary, "word", "df", limit)
    assert n == summary.filter(often).count() <= limit and n + others == summary.count()
    joined = join_frequent(rows, summary, "word", "df", spread="doc", limit=limit)
    assert sorted(joined.select("doc", "word", "df").collect()) == sorted(rows.join(summary, "word").select("doc", "word", "df").collect())
    if n:
        rest = summary.filter(often).agg(F.min("df")).scalar()
        assert summary.filter(~often & (F.length("word") < 64)).filter(F.col("df") > rest).isEmpty()
