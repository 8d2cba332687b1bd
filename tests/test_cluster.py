import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webtables.operators import cluster as C, packed, words as W
from webtables.plans.jobs import clustered_websites

THEMES = ["red green blue", "cat dog bird", "one two three"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join([THEMES[i % 3]] * (i % 4 + 1)) + f" w{i}") for i in range(30)] + [(99, "!")]
    return spark.createDataFrame(rows, "doc bigint, text string")


@pytest.fixture(scope="module")
def weights(docs):
    return W.tf_idf(docs, "doc", stop_words=["none"]).persist()


@pytest.mark.parametrize("k", [0, -1, 128])
def test_number_of_clusters_is_checked(docs, weights, k):
    with pytest.raises(ValueError, match="between 1 and 127"):
        C.cluster_documents(weights, docs, k, seed=1)


def test_every_document_is_at_its_nearest_centre(docs, weights):
    labels = {r["doc"]: r["cluster"] for r in C.cluster_documents(weights, docs, 3, seed=777).collect()}
    assert set(labels) == {*range(30), 99}
    words = sorted({r["word"] for r in weights.collect()})
    vectors = {d: np.zeros(len(words)) for d in labels}
    for r in weights.collect():
        vectors[r["doc"]][words.index(r["word"])] = r["weight"]
    used = sorted(set(labels.values()))
    centres = {c: np.mean([vectors[d] for d in labels if labels[d] == c], axis=0) for c in used}
    for d, c in labels.items():
        costs = {u: ((vectors[d] - centres[u]) ** 2).sum() for u in used}
        assert costs[c] <= min(costs.values()) + 1e-8


@pytest.mark.parametrize("head", [3, 60, 1 << 21])
def test_labels_do_not_depend_on_how_words_are_met(docs, weights, head, monkeypatch):
    # Frequent words by broadcast, others by join, words of one document alone: as a plain Lloyd's walk.
    monkeypatch.setattr(C, "HEAD_VALUES", head)
    labels = {r["doc"]: r["cluster"] for r in C.cluster_documents(weights, docs, 3, seed=777).collect()}
    words = sorted({r["word"] for r in weights.collect()})
    vectors = {d: np.zeros(len(words)) for d in labels}
    for r in weights.collect():
        vectors[r["doc"]][words.index(r["word"])] = r["weight"]
    order = [F.xxhash64(F.lit(777), "doc"), F.col("doc")]
    first = [r["doc"] for r in weights.select("doc").distinct().orderBy(*order).limit(3).collect()]
    centres, known = {i: vectors[d] for i, d in enumerate(first)}, {d: i for i, d in enumerate(first)}
    while True:
        new = {}
        for d in labels:
            costs = [((centres[c]) ** 2).sum() - 2 * vectors[d] @ centres[c] if c in centres else np.inf for c in range(3)]
            near = [c for c in range(3) if costs[c] <= min(costs) + 1e-9]
            new[d] = known[d] if known.get(d) in near else near[0]
        if new == known:
            break
        known = new
        centres = {c: np.mean([vectors[d] for d in known if known[d] == c], axis=0) for c in set(known.values())}
    assert labels == known


def test_weights_stay_in_their_buckets(spark, docs, weights, folder):
    # A step joins them with the moved documents without shuffling them.
    entries = weights.groupBy(F.col("doc").alias("row")).agg(F.collect_list("weight").alias("head"))
    name = C._bucketed(entries, "row", f"{folder}/vectors")
    moved = docs.select(F.col("doc").alias("row"))
    joined = spark.table(name).join(moved.hint("shuffle_hash"), "row")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {name}")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def _local_files(spark):
    """Files of shuffles and broadcasts in the session's local folders."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {blocks.apply(i).getName() for i in range(blocks.size())}


def test_steps_leave_nothing_on_disk_but_the_labels(spark, docs, weights):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    weights.count()
    before, tables = _local_files(spark), set(shared.iterdir())
    labels = C.cluster_documents(weights, docs, 3, seed=777)
    for _ in range(40):  # files are deleted in the background
        kept = sorted(name for name in _local_files(spark) - before if name.startswith("shuffle"))
        if not kept:
            break
        time.sleep(0.25)
    assert not kept
    left = [path for table in set(shared.iterdir()) - tables for path in table.rglob("part-*.parquet")]
    # The words' counts and their words, the lengths and the labels; no vectors and no labels of earlier steps.
    assert len({path.parent for path in left}) == 3
    assert labels.count() == docs.count()


@pytest.mark.parametrize("head", [3, 60, 1 << 21])
def test_labels_of_weights_in_parts(docs, weights, head, monkeypatch):
    monkeypatch.setattr(C, "HEAD_VALUES", head)
    parts = W.tf_idf(docs, "doc", stop_words=["none"], parts=True)
    rows = {(r["doc"], r["word"]): r["weight"] for r in weights.collect()}
    assert {(r["doc"], r["word"]): r["weight"] for r in parts.rows().collect()} == pytest.approx(rows, abs=1e-12)
    labels = C.cluster_documents(parts, docs, 3, seed=777)
    assert sorted(labels.collect()) == sorted(C.cluster_documents(weights, docs, 3, seed=777).collect())
    placed = {(r["doc"], r["cluster"]) for r in parts.rows(labels).collect()}
    assert placed == {(r["doc"], r["cluster"]) for r in labels.collect() if r["doc"] != 99}


def test_words_of_documents_are_not_dealt_out_one_by_one(docs):
    # Frequent words' rows meet factors by broadcast, and a document's words its label in one row.
    parts = W.tf_idf(docs, "doc", stop_words=["none"], parts=True)
    plan = parts.rows(docs.select("doc", F.lit(0).alias("cluster")))._jdf.queryExecution().executedPlan().toString()
    laid = [line for line in plan.splitlines() if "Exchange hashpartitioning(word" in line]
    assert not laid and "BroadcastHashJoin [word" in plan


def test_document_without_id_is_labelled(spark, docs, weights):
    every = docs.select("doc").union(spark.createDataFrame([(None,)], "doc bigint"))
    labels = {r["doc"]: r["cluster"] for r in C.cluster_documents(weights, every, 3, seed=777).collect()}
    assert len(labels) == 32 and labels[None] == labels[99]


def test_packed_words_come_back(spark):
    rows = [(1, [("b", 2), ("a", 1), ("z", 5)]), (2, []), (3, None), (4, [("c", 70_000), ("b", 1)])]
    counts = spark.createDataFrame(rows, "doc bigint, counts array<struct<word:string,n:bigint>>").repartition(1)
    head = spark.sparkContext.broadcast(pa.array(["a", "b", "c"]))
    back = packed.unpacked(packed.packed(counts, head), counts, head)
    assert sorted(back.collect()) == [(1, "a", 1), (1, "b", 2), (4, "b", 1), (4, "c", 70_000)]


def test_same_seed_same_labels(docs, weights):
    first = sorted(C.cluster_documents(weights, docs, 3, seed=777).collect())
    assert first == sorted(C.cluster_documents(weights, docs, 3, seed=777).collect())
    assert {r["cluster"] for r in first} <= {0, 1, 2}


def test_fewer_documents_than_clusters(docs, weights):
    few = docs.filter("doc < 2")
    labels = C.cluster_documents(weights.join(few.select("doc"), "doc"), few, 5, seed=1).collect()
    assert len({r["cluster"] for r in labels}) == len(labels) == 2


def test_words_of_given_clusters(spark):
    weights = spark.createDataFrame(
        [("a", "x", 0.6), ("a", "y", 0.2), ("b", "x", 0.2), ("c", "z", 1.0)], "doc string, word string, weight double"
    )
    labels = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "doc string, cluster int")
    assert sorted(C.cluster_sizes(labels).collect()) == [(0, 2), (1, 1)]
    shares = {(r["cluster"], r["word"]): round(r["weight"], 9) for r in C.cluster_words(weights, labels).collect()}
    assert shares == {(0, "x"): 0.8, (0, "y"): 0.2, (1, "z"): 1.0}
    top = C.top_cluster_words(weights, labels, 1).collect()
    assert {(r["cluster"], r["word"], r["rank"]) for r in top} == {(0, "x", 1), (1, "z", 1)}


def test_stored_labels_are_read_again(spark, folder):
    texts = spark.createDataFrame(
        [(i, f"https://s{i % 6}.nz/p", THEMES[i % 3]) for i in range(12)], "page_id bigint, url string, text string"
    )
    labels, top = clustered_websites(texts, 3, 777, stored=f"{folder}/labels", stop_words=["none"])
    assert labels.count() == 6 and top.count() > 0
    again, _ = clustered_websites(texts, 3, 777, stored=f"{folder}/labels", stop_words=["none"])
    assert sorted(again.collect()) == sorted(labels.collect())


def test_stored_table_is_rebuilt_for_other_input_or_parameters(spark, folder):
    from webtables.sources.tables import load_or_build

    built = []

    def build(frame):
        def make():
            built.append(1)
            return frame

        return make

    first = spark.createDataFrame([(1, "a")], "doc long, word string")
    other = spark.createDataFrame([(2, "b")], "doc long, word string")
    path = f"{folder}/stored"
    assert load_or_build(spark, path, build(first), first, {"k": 3}).collect() == first.collect()
    assert load_or_build(spark, path, build(first), first, {"k": 3}).collect() == first.collect()
    assert len(built) == 1  # the same input and parameters: read
    assert load_or_build(spark, path, build(first), first, {"k": 4}).count() == 1 and len(built) == 2
    assert load_or_build(spark, path, build(other), other, {"k": 4}).collect() == other.collect()
    assert len(built) == 3  # another input: built again
