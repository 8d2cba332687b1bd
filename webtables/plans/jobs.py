"""The four whole jobs: crawl roll-up, clustering, topics, detector scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from webtables.operators import cluster, evaluate, pages as P, rollup, topics as K, words
from webtables.sources.tables import load_or_build


def website_table(
    pages: DataFrame, seeds: DataFrame, fetch_log: DataFrame | None = None, limit: int = 10_000
) -> DataFrame:
    """Pages to one grouped row per seed."""
    records = P.page_records(pages, fetch_log)
    sites = rollup.site_table(records, rollup.FIELDS, limit=limit)
    expected = [c for c in records.columns if c not in ("page_id", "page_type")]
    return rollup.group_fields(rollup.align_to_seeds(sites, seeds), expected)


def clustered_websites(
    texts: DataFrame, k: int, seed: int, stored: str | None = None, stop_words: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Cluster labels and each cluster's heaviest words, from url and text.

    Labels are read from ``stored`` if they are there, else kept there.
    """
    cluster.check_clusters(k)
    sites = words.with_netloc(texts)
    weights = words.tf_idf(sites, "netloc", stop_words=stop_words)

    def build() -> DataFrame:
        docs = sites.select(F.col("netloc").alias("doc")).distinct()
        return cluster.cluster_documents(weights, docs, k, seed)

    parameters = {"k": k, "seed": seed, "stop_words": sorted(stop_words or [])}
    labels = build() if stored is None else load_or_build(texts.sparkSession, stored, build, texts, parameters)
    return labels, cluster.top_cluster_words(weights, labels)


def website_topics(
    texts: DataFrame, topics: DataFrame, stop_words: Sequence[str] | None = None, n: int = 5
) -> DataFrame:
    """Topics of every website, from url and text."""
    sites = words.with_netloc(texts)
    counts = words.ordered_word_counts(sites, "netloc", "page_id")
    ranked = words.top_words(words.without_stop_words(counts, stop_words), "netloc", n)
    return K.site_topics(words.keyword_lists(ranked, "netloc"), topics, "netloc")


def detector_scores(
    pages: DataFrame, truth: DataFrame, errors: DataFrame, blocked: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results per site, performance per label, results joined with card signs."""
    failed = evaluate.error_table(errors, blocked)
    both = evaluate.site_scores(truth, evaluate.detector_table(pages), failed)
    table = both.drop("has_card", "payment_names")
    return table, evaluate.label_performance(table), both
