"""Detector results scored against labelled sites.

Tables: ``truth`` (url, actual), ``predictions`` (url, pred), ``errors`` and
``blocked`` (url, error and url). A site labelled ``['?']`` is of unknown truth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webtables.functions import ecommerce, urls
from webtables.operators.pages import with_tags

_NONE = "array<string>"


def _no_labels() -> Column:
    return F.array().cast(_NONE)


def _unknown() -> Column:
    return F.col("actual") == F.array(F.lit("?"))


def detector_table(pages: DataFrame, ordinal: str = "page_id") -> DataFrame:
    """What the detectors find on every captured site: url, pred, has_card, payment_names.

    One row per url: of several captures the one with the highest ordinal counts.
    """
    tags, html = F.col("tags"), F.col("html")
    tagged = with_tags(pages, (*ecommerce.CART_NEEDLES, "payment"))
    found = tagged.select(
        "url",
        F.col(ordinal).alias("_ord"),
        F.struct(
            ecommerce.cart_software(tags, html).alias("pred"),
            ecommerce.has_card(tags, html).alias("has_card"),
            ecommerce.payment_systems(html).alias("payment_names"),
        ).alias("_found"),
    )
    return found.groupBy("url").agg(F.max_by("_found", "_ord").alias("_found")).select("url", "_found.*")


def predictions(pages: DataFrame, ordinal: str = "page_id") -> DataFrame:
    """Cart software found on every captured site: url, pred."""
    return detector_table(pages, ordinal).select("url", "pred")


def error_table(errors: DataFrame, blocked: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One capture error per site, ``robotblock`` overriding any other.

    Of several errors the one with the highest ordinal counts, without an
    ordinal the last in alphabetical order.
    """
    last = F.max("error") if ordinal is None else F.max_by("error", ordinal)
    failed = errors.groupBy("url").agg(last.alias("error"))
    marked = blocked.select("url").distinct().withColumn("_block", F.lit("robotblock"))
    return failed.join(marked, "url", "full_outer").select(
        "url", F.coalesce("_block", "error").alias("error")
    )


def site_scores(truth: DataFrame, found: DataFrame, errors: DataFrame) -> DataFrame:
    """``results`` and ``card_table`` of labelled sites in one table.

    ``found`` is a detector table, so that its pages are read once.
    """
    joined = truth.join(found, "url", "left").join(errors, "url", "left")
    names = [*_result_columns(), *_card_columns()]
    return joined.select(*names)


def results(truth: DataFrame, pred: DataFrame, errors: DataFrame) -> DataFrame:
    """Labelled sites with prediction, match flags and error.

    ``correct`` wants the same labels in the same order, ``partial`` any label
    in common; both are null where the truth is unknown.
    """
    joined = truth.join(pred, "url", "left").join(errors, "url", "left")
    return joined.select(*_result_columns())


def _result_columns() -> list[Column]:
    guess = F.coalesce("pred", _no_labels())
    return [
        urls.short_name(F.col("url")).alias("name"),
        "url",
        "actual",
        guess.alias("pred"),
        F.when(~_unknown(), F.col("actual") == guess).alias("correct"),
        F.when(~_unknown(), F.arrays_overlap("actual", guess)).alias("partial"),
        F.coalesce("error", F.lit("")).alias("error"),
    ]


def _card_columns() -> list[Column]:
    usable = F.col("error").isNull()
    return [
        F.coalesce(F.when(usable, F.col("has_card")), F.lit(False)).alias("has_card"),
        F.coalesce(F.when(usable, F.col("payment_names")), _no_labels()).alias("payment_names"),
    ]


def label_vocabulary(truth: DataFrame) -> DataFrame:
    return truth.select(F.explode("actual").alias("label")).distinct()


def label_performance(table: DataFrame) -> DataFrame:
    """Per true label: sites labelled with it, true and false positives."""
    in_truth = F.array_contains("actual", F.col("label"))
    in_pred = F.array_contains("pred", F.col("label"))
    return (
        table.select(
            "actual",
            "pred",
            F.explode(F.array_distinct(F.concat("actual", "pred"))).alias("label"),
        )
        .groupBy("label")
        .agg(
            F.count_if(in_truth).alias("labelled"),
            F.count_if(in_truth & in_pred).alias("true_pos"),
            F.count_if(~in_truth & in_pred).alias("false_pos"),
        )
        .filter(F.col("labelled") > 0)
    )


def supported_labels(performance: DataFrame, more_than: int = 1) -> DataFrame:
    return performance.filter(F.col("labelled") > more_than)


def with_label(table: DataFrame, label: str, where: str = "either") -> DataFrame:
    """Sites whose truth, or with ``either`` whose truth or prediction, has it."""
    hit = F.array_contains("actual", label)
    if where == "either":
        hit = hit | F.array_contains("pred", label)
    return table.filter(hit)


def without_errors(table: DataFrame, errors: DataFrame) -> DataFrame:
    return table.join(errors.select("url"), "url", "left_anti")


def recheck_list(truth: DataFrame) -> DataFrame:
    """Names of the sites of unknown truth."""
    return truth.filter(_unknown()).select("url", urls.short_name(F.col("url")).alias("name"))


def card_table(sites: DataFrame, found: DataFrame, errors: DataFrame) -> DataFrame:
    """Card support and payment names per site, none for sites with an error."""
    joined = sites.select("url").join(found, "url", "left").join(errors, "url", "left")
    return joined.select(urls.short_name(F.col("url")).alias("name"), "url", *_card_columns())


def with_card(card: DataFrame) -> DataFrame:
    return card.filter("has_card")


def nothing_detected(joined: DataFrame) -> DataFrame:
    return joined.filter(
        (F.size("pred") == 0) & ~F.col("has_card") & (F.size("payment_names") == 0)
    )


def with_error(table: DataFrame) -> DataFrame:
    return table.filter(F.col("error") != "")


def evidence_counts(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """Number of pages that show each sign of card support, sites with an error apart."""
    signs = ecommerce.card_evidence(F.col("tags"), F.col("html"))
    flags = with_tags(pages, ("payment",)).select("url", *[s.alias(name) for name, s in signs.items()])
    # The pages themselves stay where they are; only their flags meet the errors.
    usable = flags.join(errors.select("url"), "url", "left_anti")
    return usable.agg(*[F.count_if(F.col(name)).alias(name) for name in signs])
