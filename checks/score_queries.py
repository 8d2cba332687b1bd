"""Queries that score the shop detectors against labelled sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks import inputs
from checks.html_sql import html_ctes
from checks.inputs import NETLOC
from checks.page_queries import joined, sql_joined
from checks.registry import query
from webtables.operators import evaluate as E

_NAME = f"""(SELECT CASE WHEN mark IS NULL THEN host WHEN mark = 1 THEN parts[-1] ELSE parts[mark - 1] END
    FROM (SELECT *, coalesce(list_position(parts, 'co'), list_position(parts, 'com'), list_position(parts, 'org'),
                             list_position(parts, 'nz')) AS mark
          FROM (SELECT {NETLOC.format("url")} AS host, string_split({NETLOC.format("url")}, '.') AS parts)))"""

SCORES = {
    **html_ctes("sites"),
    "failed": """
        SELECT url, CASE WHEN b.url IS NOT NULL THEN 'robotblock' ELSE error END AS error
        FROM (SELECT url, arg_max(error, ord) AS error FROM errors GROUP BY url)
        FULL OUTER JOIN (SELECT DISTINCT url FROM blocked) b USING (url)""",
    "last_carts": "SELECT * FROM carts QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1",
    "scored": f"""
        SELECT {_NAME} AS name, url, actual, coalesce(cart_software, []) AS pred,
               CASE WHEN actual <> ['?'] THEN actual = coalesce(cart_software, []) END AS correct,
               CASE WHEN actual <> ['?'] THEN list_has_any(actual, coalesce(cart_software, [])) END AS partial,
               coalesce(error, '') AS error
        FROM truth LEFT JOIN (SELECT url, cart_software FROM last_carts) USING (url) LEFT JOIN failed USING (url)""",
    "vocabulary": "SELECT DISTINCT unnest(actual) AS label FROM truth",
    "performance": """
        SELECT label, count(*) FILTER (list_contains(actual, label)) AS labelled,
               count(*) FILTER (list_contains(actual, label) AND list_contains(pred, label)) AS true_pos,
               count(*) FILTER (NOT list_contains(actual, label) AND list_contains(pred, label)) AS false_pos
        FROM vocabulary, scored GROUP BY label""",
    "card": f"""
        SELECT {_NAME} AS name, url, coalesce(CASE WHEN error IS NULL THEN has_card END, false) AS has_card,
               coalesce(CASE WHEN error IS NULL THEN payment_systems END, []) AS payment_names
        FROM truth LEFT JOIN (SELECT url, has_card, payment_systems FROM last_carts) USING (url)
        LEFT JOIN failed USING (url)""",
    "both_tables": "SELECT * FROM scored JOIN card USING (name, url)",
}
_RESULT = f"name, url, {sql_joined('actual')} AS actual, {sql_joined('pred')} AS pred, correct, partial, error"
_CARD = f"name, url, has_card, {sql_joined('payment_names')} AS payment_names"
_BOTH = f"{_RESULT}, has_card, {sql_joined('payment_names')} AS payment_names"


def _flat(table: DataFrame) -> DataFrame:
    lists = [c for c in ("actual", "pred", "payment_names") if c in table.columns]
    return table.withColumns({c: joined(c) for c in lists})


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return E.error_table(inputs.errors(spark, sf), inputs.blocked(spark, sf), "ord")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    pred = E.predictions(inputs.captured_sites(spark, sf))
    return E.results(inputs.truth(spark, sf), pred, _errors(spark, sf))


def _card(spark: SparkSession, sf: str) -> DataFrame:
    found = E.detector_table(inputs.captured_sites(spark, sf))
    return E.card_table(inputs.truth(spark, sf), found, _errors(spark, sf))


def _both(spark: SparkSession, sf: str) -> DataFrame:
    found = E.detector_table(inputs.captured_sites(spark, sf))
    return E.site_scores(inputs.truth(spark, sf), found, _errors(spark, sf))


@query("predictions", f"SELECT url, {sql_joined('cart_software')} AS pred FROM last_carts", SCORES)
def _(spark, sf):
    return _flat(E.predictions(inputs.captured_sites(spark, sf)))


@query("error_table", "SELECT url, error FROM failed", SCORES)
def _(spark, sf):
    return _errors(spark, sf)


@query("result_table", f"SELECT {_RESULT} FROM scored", SCORES)
def _(spark, sf):
    return _flat(_results(spark, sf))


@query("exact_matches", "SELECT url, correct FROM scored", SCORES)
def _(spark, sf):
    return _results(spark, sf).select("url", "correct")


@query("partial_matches", "SELECT url, partial FROM scored", SCORES)
def _(spark, sf):
    return _results(spark, sf).select("url", "partial")


@query("label_vocabulary", "SELECT label FROM vocabulary", SCORES)
def _(spark, sf):
    return E.label_vocabulary(inputs.truth(spark, sf)).orderBy("label")


@query("label_performance", "SELECT * FROM performance", SCORES)
def _(spark, sf):
    return E.label_performance(_results(spark, sf))


@query("supported_labels", "SELECT * FROM performance WHERE labelled > 1", SCORES)
def _(spark, sf):
    return E.supported_labels(E.label_performance(_results(spark, sf)))


@query(
    "sites_with_label",
    f"SELECT {_RESULT} FROM scored WHERE list_contains(actual, 'Demandware') OR list_contains(pred, 'Demandware')",
    SCORES,
)
def _(spark, sf):
    return _flat(E.with_label(_results(spark, sf), "Demandware"))


@query(
    "usable_custom_sites",
    f"SELECT {_RESULT} FROM scored WHERE list_contains(actual, 'custom') AND error = ''",
    SCORES,
)
def _(spark, sf):
    custom = E.with_label(_results(spark, sf), "custom", where="truth")
    return _flat(E.without_errors(custom, _errors(spark, sf)))


@query("recheck_list", "SELECT url, name FROM scored WHERE actual = ['?']", SCORES)
def _(spark, sf):
    return E.recheck_list(inputs.truth(spark, sf))


@query("card_table", f"SELECT {_CARD} FROM card", SCORES)
def _(spark, sf):
    return _flat(_card(spark, sf))


@query("sites_with_card", f"SELECT {_CARD} FROM card WHERE has_card", SCORES)
def _(spark, sf):
    return _flat(E.with_card(_card(spark, sf)))


@query("results_with_card", f"SELECT {_BOTH} FROM both_tables", SCORES)
def _(spark, sf):
    return _flat(_both(spark, sf))


@query(
    "nothing_detected",
    f"SELECT {_BOTH} FROM both_tables WHERE len(pred) = 0 AND NOT has_card AND len(payment_names) = 0",
    SCORES,
)
def _(spark, sf):
    return _flat(E.nothing_detected(_both(spark, sf)))


@query("sites_with_error", f"SELECT {_BOTH} FROM both_tables WHERE error <> ''", SCORES)
def _(spark, sf):
    return _flat(E.with_error(_both(spark, sf)))
