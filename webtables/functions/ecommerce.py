"""Shop detectors as conditions on a page's tag array and raw HTML.

Each one is an expression on the row's own columns, so detecting costs no
shuffle. ``CART_NEEDLES`` are texts without which no cart rule can hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from webtables.functions.binding import let
from webtables.functions.html import attr, has_token, script_bodies, tokens_of

# Payment names looked for, in reporting order.
PAYMENT_NAMES = (
    "visa", "mastercard", "amex", "applepay", "afterpay", "zippay", "alipay", "klarna",
)

# Texts the cart rules below look for.
CART_NEEDLES = (
    "demandware",
    "text/x-magento-init",
    "nosto_cart",
    "shopify",
    "sitecore-link-wrapper",
    "https://images.squarespace-cdn.com",
    "Wix.com Website Builder",
    "woocommerce-inline-inline-css",
)


def any_tag(tags: Column, name: str, condition: Callable[[Column], Column]) -> Column:
    return F.exists(
        tags, lambda t: (t["tag"] == name) & F.coalesce(condition(t), F.lit(False))
    )


def cart_flags(tags: Column, html: Column) -> dict[str, Column]:
    """One condition per cart software, in reporting order."""
    return {
        "Demandware": any_tag(tags, "img", lambda t: attr(t, "src").contains("demandware")),
        "Magento": any_tag(tags, "script", lambda t: attr(t, "type") == "text/x-magento-init"),
        "nosto": any_tag(tags, "span", lambda t: has_token(t, "class", "nosto_cart")),
        "Shopify": any_tag(
            tags,
            "link",
            lambda t: has_token(t, "rel", "stylesheet") & attr(t, "href").contains("shopify"),
        ),
        "Sitecore Experience Commerce": html.contains("SITECORE_APIKEY")
        | any_tag(
            tags,
            "div",
            lambda t: has_token(t, "class", "sitecore-link-wrapper"),
        ),
        "Squarespace": any_tag(
            tags,
            "link",
            lambda t: has_token(t, "rel", "preconnect")
            & (attr(t, "href") == "https://images.squarespace-cdn.com"),
        ),
        "Wix Stores": any_tag(
            tags,
            "meta",
            lambda t: (attr(t, "name") == "generator")
            & (attr(t, "content") == "Wix.com Website Builder"),
        ),
        "WooCommerce": any_tag(
            tags,
            "style",
            lambda t: (attr(t, "id") == "woocommerce-inline-inline-css")
            & (attr(t, "type") == "text/css"),
        ),
    }


def cart_software(tags: Column, html: Column) -> Column:
    """Names of the cart software found, in reporting order."""
    found = [F.when(flag, F.lit(name)) for name, flag in cart_flags(tags, html).items()]
    return F.array_compact(F.array(*found))


def card_evidence(tags: Column, html: Column) -> dict[str, Column]:
    """The three signs that a page takes cards."""
    return {
        "add_to_cart": F.lower(html).contains("addtocart"),
        "payment_link": any_tag(tags, "a", lambda t: attr(t, "href").contains("payment")),
        "payment_item": any_tag(
            tags,
            "li",
            lambda t: F.exists(tokens_of(attr(t, "class")), lambda c: c.contains("payment")),
        ),
    }


def has_card(tags: Column, html: Column) -> Column:
    signs = card_evidence(tags, html)
    return signs["add_to_cart"] | signs["payment_link"] | signs["payment_item"]


def payment_systems(html: Column) -> Column:
    """Payment names that occur in the page in any letter case."""

    def found(lowered: Column) -> Column:
        return F.array(*[F.when(lowered.contains(name), F.lit(name)) for name in PAYMENT_NAMES])

    return F.array_compact(let(F.lower(html), found))


def alternative_flags(tags: Column, html: Column) -> dict[str, Column]:
    """Other conditions for some of the cart software, to compare rules with."""
    return {
        "shopify_script": F.exists(script_bodies(html), lambda b: b.contains("var Shopify =")),
        "woocommerce_script": any_tag(
            tags, "script", lambda t: attr(t, "src").contains("woocommerce")
        ),
        "woocommerce_link": any_tag(
            tags,
            "link",
            lambda t: has_token(t, "rel", "stylesheet") & attr(t, "id").contains("woocommerce"),
        ),
        "wix_script": any_tag(
            tags, "script", lambda t: attr(t, "src").contains("static.parastorage.com")
        ),
        "wix_text": F.lower(html).contains("wix.com"),
    }


def cart_hints(tags: Column) -> dict[str, Column]:
    """Link titles and class parts that mention a cart, and all div ids."""
    links = F.filter(tags, lambda t: t["tag"] == "a")
    divs = F.filter(tags, lambda t: t["tag"] == "div")
    titles = F.transform(links, lambda t: attr(t, "title"))
    classes = F.flatten(
        F.transform(divs, lambda t: F.coalesce(tokens_of(attr(t, "class")), F.array().cast("array<string>")))
    )
    return {
        "cart_titles": F.filter(titles, lambda v: F.lower(v).contains("cart")),
        "cart_classes": F.filter(classes, lambda c: c.contains("cart")),
        "div_ids": F.array_compact(F.transform(divs, lambda t: attr(t, "id"))),
    }
