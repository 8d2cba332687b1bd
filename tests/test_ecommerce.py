import pytest
from pyspark.sql import functions as F

from webtables.functions import ecommerce as E, html as H

CASES = [
    ("<img src='https://x.demandware.net/a.png'>", ["Demandware"]),
    ("<!-- <img src='demandware'> --><script>'<img src=demandware>'</script>", []),
    ("<img alt='demandware'><a src='demandware'>", []),
    ("<script type='text/x-magento-init'><div class=minicart></script>", ["Magento"]),
    ("<script type='text/X-magento-init'></script>", []),
    ("<span class='x nosto_cart'>", ["nosto"]),
    ("<span class='nosto_cart2'><div class=nosto_cart>", []),
    ("<LINK REL='stylesheet preload' HREF='//cdn.shopify.com/a.css'>", ["Shopify"]),
    ("<link rel=icon href='//cdn.shopify.com/a.css'>", []),
    ("<div class='a sitecore-link-wrapper'>", ["Sitecore Experience Commerce"]),
    ("<div class='sitecore-link-wrapper-2'>", []),
    ("<script>SITECORE_APIKEY</script>", ["Sitecore Experience Commerce"]),
    ("<link rel=preconnect href=https://images.squarespace-cdn.com>", ["Squarespace"]),
    ("<link rel=preconnect href=https://images.squarespace-cdn.com/>", []),
    ("<meta name='generator' content='Wix.com Website Builder'>", ["Wix Stores"]),
    ("<script src='https://static.parastorage.com/x'></script>", []),
    ("<style type='text/css' id='woocommerce-inline-inline-css'></style>", ["WooCommerce"]),
    ("<style id='woocommerce-inline-inline-css'></style>", []),
    ("<style type=text/css id=woocommerce-inline-inline-css></style><span class=nosto_cart>"
     "<img src=demandware>", ["Demandware", "nosto", "WooCommerce"]),
    ("", []),
]


@pytest.mark.parametrize("page, wanted", CASES)
def test_cart_software(one, page, wanted):
    assert one(page, lambda x: E.cart_software(H.tag_array(x), x)) == wanted


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<p>AddToCart</p>", True),
        ("<a href='/payment'>x</a>", True),
        ("<a href='/Payment'>x</a>", False),
        ("<a>payment</a>", False),
        ("<li class='a my-payment'>x</li>", True),
        ("<div class='payment'>x</div>", False),
        ("", False),
    ],
)
def test_has_card(one, page, wanted):
    assert one(page, lambda x: E.has_card(H.tag_array(x), x)) is wanted


def test_payment_systems_in_fixed_order(one):
    assert one("KLARNA, Visa and apple pay, ApplePay", E.payment_systems) == ["visa", "applepay", "klarna"]


def test_alternative_rules(spark):
    page = (
        "<script>var Shopify = {};</script><script src=/woocommerce/x.js></script>"
        "<link rel=stylesheet id=woocommerce-x><script src='//static.parastorage.com'></script><p>WIX.com"
    )
    frame = spark.createDataFrame([(page,), ("<p>var Shopify = </p>",)], "html string")
    flags = E.alternative_flags(H.tag_array(F.col("html")), F.col("html"))
    rows = frame.select(*[f.alias(n) for n, f in flags.items()]).collect()
    assert all(rows[0]) and not any(rows[1])


def test_cart_hints(spark):
    page = "<a title='Your Cart'>x</a><a title='x'></a><div class='minicart top' id=a></div><div id=b></div>"
    frame = spark.createDataFrame([(page,)], "html string")
    hints = E.cart_hints(H.tag_array(F.col("html")))
    row = frame.select(*[h.alias(n) for n, h in hints.items()]).first()
    assert row.asDict() == {"cart_titles": ["Your Cart"], "cart_classes": ["minicart"], "div_ids": ["a", "b"]}
