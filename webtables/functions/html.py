"""HTML column functions.

A page is read with regular expressions inside the row that holds it, so no
function here shuffles. Quantifiers are possessive: matching takes linear time
and no stack, however long a tag is.

Names and attributes follow the HTML syntax, not its tree repair: depths count
start and end tags as written.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from webtables.functions import entities
from webtables.functions.binding import let

_SPACE = r"[ \t\n\f\r]"
# What may stand between a tag's name and its ">", closing slashes apart.
_INSIDE = r"""(?:/*+(?:[^>"'/]++|"[^"]*+"|'[^']*+'))*+"""
_AFTER_NAME = rf"(?:(?=[ \t\n\f\r/]){_INSIDE})?+"

_START_TAG = rf"""<([a-zA-Z][^ \t\n\f\r/>"']*+)({_INSIDE}/*+)>"""
_BARE_TAG = r"^<[a-zA-Z0-9]++/?+>$"
_ANY_TAG = rf"""</?[a-zA-Z]{_INSIDE}/*+>|<[!?/][^>]*+>"""
_ATTRIBUTE = (
    rf"""([^ \t\n\f\r"'>/=]++)(?:{_SPACE}*+={_SPACE}*+("[^"]*+"|'[^']*+'|[^ \t\n\f\r"'>]++))?+"""
)
_COMMENT = r"<!--.*?(?:-->|\z)"
_EMPTY_RAW = rf"<(?:script|style){_AFTER_NAME}/++>"
_SCRIPT = rf"(<script{_AFTER_NAME}>)(.*?)(?:</script[^>]*+>|\z)"
_STYLE = rf"(<style{_AFTER_NAME}>)(.*?)(?:</style[^>]*+>|\z)"
# The look-ahead passes over most of the page at one comparison per character.
_BLANKED = rf"(?is)(?=<[!s])(?:{_COMMENT}|({_EMPTY_RAW})|{_SCRIPT}|{_STYLE})"
_NO_COMMENTS = rf"(?is)(?=<[!s])(?:{_COMMENT}|({_EMPTY_RAW}|{_SCRIPT}|{_STYLE}))"
_TOKEN = rf"(?is){_EMPTY_RAW}|{_SCRIPT}|{_STYLE}|{_ANY_TAG}|[^<]++|<"
_FOOTER_TAG = rf"</?footer{_AFTER_NAME}>"
_FOOTER_PIECE = (
    rf"(?is){_EMPTY_RAW}|{_SCRIPT}|{_STYLE}|{_FOOTER_TAG}|(?:(?!</?footer|<script|<style).)++|<"
)
_TITLE = rf"(?is)<title{_AFTER_NAME}>([^<]+)"

# A start tag of <a>, and all up to its end or the next link.
_LINK = rf"(?is)<a((?=[ \t\n\f\r/]){_INSIDE}/*+)>((?:(?!</?a[ \t\n\f\r/>]).)*+)"
_PLAIN_TOKEN = rf"{_ANY_TAG}|[^<]++|<"
# Scripts and styles have lost their ends with their bodies.
_VOID = (
    r"(?i)^<(?:area|base|br|col|embed|hr|img|input|link|meta|script|source|style|track|wbr)[ \t\n\f\r/>]"
    r"|/>$|^<[!?]"
)

_MULTI_VALUED = ("class", "rel")
# Names of references to what looked-for texts are made of besides letters.
_SPELLED = ("&colon;", "&period;", "&sol;", "&lowbar;", "&UnderBar;", "&comma;")


def blank_raw_text(html: Column) -> Column:
    """Drop comments and the bodies of scripts and styles, keep their tags."""
    return F.regexp_replace(html, _BLANKED, "$1$2$4")


def tag_array(html: Column) -> Column:
    """Start tags that carry attributes, as an array of structs.

    ``pos`` counts every start tag of the page from 0. Tag and attribute names
    are lower case, values have their quotes off and references decoded.
    """
    return tags_of(blank_raw_text(html))


def tags_of(blanked: Column) -> Column:
    """``tag_array`` of a page whose raw text is blanked already."""
    starts = F.regexp_extract_all(blanked, F.lit(_START_TAG), F.lit(0))

    placed = F.transform(
        starts, lambda s, i: F.struct(i.cast("int").alias("pos"), s.alias("start"))
    )
    # Most tags are bare, and telling so is cheaper than parsing them.
    full = F.filter(placed, lambda t: ~t["start"].rlike(_BARE_TAG))

    def parse(t: Column) -> Column:
        return F.struct(
            t["pos"].alias("pos"),
            F.lower(F.regexp_extract(t["start"], _START_TAG, 1)).alias("tag"),
            _attributes(F.regexp_extract(t["start"], _START_TAG, 2)).alias("attrs"),
        )

    return F.filter(F.transform(full, parse), lambda t: F.size(t["attrs"]) > 0)


def _attributes(inside: Column) -> Column:
    def pairs(text: Column) -> Column:
        return F.zip_with(
            F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(1)),
            F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(2)),
            lambda name, value: F.struct(
                F.lower(name).alias("name"), _unquoted(value).alias("value")
            ),
        )

    return let(inside, pairs)


def _unquoted(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    bare = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return entities.decode(F.coalesce(bare, F.lit("")))


def may_hold(html: Column, needles: Iterable[str]) -> Column:
    """False only if no decoded value of the page can hold one of the texts.

    A decoded value can only hold a text that the raw page holds too, unless
    references to numbers or ASCII characters spell it; pages with those always may.
    """
    wanted = html.contains("&#")
    for name in _SPELLED:
        wanted = wanted | html.contains(name)
    for needle in needles:
        wanted = wanted | html.contains(needle)
    return wanted


def tags_if(wanted: Column, blanked: Column) -> Column:
    """Tags of a blanked page if wanted, else none."""
    return F.when(wanted, tags_of(blanked)).otherwise(
        F.array().cast(
            "array<struct<pos:int,tag:string,attrs:array<struct<name:string,value:string>>>>"
        )
    )


def attr(tag: Column, name: str, keep: str = "last") -> Column:
    """Value of the tag's attribute, null if absent; repeats keep one end."""
    values = F.filter(tag["attrs"], lambda a: a["name"] == name)
    return F.try_element_at(values, F.lit(-1 if keep == "last" else 1))["value"]


def tokens_of(value: Column) -> Column:
    """Blank-separated parts of a class or rel value."""
    return F.filter(F.split(value, rf"{_SPACE}+"), lambda part: part != "")


def has_token(tag: Column, name: str, token: str) -> Column:
    """One part of a multi-valued attribute equals the token."""
    return F.array_contains(tokens_of(attr(tag, name)), token)


def attribute_rows(tag: Column) -> Column:
    """The tag's attributes with class and rel split into one row per part."""

    def rows(a: Column) -> Column:
        parts = tokens_of(a["value"])
        multi = a["name"].isin(*_MULTI_VALUED) & (F.size(parts) > 0)
        return F.when(
            multi,
            F.transform(
                parts, lambda part: F.struct(a["name"].alias("name"), part.alias("value"))
            ),
        ).otherwise(F.array(a))

    return F.flatten(F.transform(tag["attrs"], rows))


def title(html: Column) -> Column:
    """First text of a title element, null when there is none."""
    return title_of(blank_raw_text(html))


def title_of(blanked: Column) -> Column:
    found = F.regexp_extract(blanked, _TITLE, 1)
    return let(found, lambda text: F.when(text != "", entities.decode(text)))


def meta_content(tags: Column, name: str) -> Column:
    """Content of the first meta tag with this name that has a content."""
    contents = F.transform(
        F.filter(tags, lambda t: (t["tag"] == "meta") & (attr(t, "name", "first") == name)),
        lambda t: attr(t, "content", "first"),
    )
    return F.get(F.filter(contents, lambda c: c.isNotNull()), F.lit(0))


def footer_text(html: Column) -> Column:
    """All text inside footers, nested ones and script bodies included, joined.

    The page is cut at the tags of footers and at scripts and styles; a piece
    counts if more footers have begun than ended before it.
    """
    shown = F.regexp_replace(html, _NO_COMMENTS, "$1")
    pieces = F.regexp_extract_all(shown, F.lit(_FOOTER_PIECE), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        is_tag = piece.rlike(f"(?i)^{_FOOTER_TAG}$")
        change = F.when(is_tag, F.when(piece.startswith("</"), -1).otherwise(1)).otherwise(0)
        depth = F.greatest(state["depth"] + change, F.lit(0))
        kept = F.when((depth > 0) & ~is_tag, F.concat(state["kept"], F.array(piece))).otherwise(state["kept"])
        return F.struct(depth.alias("depth"), kept.alias("kept"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
    inside = F.aggregate(pieces, start, step, lambda state: state["kept"])
    texts = F.transform(inside, lambda part: _joined_text(part, raw_bodies=True))
    return F.when(html.rlike("(?i)<footer"), F.array_join(texts, "")).otherwise("")


def _joined_text(html: Column, raw_bodies: bool) -> Column:
    def text(token: Column) -> Column:
        body = F.lit("")
        if raw_bodies:
            body = F.concat(
                F.regexp_extract(token, f"(?is)^{_SCRIPT}$", 2),
                F.regexp_extract(token, f"(?is)^{_STYLE}$", 2),
            )
        return F.when(~token.startswith("<") | (token == "<"), entities.decode(token)).otherwise(
            body
        )

    tokens = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, text), "")


def copyright_lines(html: Column) -> Column:
    """Footer lines that mention a copyright, trimmed."""
    lines = F.split(footer_text(html), "[\n\t\r]")
    kept = F.filter(lines, lambda line: line.rlike("(?i)(©|copyright)"))
    return F.transform(kept, trim_space)


def trim_space(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^[\p{Z}\x09-\x0D\x1C-\x1F\x85]+|[\p{Z}\x09-\x0D\x1C-\x1F\x85]+$", "")


def page_text(html: Column) -> Column:
    """Text of the page without scripts, styles, comments and empty lines."""
    shown = F.regexp_replace(html, _NO_COMMENTS, "$1")
    text = _joined_text(shown, raw_bodies=False)
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: line != ""), "\n")


def phone_numbers(html: Column) -> Column:
    """Distinct numbers of ``tel:`` links, sorted; null for a link without one."""
    may_have = may_hold(html, ["tel:"])
    return F.when(may_have, phones_of(blank_raw_text(html))).otherwise(
        F.array().cast("array<string>")
    )


def _own_text(inside: Column) -> Column:
    """The first text outside all nested elements, however deep they go."""
    tokens = F.regexp_extract_all(inside, F.lit(_PLAIN_TOKEN), F.lit(0))

    def step(state: Column, token: Column) -> Column:
        is_text = ~token.startswith("<") | (token == "<")
        change = F.when(is_text | token.rlike(_VOID), 0).when(token.startswith("</"), -1).otherwise(1)
        own = F.when(is_text & (state["depth"] == 0), token)
        return F.struct(
            F.greatest(state["depth"] + change, F.lit(0)).alias("depth"),
            F.coalesce(state["text"], own).alias("text"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("text"))
    return F.aggregate(tokens, start, step, lambda state: state["text"])


def phones_of(blanked: Column) -> Column:
    links = F.regexp_extract_all(blanked, F.lit(_LINK), F.lit(0))

    def number(link: Column) -> Column:
        hrefs = F.filter(
            _attributes(F.regexp_extract(link, _LINK, 1)), lambda a: a["name"] == "href"
        )
        text = let(_own_text(F.regexp_extract(link, _LINK, 2)), lambda t: entities.decode(t))

        def found(href: Column) -> Column:
            value = F.when(F.length(href) > 4, F.substring(href, 5, 2**31 - 1)).otherwise(text)
            return F.struct(href.startswith("tel:").alias("is_tel"), value.alias("value"))

        return let(F.get(hrefs, F.lit(0))["value"], found)

    numbers = F.transform(
        F.filter(F.transform(links, number), lambda n: n["is_tel"]), lambda n: n["value"]
    )
    return F.array_sort(F.array_distinct(numbers))


# Networks whose links count as social.
SOCIAL_NETWORKS = ("facebook", "instagram", "twitter", "youtube", "linkedin")


def social_links(tags: Column) -> Column:
    """Distinct link targets that name a social network, sorted."""
    hrefs = F.transform(
        F.filter(tags, lambda t: t["tag"] == "a"), lambda t: attr(t, "href", "first")
    )
    social = F.filter(hrefs, lambda h: h.rlike("|".join(SOCIAL_NETWORKS)))
    return F.array_sort(F.array_distinct(social))


def script_bodies(html: Column) -> Column:
    """Bodies of the page's script elements."""
    raw = F.regexp_extract_all(html, F.lit(_BLANKED), F.lit(3))
    return F.filter(raw, lambda body: body != "")
