"""SQL for DuckDB that reads HTML by tables: one row per tag and attribute."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from checks.inputs import text

_SP = r"[ \t\n\f\r]"
_IN = r"""(?:/*(?:[^>"'/]+|"[^"]*"|'[^']*'))*"""
_AFTER = rf"(?:[ \t\n\f\r/]{_IN})?"
_COMMENT = r"<!--.*?(?:-->|\z)"
_EMPTY_RAW = rf"<(?:script|style){_AFTER}/+>"
_SCRIPT = rf"(<script{_AFTER}>)(.*?)(?:</script[^>]*>|\z)"
_STYLE = rf"(<style{_AFTER}>)(.*?)(?:</style[^>]*>|\z)"

BLANKED = text(rf"(?is){_COMMENT}|({_EMPTY_RAW})|{_SCRIPT}|{_STYLE}")
SHOWN = text(rf"(?is){_COMMENT}|({_EMPTY_RAW}|{_SCRIPT}|{_STYLE})")
START = text(rf"""<([a-zA-Z][^ \t\n\f\r/>"']*)({_IN}/*)>""")
ATTRIBUTE = text(
    rf"""([^ \t\n\f\r"'>/=]+)(?:{_SP}*={_SP}*("[^"]*"|'[^']*'|[^ \t\n\f\r"'>]+))?"""
)
TOKEN = text(rf"(?is){_EMPTY_RAW}|{_SCRIPT}|{_STYLE}|</?[a-zA-Z]{_IN}/*>|<[!?/][^>]*>|[^<]+|<")
FOOTER = text(rf"(?i)^</?footer{_AFTER}>$")
TITLE = text(rf"(?is)<title{_AFTER}>([^<]+)")
LINK = text(rf"(?i)^<a([ \t\n\f\r/]{_IN}/*)>$")
EDGE = text(r"(?i)^</?a[ \t\n\f\r/>]")
PLAIN = text(rf"</?[a-zA-Z]{_IN}/*>|<[!?/][^>]*>|[^<]+|<")
VOID = text(r"(?i)^<(?:area|base|br|col|embed|hr|img|input|link|meta|script|source|style|track|wbr)[ \t\n\f\r/>]|/>$|^<[!?]")
SPACES = text(rf"{_SP}+")

# Of the standard's names those of HTML 4, those that need no semicolon, and what
# the derived pages hold besides.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
_USED = {*_BARE, *(f"{n};" for n in name2codepoint), "CounterClockwiseContourIntegral;", "colon;", "bne;"}
_NAMED = ", ".join(f"{text('&' + n)}: {text(html5[n])}" for n in sorted(_USED))
_PAGE = ", ".join(
    f"{n}: {text(bytes([n]).decode('cp1252'))}" for n in range(128, 160) if n not in (129, 141, 143, 144, 157)
)


def decode(value: str, loose: bool = True) -> str:
    """References of the HTML standard; loose ones may lack their semicolon."""
    end = ";?" if loose else ";"
    pieces = f"&#[xX][0-9a-fA-F]+{end}|&#[0-9]+{end}|&[a-zA-Z][a-zA-Z0-9]*{end}|[^&]+|&"
    hexa, deci = (f"regexp_extract(p, '{r}', 1)" for r in ("^&#[xX]0*([0-9a-fA-F]*);?$", "^&#0*([0-9]*);?$"))
    number = (
        f"CASE WHEN regexp_matches(p, '^&#[xX]') THEN CASE WHEN {hexa} = '' THEN 0 WHEN length({hexa}) <= 6 "
        f"THEN ('0x' || {hexa})::BIGINT END WHEN {deci} = '' THEN 0 WHEN length({deci}) <= 7 THEN {deci}::BIGINT END"
    )
    character = (
        f"CASE WHEN ({number}) BETWEEN 128 AND 159 THEN coalesce(MAP {{{_PAGE}}}[({number})::INT], chr(({number})::INT)) "
        f"WHEN ({number}) BETWEEN 1 AND 55295 OR ({number}) BETWEEN 57344 AND 1114111 "
        f"THEN chr(({number})::INT) ELSE chr(65533) END"
    )
    bare = f"regexp_extract(p, '^&({'|'.join(_BARE)})', 0)"
    prefix = f"CASE WHEN {bare} <> '' THEN MAP {{{_NAMED}}}[{bare}] || substr(p, length({bare}) + 1) END, " if loose else ""
    return (
        f"CASE WHEN contains({value}, '&') THEN array_to_string(list_transform("
        f"regexp_extract_all({value}, '{pieces}'), lambda p: "
        f"CASE WHEN p[1] <> '&' OR p = '&' THEN p WHEN starts_with(p, '&#') THEN {character} "
        f"ELSE coalesce(MAP {{{_NAMED}}}[p], {prefix}p) END), '') "
        f"ELSE {value} END"
    )


def joined_text(html: str, bodies: bool = False) -> str:
    body = (
        f"regexp_extract(t, {text('(?is)^' + _SCRIPT + '$')}, 2) "
        f"|| regexp_extract(t, {text('(?is)^' + _STYLE + '$')}, 2)"
        if bodies
        else "''"
    )
    return (
        f"array_to_string(list_transform(regexp_extract_all({html}, {TOKEN}), lambda t: "
        f"CASE WHEN t[1] <> '<' OR t = '<' THEN {decode('t')} ELSE {body} END), '')"
    )


def html_ctes(source: str) -> dict[str, str]:
    """Tables on top of a CTE or view with page_id, url and html."""
    wide = ", ".join(
        f"arg_max(value, apos) FILTER (attr = '{a}') AS {c}"
        for a, c in [
            ("src", "src"), ("href", "href"), ("type", "kind"), ("class", "class"), ("rel", "rel"),
            ("id", "id"), ("name", "name"), ("content", "content"), ("title", "title"),
        ]
    )
    first = ", ".join(
        f"arg_min(value, apos) FILTER (attr = '{a}') AS first_{a}" for a in ("href", "name", "content")
    )
    return {
        "blanked": f"SELECT page_id, regexp_replace(html, {BLANKED}, '\\1\\2\\4', 'g') AS html FROM {source}",
        "shown": f"SELECT page_id, regexp_replace(html, {SHOWN}, '\\1', 'g') AS html FROM {source}",
        "starts": f"""
            SELECT page_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS tag_text
            FROM (SELECT page_id, regexp_extract_all(html, {START}) AS s FROM blanked)""",
        "attributes": f"""
            SELECT page_id, pos, tag, apos, attr, {decode("bare")} AS value
            FROM (SELECT page_id, pos, tag, apos, lower(name) AS attr,
                         CASE WHEN v[1] IN ('"', '''') THEN substr(v, 2, length(v) - 2) ELSE v END AS bare
                  FROM (SELECT page_id, pos, tag, generate_subscripts(names, 1) AS apos,
                               unnest(names) AS name, coalesce(unnest(vals), '') AS v
                        FROM (SELECT page_id, pos, lower(regexp_extract(tag_text, {START}, 1)) AS tag,
                                     regexp_extract_all(regexp_extract(tag_text, {START}, 2), {ATTRIBUTE}, 1) AS names,
                                     regexp_extract_all(regexp_extract(tag_text, {START}, 2), {ATTRIBUTE}, 2) AS vals
                              FROM starts)))""",
        "tags": f"SELECT page_id, pos, tag, {wide}, {first} FROM attributes GROUP BY ALL",
        # Tokens in order: a link lasts to the next tag of a link, and its own text is
        # the first where as many elements have ended as begun.
        "link_tokens": f"""
            SELECT *, sum(CASE WHEN regexp_matches(t, {EDGE}) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS link
            FROM (SELECT page_id, generate_subscripts(ts, 1) AS pos, unnest(ts) AS t
                  FROM (SELECT page_id, regexp_extract_all(html, {PLAIN}) AS ts FROM blanked))""",
        "link_depths": """
            SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id, link ORDER BY pos)) AS depth
            FROM (SELECT *, t[1] <> '<' OR t = '<' AS is_text, sum(CASE WHEN regexp_matches(t, %s) OR t[1] <> '<' OR t = '<'
                            OR regexp_matches(t, %s) THEN 0 WHEN starts_with(t, '</') THEN -1 ELSE 1 END)
                         OVER (PARTITION BY page_id, link ORDER BY pos) AS s FROM link_tokens)""" % (EDGE, VOID),
        "link_texts": """
            SELECT page_id, link, arg_min(t, pos) FILTER (is_text AND depth = 0) AS own
            FROM link_depths GROUP BY page_id, link""",
        "links": f"""
            SELECT page_id, own, arg_min(value, i) FILTER (attr = 'href') AS href
            FROM (SELECT page_id, link, i, lower(name) AS attr, {decode("bare")} AS value
                  FROM (SELECT page_id, link, i, name, CASE WHEN v[1] IN ('"', '''') THEN substr(v, 2, length(v) - 2) ELSE v END AS bare
                        FROM (SELECT page_id, link, unnest(names) AS name, coalesce(unnest(vals), '') AS v,
                                     generate_subscripts(names, 1) AS i
                              FROM (SELECT page_id, link, regexp_extract_all(regexp_extract(t, {LINK}, 1), {ATTRIBUTE}, 1) AS names,
                                           regexp_extract_all(regexp_extract(t, {LINK}, 1), {ATTRIBUTE}, 2) AS vals
                                    FROM link_tokens WHERE regexp_matches(t, {LINK})))))
            LEFT JOIN link_texts USING (page_id, link) GROUP BY page_id, link, own""",
        "phones": f"""
            SELECT page_id, list_sort(list_distinct(list(number) FILTER (number IS NOT NULL)))
                   || CASE WHEN bool_or(number IS NULL) THEN [NULL] ELSE [] END AS phone_numbers
            FROM (SELECT page_id, CASE WHEN length(href) > 4 THEN substr(href, 5)
                                       ELSE {decode("nullif(own, '')")} END AS number
                  FROM links WHERE starts_with(href, 'tel:'))
            GROUP BY page_id""",
        "socials": """
            SELECT page_id, list_sort(list(DISTINCT first_href)) AS social_links FROM tags
            WHERE tag = 'a' AND regexp_matches(first_href, 'facebook|instagram|twitter|youtube|linkedin')
            GROUP BY page_id""",
        "metas": """
            SELECT page_id, arg_min(first_content, pos) FILTER (first_name = 'author') AS author,
                   arg_min(first_content, pos) FILTER (first_name = 'description') AS description
            FROM tags WHERE tag = 'meta' AND first_content IS NOT NULL GROUP BY page_id""",
        "titles": f"""
            SELECT page_id, {decode("raw")} AS title
            FROM (SELECT page_id, nullif(regexp_extract(html, {TITLE}, 1), '') AS raw FROM blanked)""",
        # Text between more footers begun than ended.
        "footer_tokens": f"""
            SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY pos)) AS depth
            FROM (SELECT page_id, pos, t, sum(CASE WHEN NOT regexp_matches(t, {FOOTER}) THEN 0 WHEN starts_with(t, '</') THEN -1 ELSE 1 END)
                         OVER (PARTITION BY page_id ORDER BY pos) AS s
                  FROM (SELECT page_id, generate_subscripts(ts, 1) AS pos, unnest(ts) AS t
                        FROM (SELECT page_id, regexp_extract_all(html, {TOKEN}) AS ts FROM shown)))""",
        "footer_texts": f"""
            SELECT page_id, string_agg({joined_text("t", bodies=True)}, '' ORDER BY pos) AS footer
            FROM footer_tokens WHERE depth > 0 GROUP BY page_id""",
        "footers": """
            SELECT page_id, list_transform(list_filter(string_split_regex(coalesce(footer, ''), '[\\n\\t\\r]'),
                       lambda x: regexp_matches(x, '(?i)(©|copyright)')),
                       lambda x: regexp_replace(x, '^[\\p{Z}\\x09-\\x0D\\x1C-\\x1F\\x{85}]+|[\\p{Z}\\x09-\\x0D\\x1C-\\x1F\\x{85}]+$', '', 'g')) AS lines
            FROM shown LEFT JOIN footer_texts USING (page_id)""",
        "texts": f"""
            SELECT page_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: x <> ''), chr(10)) AS text
            FROM (SELECT page_id, {joined_text("html")} AS t FROM shown)""",
        "scripts": f"""
            SELECT page_id, list_filter(regexp_extract_all(html, {BLANKED}, 3), lambda b: b <> '') AS bodies
            FROM {source}""",
        "flags": f"""
            SELECT s.page_id, s.url, s.html,
                coalesce(bool_or(tag = 'img' AND contains(src, 'demandware')), false) AS demandware,
                coalesce(bool_or(tag = 'script' AND kind = 'text/x-magento-init'), false) AS magento,
                coalesce(bool_or(tag = 'span' AND (class = 'nosto_cart' OR list_contains(string_split_regex(class, {SPACES}), 'nosto_cart'))), false) AS nosto,
                coalesce(bool_or(tag = 'link' AND contains(href, 'shopify') AND list_contains(string_split_regex(rel, {SPACES}), 'stylesheet')), false) AS shopify,
                coalesce(bool_or(tag = 'div' AND list_contains(string_split_regex(class, {SPACES}), 'sitecore-link-wrapper')), false)
                    OR contains(any_value(s.html), 'SITECORE_APIKEY') AS sitecore,
                coalesce(bool_or(tag = 'link' AND href = 'https://images.squarespace-cdn.com' AND list_contains(string_split_regex(rel, {SPACES}), 'preconnect')), false) AS squarespace,
                coalesce(bool_or(tag = 'meta' AND name = 'generator' AND content = 'Wix.com Website Builder'), false) AS wix,
                coalesce(bool_or(tag = 'style' AND id = 'woocommerce-inline-inline-css' AND kind = 'text/css'), false) AS woocommerce,
                contains(lower(any_value(s.html)), 'addtocart') AS add_to_cart,
                coalesce(bool_or(tag = 'a' AND contains(href, 'payment')), false) AS payment_link,
                coalesce(bool_or(tag = 'li' AND len(list_filter(string_split_regex(class, {SPACES}), lambda c: contains(c, 'payment'))) > 0), false) AS payment_item,
                coalesce(bool_or(tag = 'script' AND contains(src, 'woocommerce')), false) AS woocommerce_script,
                coalesce(bool_or(tag = 'link' AND contains(id, 'woocommerce') AND list_contains(string_split_regex(rel, {SPACES}), 'stylesheet')), false) AS woocommerce_link,
                coalesce(bool_or(tag = 'script' AND contains(src, 'static.parastorage.com')), false) AS wix_script,
                contains(lower(any_value(s.html)), 'wix.com') AS wix_text
            FROM {source} s LEFT JOIN tags USING (page_id) GROUP BY s.page_id, s.url, s.html""",
        "carts": """
            SELECT page_id, url, list_filter([
                CASE WHEN demandware THEN 'Demandware' END, CASE WHEN magento THEN 'Magento' END,
                CASE WHEN nosto THEN 'nosto' END, CASE WHEN shopify THEN 'Shopify' END,
                CASE WHEN sitecore THEN 'Sitecore Experience Commerce' END,
                CASE WHEN squarespace THEN 'Squarespace' END, CASE WHEN wix THEN 'Wix Stores' END,
                CASE WHEN woocommerce THEN 'WooCommerce' END], lambda x: x IS NOT NULL) AS cart_software,
                add_to_cart OR payment_link OR payment_item AS has_card,
                list_filter(['visa', 'mastercard', 'amex', 'applepay', 'afterpay', 'zippay', 'alipay', 'klarna'],
                    lambda x: contains(lower(html), x)) AS payment_systems
            FROM flags""",
    }
