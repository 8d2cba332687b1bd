"""Character references in HTML text, decoded with column functions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from webtables.functions.binding import let

# Names that also count without their semicolon, by the standard library's table.
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_STRICT = r"&#[xX][0-9a-fA-F]+;|&#[0-9]+;|&[a-zA-Z][a-zA-Z0-9]*;|[^&]+|&"
_LOOSE = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"
_NUMBER = r"^&#(?:[xX]0*([0-9a-fA-F]*)|0*([0-9]*));?$"
_BARE = "^&(" + "|".join(_BARE_NAMES) + ")"
_REPLACEMENT = 0xFFFD


def _windows_1252() -> dict[str, int]:
    """What the numbers 128 to 159 stand for: the characters of that code page."""
    return {str(n): ord(bytes([n]).decode("cp1252", "replace")) for n in range(128, 160)}


def _code_point(piece: Column) -> Column:
    """Number of a numeric reference; no character has 0, a surrogate's or a greater one."""
    hexadecimal = F.regexp_extract(piece, _NUMBER, 1)
    decimal = F.regexp_extract(piece, _NUMBER, 2)
    # More digits than any character's number has would not fit an integer.
    number = F.when(
        hexadecimal != "", F.when(F.length(hexadecimal) <= 6, F.conv(hexadecimal, 16, 10).cast("bigint"))
    ).otherwise(
        F.when(decimal == "", F.lit(0)).when(F.length(decimal) <= 7, decimal.cast("bigint"))
    )

    def checked(code: Column) -> Column:
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        old = F.from_json(F.lit(json.dumps(_windows_1252())), "map<string,int>")
        in_page = F.when(
            code.between(128, 159),
            F.nullif(F.try_element_at(old, code.cast("string")), F.lit(_REPLACEMENT)),
        )
        return F.coalesce(in_page.cast("bigint"), F.when(valid, code), F.lit(_REPLACEMENT).cast("bigint"))

    return let(number, checked)


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _named(name: Column) -> Column:
    # As one JSON text the table stays a single constant in the plan; the names
    # met most often come before it, as it is searched from its start.
    known = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    return (
        F.when(name == "amp;", "&")
        .when(name == "nbsp;", "\xa0")
        .when(name == "lt;", "<")
        .when(name == "gt;", ">")
        .when(name == "quot;", '"')
        .otherwise(F.try_element_at(known, name))
    )


def decode(text: Column, loose: bool = True) -> Column:
    """Replace named and numeric references in one left-to-right pass.

    All names of the HTML standard and numbers of any length count, ``loose``
    also without a semicolon: then the longest such name that the text goes on
    with. An unknown reference stays as it is, and ``&amp;lt;`` becomes ``&lt;``.
    """

    def bare(piece: Column) -> Column:
        name = F.regexp_extract(piece, _BARE, 1)
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.when(name != "", F.concat(_named(name), rest))

    def one(piece: Column) -> Column:
        exact = _named(F.substring(piece, F.lit(2), F.length(piece)))
        named = F.coalesce(exact, bare(piece), piece) if loose else F.coalesce(exact, piece)
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(piece.startswith("&#"), _character(_code_point(piece)))
            .otherwise(named)
        )

    def decoded(whole: Column) -> Column:
        pieces = F.regexp_extract_all(whole, F.lit(_LOOSE if loose else _STRICT), F.lit(0))
        joined = F.array_join(F.transform(pieces, one), "")
        return F.when(whole.contains("&"), joined).otherwise(whole)

    return let(text, decoded)
