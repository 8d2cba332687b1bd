"""URL column functions.

Each follows the generic URL grammar (scheme, authority, path, query,
fragment) by pattern, so a malformed URL gives an empty part, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?"

# Name parts looked for in a host, most wanted first.
NAME_MARKERS = ("co", "com", "org", "nz")


def netloc(url: Column) -> Column:
    """Authority of the URL: host with port, user info and ``www.`` kept."""
    return F.regexp_extract(url, _SCHEME + r"//([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """Authority without any ``www.`` in it."""
    return strip_www(netloc(url))


def strip_www(host: Column) -> Column:
    return F.replace(host, F.lit("www."), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)


def level(url: Column) -> Column:
    """Depth of the page: non-empty path segments plus one."""
    segments = F.filter(F.split(path(url), "/"), lambda part: part != "")
    return F.size(segments) + 1


def short_name(url: Column, markers: tuple[str, ...] = NAME_MARKERS) -> Column:
    """Host part before the first marker part; the whole host if there is none.

    A marker in first place takes the last part of the host.
    """
    host = netloc(url)
    parts = F.split(host, "[.]")
    hits = [F.nullif(F.array_position(parts, marker), F.lit(0)) for marker in markers]
    hit = F.coalesce(*hits).cast("int")
    before = F.when(hit == 1, F.element_at(parts, -1)).otherwise(
        F.element_at(parts, hit - 1)
    )
    return F.when(hit.isNull(), host).otherwise(before)


def capture_time(capture_url: Column) -> Column:
    """The 14-digit stamp of an archived capture's URL, as a bigint."""
    digits = F.regexp_extract(
        capture_url, r"^https://web.archive.org/web/([0-9]{14})id_/", 1
    )
    return digits.try_cast("bigint")


def captured_between(capture_url: Column, first: int, last: int) -> Column:
    """True for captures within the time range, both ends included."""
    return capture_time(capture_url).between(first, last)
