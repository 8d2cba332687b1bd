"""Page records rolled up to one row per website."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from webtables.functions import urls
from webtables.operators.skew import with_part

# The groups of the per-website table and their fields, in order.
FIELD_GROUPS = {
    "General": ["website", "title", "description", "author", "copyright"],
    "eCommerce": ["cart_software", "has_card", "payment_systems"],
    "Marketing": ["social_links", "phone_numbers"],
    "Hosting": [
        "ip_address", "ssl_certificate", "protocol", "as_number", "reverse_dns_lookup",
        "status_code",
    ],
    "PageDetails": ["url", "html", "text", "level", "referer", "wayback_url", "wayback_dt"],
    "Other": ["test"],
}
# Fields whose lists are sets: their order means nothing.
SET_FIELDS = ("social_links", "phone_numbers")
FIELDS = [field for fields in FIELD_GROUPS.values() for field in fields if field != "website"]


def site_values(records: DataFrame, fields: list[str], ordinal: str = "page_id") -> DataFrame:
    """Distinct values per website and field: website, field, value, first_ord.

    Lists count as whole values, written as JSON, sets sorted first. Nulls,
    empty texts and empty lists are no values; records without a website are
    dropped. This long form is whole and balanced even for a site that holds
    most of the pages, as rows meet by value, after a map-side combine.
    """
    return _values(records, fields, ordinal).filter(F.col("field") != _SITE)


# Stands for the site itself, so that one without any value keeps its row.
_SITE = ""


def _values(records: DataFrame, fields: list[str], ordinal: str) -> DataFrame:
    types = dict(records.dtypes)

    def entry(field: Column, value: Column) -> Column:
        return F.struct(field.alias("field"), value.cast("string").alias("value"))

    def value(field: str) -> Column:
        column = F.col(field)
        if types[field].startswith("array"):
            whole = F.array_sort(column) if field in SET_FIELDS else column
            return F.when(F.size(column) > 0, F.to_json(whole))
        return F.nullif(column.cast("string"), F.lit(""))

    entries = F.array(
        entry(F.lit(_SITE), F.lit("")), *[entry(F.lit(f), value(f)) for f in fields]
    )
    return (
        records.filter(F.col("website") != "")
        .select("website", F.col(ordinal).alias("ord"), F.inline(entries))
        .filter(F.col("value").isNotNull())
        .groupBy("website", "field", "value")
        .agg(F.min("ord").alias("first_ord"))
    )


def site_table(
    records: DataFrame, fields: list[str], ordinal: str = "page_id", limit: int = 10_000
) -> DataFrame:
    """Per website, an array of distinct values per field in first-seen order.

    Arrays hold the fields' own types. A site's values, by first occurrence,
    field and value, are cut into parts of ``limit`` values, numbered from 0; all
    but very large sites have part 0 only.
    """
    values = with_part(
        _values(records, fields, ordinal),
        "website",
        ["first_ord", "field", "value"],
        limit,
        F.when(F.col("field") == _SITE, 0).otherwise(1),
    )
    types = {field.name: field.dataType for field in records.schema.fields}

    def typed(name: str) -> Callable[[Column], Column]:
        kind = types[name]
        if kind.typeName() == "array":
            return lambda e: F.from_json(e["value"], kind)
        return lambda e: e["value"].cast(kind)

    entry = F.struct("first_ord", "value")
    lists = [
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("field") == name, entry))),
            typed(name),
        ).alias(name)
        for name in fields
    ]
    return values.groupBy("website", "part").agg(*lists)


def align_to_seeds(sites: DataFrame, seeds: DataFrame, strict: bool = False) -> DataFrame:
    """One row per seed, with its site's columns or nulls; other sites vanish.

    Sites are named without ``www.``, so seeds are matched without it too.
    ``strict`` matches them as written instead. A seed first meets the part
    numbers of its site only; the arrays then join by site and part, as they
    are partitioned already.
    """
    name = F.col("netloc") if strict else urls.strip_www(F.col("netloc"))
    keyed = seeds.select("txt_line_num", "netloc", name.alias("website"))
    placed = keyed.join(sites.select("website", "part"), "website", "left")
    return placed.join(sites, ["website", "part"], "left").select(
        "txt_line_num",
        F.col("netloc").alias("website"),
        *[c for c in sites.columns if c != "website"],
    )


def group_fields(
    table: DataFrame,
    expected: list[str],
    groups: dict[str, list[str]] = FIELD_GROUPS,
    keys: tuple[str, ...] = ("txt_line_num", "part"),
) -> DataFrame:
    """Arrange columns into one struct per group; every expected field needs one."""
    grouped = {field for fields in groups.values() for field in fields}
    missing = sorted(set(expected) - grouped)
    if missing:
        raise ValueError(f"no group takes these fields: {', '.join(missing)}")
    structs = []
    for group, fields in groups.items():
        present = [f for f in fields if f in table.columns]
        if present:
            structs.append(F.struct(*present).alias(group))
    return table.select(*[k for k in keys if k in table.columns], *structs)
