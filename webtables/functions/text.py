"""Text column functions: tokens, stored counts, Unicode normal form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def words(text: Column) -> Column:
    """Lower-case words of 2 to 15 letters, digits of the decimal kind apart."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nl}\p{No}_]+"), F.lit(0))
    return F.filter(runs, lambda w: F.length(w).between(2, 15) & ~w.startswith("_"))


def terms(text: Column) -> Column:
    """Lower-case runs of two or more word characters, digits included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def parse_counts(stored: Column) -> Column:
    """Word counts from their stored text, written with single quotes."""
    return F.from_json(F.translate(stored, "'", '"'), "map<string,bigint>")


def drop_stop_words(counts: Column, stop_words: list[str]) -> Column:
    """A word-count map without the stop words."""
    return F.map_filter(counts, lambda word, n: ~word.isin(*stop_words))


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, which Spark SQL has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")
