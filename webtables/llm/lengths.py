"""Token counts (operator 8): the exact histogram of documents by encoded length.

Documents are aggregated by their number of tokens, which any context limit's
figures follow from by sums over the histogram: a limit L keeps all tokens of
shorter documents and L of every other. The sums run over blocks of BLOCK
lengths and then within a block, so no task holds the whole histogram.

Null and empty texts have length 0. Repeated rows count each. An empty table
gives an empty histogram, for which totals are 0 and quantiles null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from webtables.llm.bpe import _shared, model
from webtables.llm.common import ENCODE_BYTES, slices

BLOCK = 1024


def histogram(texts: DataFrame, path: str, column: str = "text") -> DataFrame:
    """n_tokens and n_docs; counted within tasks first."""
    definition = _shared(texts, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(definition.value)
        for part in slices(batches, column, ENCODE_BYTES):
            sizes = pc.divide(pc.binary_length(bpe.encode(part[column])), 4)
            yield pa.RecordBatch.from_arrays([pc.cast(sizes, pa.int64())], names=["n_tokens"])

    counted = texts.select(column).mapInArrow(run, "n_tokens bigint")
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(lengths: DataFrame) -> DataFrame:
    """Per length as the context limit: n_tokens, n_docs, docs_from and tokens_from
    (documents of at least this length and their tokens), total_tokens,
    truncated_tokens (all tokens left when longer documents are cut to it) and
    quantile (the share of documents of at most this length)."""
    rows = lengths.select("n_tokens", "n_docs").withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    rows = rows.withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_later_docs"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_later_tokens"),
        F.sum("_d").over(every).alias("_all_docs"),
        F.sum("_t").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc())
    joined = rows.join(sums, "_block")
    docs_from = F.sum("n_docs").over(within) + F.col("_later_docs")
    tokens_from = F.sum("_tokens").over(within) + F.col("_later_tokens")
    summed = joined.withColumns({"docs_from": docs_from, "tokens_from": tokens_from})
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("_all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("_all_docs")).alias("quantile"),
    )


def truncated_total(lengths: DataFrame, limit: int) -> DataFrame:
    """One row with the tokens left under any limit: total_tokens, truncated_tokens."""
    zero = F.lit(0).cast("long")
    return lengths.agg(
        F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), zero).alias("total_tokens"),
        F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), zero).alias("truncated_tokens"),
    )


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """Per share in (0, 1]: the least length that so many documents do not exceed."""
    found = [F.min(F.when(F.col("quantile") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    pairs = F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])
    return limits.agg(*found).select(F.inline(pairs))
