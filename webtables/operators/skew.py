"""Keys that hold a large share of all rows: split joins, bounded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from webtables.sources.tables import materialise


def join_summary(
    rows: DataFrame, summary: DataFrame, key: str, spread: str, salts: int = 1
) -> DataFrame:
    """Inner join of rows with one summary row per key, such that a hot key's
    rows can be split over many tasks.

    A summary comes out of its aggregation partitioned by the key. Joined on
    the key alone it stays so, and adaptive execution, which only splits what
    was shuffled for the join, must put all rows of a key into one task. The
    salt as a second key has both sides shuffled for the join. Without adaptive
    execution, ``salts`` splits each key by the hash of column ``spread`` and
    repeats the summary as often.
    """
    # Never null, or Spark would filter the rows for it and with that keep them
    # from sharing an exchange with the summary.
    salt = F.coalesce(F.pmod(F.hash(spread), F.lit(salts)), F.lit(0))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        rows.withColumn("_salt", salt)
        .join(summary.withColumn("_salt", every), [key, "_salt"])
        .drop("_salt")
    )


# Keys whose summary rows ``join_frequent`` broadcasts, and the most bytes of such a key.
FREQUENT, FREQUENT_BYTES = 1 << 19, 64


def frequent_keys(summary: DataFrame, key: str, count: str, limit: int) -> tuple[Column, int, int]:
    """Which keys of a summary, one row each, have the highest counts: a condition, at most
    ``limit`` keys that meet it, and the number of the others.

    Keys are taken by grades of their count, eight to each doubling, so that only the
    grades' sizes are collected. Keys of more than ``FREQUENT_BYTES`` never meet it.
    """
    short = F.octet_length(key) <= FREQUENT_BYTES
    grade = F.when(short, F.floor(F.log2(count) * 8).cast("int")).otherwise(-1)
    sizes = {r["grade"]: r["count"] for r in summary.groupBy(grade.alias("grade")).count().collect()}
    least, n = 1 << 10, 0
    for at in sorted(sizes, reverse=True):
        if at < 0 or n + sizes[at] > limit:
            break
        least, n = at, n + sizes[at]
    return grade >= least, n, sum(sizes.values()) - n


def join_frequent(
    rows: DataFrame, summary: DataFrame, key: str, count: str, spread: str, limit: int = FREQUENT
) -> DataFrame:
    """Inner join of rows with one summary row per key, where only rows of rare keys are shuffled.

    The summary rows of the ``limit`` keys of highest ``count`` are broadcast. Where
    few keys have most rows, as words do, most rows stay where they are.
    """
    often, n, others = frequent_keys(summary, key, count, limit)
    if not n:
        return join_summary(rows, summary, key, spread)
    frequent = F.broadcast(summary.filter(often))
    met = rows.join(frequent, key)
    if not others:
        return met
    rare = rows.join(frequent, key, "left_anti")
    return met.unionByName(join_summary(rare, summary.filter(~often), key, spread))


def running_total(rows: DataFrame, key: str, order: list[str], amount: Column) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over the key's earlier rows.

    Rows are range-partitioned by key and order and written once, so that a hot
    key's rows lie in many blocks. Only the blocks' sums meet per key; the rows
    are summed within their blocks.
    """
    amounts = rows.withColumn("_amount", amount)
    spread = amounts.repartitionByRange(key, *order, "_amount").withColumn(
        "_block", F.spark_partition_id()
    )
    blocks = materialise(spread)
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(key, "_block").agg(F.sum("_amount").alias("_sum"))
    offsets = sums.select(
        F.col(key).alias("_key"),
        F.col("_block").alias("_at"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
    )
    within = (
        Window.partitionBy(key, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at"))
    return (
        blocks.join(offsets, same)
        .withColumn("before", F.col("_offset") + F.coalesce(F.sum("_amount").over(within), F.lit(0)))
        .drop("_amount", "_block", "_key", "_at", "_offset")
    )


def with_part(
    rows: DataFrame, key: str, order: list[str], limit: int, amount: Column | None = None
) -> DataFrame:
    """Add a ``part`` number, from 0, that keeps every (key, part) group bounded.

    A key's rows are laid end to end in order, each as long as its amount (1 if
    none is given); a row is in the part in which it begins. So a part
    holds less than ``limit`` and its last row, whatever the size of the table.
    """
    placed = running_total(rows, key, order, F.lit(1) if amount is None else amount)
    return placed.withColumn("part", F.floor(F.col("before") / limit).cast("int")).drop("before")
