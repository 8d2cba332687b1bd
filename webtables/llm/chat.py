"""Chat formatting (operator 7) by collapsing cumulative snapshots, in DataFrame functions.

A logged conversation that another one continues says nothing new. Each turn
gets the hash of its conversation up to it: two 60-bit lanes, the running
bitwise XOR of hashes of (position, role, text). A conversation whose whole
hash is some longer conversation's prefix hash is dropped by an anti-join; of
equal conversations the least conv_id stays. The rest is rendered in parts of
PART turns, which joined in order are the transcript.

Turns are ordered by turn, role and text (null first), and all rows count, also
repeated ones. A null role or text renders as an empty one, but differs from it
in the comparison. Rows of a null conv_id are one conversation. Positions and
hashes of a long conversation are summed per block of its turns, so it may be
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from webtables.llm.common import materialise, shuffle_tasks
from webtables.operators.skew import join_summary

#: Turns of a rendered row.
PART = 64
LANES = ("a", "b")


def _lane(lane: str, position: Column) -> Column:
    content = F.to_json(F.struct(position.alias("p"), "role", "text"), {"ignoreNullFields": "false"})
    digest = F.sha2(F.encode(F.concat(F.lit(lane), content), "UTF-8"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """Turns with position (from 1) and the running prefix hashes a and b."""
    order = ["turn", "role", "text"]
    rows = conversations.select("conv_id", *order)
    tasks = shuffle_tasks(conversations.sparkSession)
    # The block must be the same for all later readers, so it is written down.
    spread = rows.repartitionByRange(tasks, "conv_id", *order, F.rand(7))
    rows = materialise(spread.withColumn("block", F.spark_partition_id()))
    within = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def carried(frame: DataFrame, block: DataFrame, names: list[str]) -> DataFrame:
        key = ["_conv", "block"]
        marked = frame.withColumn("_conv", F.to_json(F.struct("conv_id")))
        small = block.withColumn("_conv", F.to_json(F.struct("conv_id"))).select(*key, *names)
        return marked.join(small, key).drop("_conv")

    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    placed = carried(rows, before, ["_before"])
    placed = placed.withColumn("position", F.row_number().over(within) + F.col("_before"))
    lanes = {f"_{k}": _lane(k, F.col("position")) for k in LANES}
    placed = placed.drop("_before").withColumns(lanes)
    sums = placed.groupBy("conv_id", "block").agg(*[F.bit_xor(f"_{k}").alias(k) for k in LANES])
    past = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(k).over(earlier), F.lit(0)).alias(f"_past_{k}") for k in LANES])
    joined = carried(placed, past, [f"_past_{k}" for k in LANES])
    running = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    hashes = {k: F.bit_xor(f"_{k}").over(running).bitwiseXOR(F.col(f"_past_{k}")) for k in LANES}
    return joined.withColumns(hashes).select("conv_id", "position", "role", "text", *LANES)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no other continues or repeats."""
    ends = turns.groupBy("conv_id").agg(F.max(F.struct("position", *LANES)).alias("end"))
    whole = ends.select("conv_id", F.col("end.position").alias("n_turns"), *[F.col(f"end.{k}").alias(k) for k in LANES])
    key = ["n_turns", *LANES]
    first = whole.groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNull().alias("null"), "conv_id")).alias("least"))
    single = first.select(F.col("least.conv_id").alias("conv_id"), *key)
    # A prefix hash that no conversation ends with is a longer one's inner turn.
    last = whole.select("conv_id", "n_turns").withColumn("_conv", F.to_json(F.struct("conv_id"))).drop("conv_id")
    marked = turns.withColumn("_conv", F.to_json(F.struct("conv_id")))
    inner = marked.join(last, "_conv").filter("position < n_turns")
    prefixes = inner.select(F.col("position").alias("n_turns"), *LANES).distinct()
    return single.join(prefixes, key, "left_anti").select("conv_id", "n_turns")


def rendered(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as text: conv_id, part (from 0), n_turns, text."""
    turns = materialise(hashed_turns(conversations))
    kept = maximal(turns).withColumn("_conv", F.to_json(F.struct("conv_id"))).drop("conv_id")
    rows = turns.withColumn("_conv", F.to_json(F.struct("conv_id")))
    said = F.concat(
        F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n")
    )
    joined = join_summary(rows, kept, "_conv", "position")
    parts = joined.withColumn("part", F.floor((F.col("position") - 1) / PART)).groupBy("conv_id", "part", "n_turns").agg(
        F.array_sort(F.collect_list(F.struct("position", said.alias("said")))).alias("turns")
    )
    text = F.array_join(F.transform("turns", lambda t: t["said"]), "")
    return parts.select("conv_id", "part", "n_turns", text.alias("text"))
