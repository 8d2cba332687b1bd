"""Near-duplicate detection with BagMinHash signatures (operator 5).

A document is the multiset of its shingles of five words (all words, if there
are fewer). The weight axis of a shingle is cut into dyadic intervals; each has
a Poisson process of its own whose points carry a time, a register and a place
in the interval, which halves down to unit weights. A shingle of weight w has
the points below w, and a register keeps its earliest point. Two signatures
agree in a register with the documents' weighted Jaccard similarity as the
probability. A process is followed only until its time exceeds all registers.

Bands of ROWS registers name buckets. Exact copies count once. In three waves,
candidates of one bucket are verified by multiset overlap (at least THRESHOLD):
each text against the pivot it shares most buckets with, then against its other
buckets' pivots, then all pairs of a bucket that are still in different
components, block by block within tasks. Pairs that a wave before has joined
are left out, and no other pair of a bucket is.

Results: null texts are in a class of their own row. Equal texts, also without
any word, are in one class. The class id is the least doc_id in it (null if
all are null). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from webtables.llm.common import (
    WordHashes,
    clean_words,
    extended,
    extended_schema,
    materialise,
    mix,
    shingle_hashes,
    slices,
)
from webtables.llm.components import components
from webtables.operators.skew import join_summary

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares a band with a probability of 0.9993.
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Nodes of a bucket that are compared with as many others in one task.
BLOCK = 384
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def times_golden(n: int) -> np.uint64:
    return np.uint64(n * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def bag(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, shingle) pairs with their counts, by ascending owner."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(
        np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        if len(hashes)
        else np.zeros(0, bool)
    )
    return owner[first], hashes[first], np.diff(np.append(first, len(hashes)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Registers (n x REGISTERS, point identities) of n owners' weighted elements."""
    times = np.full(n * REGISTERS, np.inf)
    points = np.zeros(n * REGISTERS, np.uint64)
    # One process per element and interval [0,1), [1,2), [2,4), [4,8) ... below its weight.
    low, width = np.zeros(len(owner)), np.ones(len(owner))
    of, seeds, lows, widths, level = [], [], [], [], 0
    alive = np.arange(len(owner))
    while len(alive):
        of.append(alive)
        seeds.append(mix(element[alive] + times_golden(level)))
        lows.append(low[alive])
        widths.append(width[alive])
        low, width, level = low + width, np.where(low + width > 1, low + width, 1), level + 1
        alive = alive[weight[alive] > low[alive]]
    if not of:
        return points.reshape(n, REGISTERS)
    index, seed = np.concatenate(of), np.concatenate(seeds)
    wide = np.concatenate(widths)
    share = np.minimum(1, (weight[index] - np.concatenate(lows)) / wide)
    who, time, step = owner[index], np.zeros(len(index)), 0
    while len(who):
        step += 1
        point = mix(seed + times_golden(step))
        again = mix(point ^ GOLDEN)
        time = time - np.log((point >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / wide
        register = ((again >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        place = (again & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        below = np.flatnonzero(place < share)
        at = who[below] * REGISTERS + register[below].astype(np.int64)
        np.minimum.at(times, at, time[below])
        won = times[at] == time[below]
        points[at[won]] = point[below[won]]
        going = time < times.reshape(n, REGISTERS).max(axis=1)[who]
        who, time, seed, wide, share = who[going], time[going], seed[going], wide[going], share[going]
    return points.reshape(n, REGISTERS)


def shingles(texts: list[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and the text each belongs to."""
    words = [clean_words(t) for t in texts]
    flat = np.fromiter((cache[w] for ws in words for w in ws), np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, words), np.int64, len(words)))
    return shingle_hashes(flat, owner, SHINGLE)


def band_keys(points: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key per owner and band."""
    rows = points.reshape(len(points), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * GOLDEN + rows[:, :, i])
    return key.view(np.int64)


def sign(texts: DataFrame) -> DataFrame:
    """Add ``bands`` (bucket keys; null without words) to rows of ``text``, which goes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for part in slices(batches, "text"):
            hashes, owner = shingles(part["text"].to_pylist(), cache)
            who, element, count = bag(hashes, owner)
            keys = band_keys(signatures(who, element, count, part.num_rows))
            has = np.isin(np.arange(part.num_rows), who)
            rows = [k.tolist() if h else None for k, h in zip(keys, has, strict=True)]
            bands = pa.array(rows, pa.list_(pa.int64()))
            yield extended(part.drop_columns(["text"]), bands=bands)

    schema = extended_schema(texts.drop("text").schema, "bands array<bigint>")
    return texts.mapInArrow(run, schema)


def text_key(column: str = "text") -> Column:
    return F.unhex(F.sha2(F.encode(column, "UTF-8"), 256))


def overlap(a: str | None, b: str | None, cache: WordHashes) -> float:
    """Weighted Jaccard similarity of two texts' shingle multisets."""
    hashes, owner = shingles([a, b], cache)
    who, element, count = bag(hashes, owner)
    of_b = who == 1
    _, i, j = np.intersect1d(element[~of_b], element[of_b], assume_unique=True, return_indices=True)
    common = int(np.minimum(count[~of_b][i], count[of_b][j]).sum())
    return common / max(1, int(count.sum()) - common)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts overlap enough; ``texts`` has node and text."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows = zip(batch["text_a"], batch["text_b"], strict=True)
            keep = [overlap(a.as_py(), b.as_py(), cache) >= THRESHOLD for a, b in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(one, "a").join(two, "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Add the component of a node; a node without links is its own."""
    known = labels.select(F.col("node").alias(node), F.col("component").alias("_component"))
    joined = rows.join(known, node, "left")
    return joined.withColumn(name, F.coalesce("_component", node)).drop("_component")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    both = labelled(labelled(pairs, labels, "a", "component_a"), labels, "b", "component_b")
    return both.filter("component_a <> component_b").select("a", "b")


def cells(texts: DataFrame) -> DataFrame:
    """node and its multiset as a set: a hash of each shingle and its occurrence number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for part in slices(batches, "text"):
            who, element, count = bag(*shingles(part["text"].to_pylist(), cache))
            owner, value = np.repeat(who, count), np.repeat(element, count)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            value = (mix(value + nth.astype(np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value))
            yield pa.RecordBatch.from_arrays([part["node"], lists], names=["node", "cells"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, cells array<int>")


def tile_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of a bucket's nodes (or within one) in different components."""
    sets = [np.unique(x) for x in rows["cells"]]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    cell, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(at, minlength=len(cell)) > 1
    keep = shared[at]
    owner, at = owner[keep], (np.cumsum(shared) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(at, [low, low + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[a:b], at[a:b] - low] = 1
        common += held @ held.T
    near = common >= (THRESHOLD - 0.01) * (size[:, None] + size[None] - common)
    component, side = rows["component"].to_numpy(), rows["side"].to_numpy()
    near &= component[:, None] != component[None]
    both = rows["tile_a"].iloc[0] == rows["tile_b"].iloc[0]
    near &= both | (side[:, None] != side[None])
    x, y = np.nonzero(np.triu(near, 1))
    node = rows["node"].to_numpy()
    return pd.DataFrame({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])})


def rest_links(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of a bucket in different components that are near (to be verified).

    A bucket is cut into blocks of about BLOCK nodes, and every two blocks are
    compared in one task. So only near pairs leave a task, and a node's rows
    grow with the blocks of its buckets, not with their nodes.
    """
    summary = placed.groupBy("bucket").agg(
        F.min("component").alias("_l"), F.max("component").alias("_h"), F.ceil(F.count("*") / BLOCK).alias("n_blocks")
    )
    mixed = join_summary(placed, summary.filter("_l <> _h"), "bucket", "node")
    block = F.pmod(F.xxhash64("node"), "n_blocks")
    tile = F.explode(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1),
            lambda other: F.struct(
                F.least("block", other).alias("tile_a"), F.greatest("block", other).alias("tile_b")
            ),
        )
    )
    rows = mixed.withColumn("block", block).select("bucket", "node", "component", "block", tile.alias("t"))
    rows = rows.select("bucket", "node", "component", F.col("block").alias("side"), "t.*")
    # The sets join before the tiles are dealt, as both sides are shuffled by node here.
    held = rows.join(materialise(cells(texts)), "node")
    return held.groupBy("bucket", "tile_a", "tile_b").applyInPandas(tile_links, "a bigint, b bigint").distinct()


def near_links(texts: DataFrame, buckets: DataFrame) -> DataFrame:
    """Components of the nodes with links, from rows of bucket, node and hub.

    A bucket's pivot is the node that shares most buckets (hub), which of copies
    with many changes is the one nearest to all.
    """
    summary = buckets.groupBy("bucket").agg(F.max(F.struct("hub", "node"))["node"].alias("pivot"))
    pivots = join_summary(buckets, summary, "bucket", "node").filter("node <> pivot")
    votes = materialise(pivots.groupBy("node", "pivot").agg(F.count("*").alias("votes")))
    best = votes.groupBy("node").agg(F.min(F.struct((-F.col("votes")).alias("v"), "pivot")).alias("best"))
    first = best.select(F.col("best.pivot").alias("a"), F.col("node").alias("b"))
    links = materialise(verified(first, texts))
    labels = components(links)
    others = votes.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    more = materialise(verified(apart(others, labels), texts))
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    # The rest: pairs of a bucket that are still apart.
    placed = materialise(labelled(buckets.select("bucket", "node"), labels, "node", "component"))
    last = materialise(verified(rest_links(placed, texts), texts))
    return labels if last.isEmpty() else components(links.union(last))


def classes(documents: DataFrame) -> DataFrame:
    """Distinct texts with their class: text_key, doc_id (least of the copies),
    n_copies, class_id, class_size (documents), leads (whether its least doc_id
    is the class's)."""
    keyed = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    keyed = keyed.withColumn("text_key", text_key())
    copies = sign(keyed).groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")
    )
    nodes = materialise(copies.withColumn("node", F.monotonically_increasing_id()))
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1")
    buckets = materialise(join_summary(rows, shared, "bucket", "node"))
    hubs = buckets.groupBy("node").agg(F.sum("_n").alias("hub"))
    buckets = materialise(buckets.drop("_n").join(hubs, "node"))
    wanted = buckets.select("node").distinct().join(nodes.select("node", "text_key", "doc_id"), "node")
    # One copy of each wanted text: the row or rows of the least doc_id.
    same = [keyed["text_key"] == wanted["text_key"], keyed["doc_id"].eqNullSafe(wanted["doc_id"])]
    found = keyed.join(wanted, same).select("node", "text")
    texts = materialise(found.dropDuplicates(["node"]))
    labels = near_links(texts, buckets)
    placed = labelled(nodes.drop("bands"), labels, "node", "component")
    summary = placed.groupBy("component").agg(
        F.min("doc_id").alias("class_id"),
        F.sum("n_copies").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node")).alias("_lead"),
    )
    joined = join_summary(placed, summary, "component", "node")
    return joined.select(
        "text_key", "doc_id", "n_copies", "class_id", "class_size",
        (F.col("_lead.node") == F.col("node")).alias("leads"),
    )


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id, class_size, is_copy (not the class's leading text or doc_id)."""
    found = classes(documents).withColumnRenamed("doc_id", "_least")
    keyed = documents.select("doc_id", text_key().alias("text_key"), F.xxhash64("doc_id").alias("_spread"))
    known = keyed.filter(F.col("text_key").isNotNull())
    joined = join_summary(known, found, "text_key", "_spread").select(
        "doc_id",
        "class_id",
        "class_size",
        (~(F.col("leads") & F.col("doc_id").eqNullSafe(F.col("_least")))).alias("is_copy"),
    )
    alone = keyed.filter(F.col("text_key").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(False).alias("is_copy")
    )
    return joined.unionByName(alone)


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of every class (its least doc_id's), and all rows of null texts.

    Of rows that are equal in doc_id and text any one stays. The input's columns
    come out as they came in, whatever their names: helper columns take names
    that none of them has.
    """
    taken = set(documents.columns)

    def fresh(name: str) -> str:
        while name in taken:
            name = "_" + name
        taken.add(name)
        return name

    key, ident, least = fresh("_key"), fresh("_id"), fresh("_least")
    leads = classes(documents.select("doc_id", "text")).filter("leads").select(
        F.col("text_key").alias(key), F.xxhash64("doc_id").alias(ident), F.col("doc_id").alias(least)
    )
    keyed = documents.withColumns({key: text_key(), ident: F.xxhash64("doc_id")})
    kept = keyed.join(leads, [key, ident]).filter(F.col("doc_id").eqNullSafe(F.col(least)))
    kept = kept.dropDuplicates([key, ident]).select(*documents.columns)
    return kept.unionByName(documents.filter(F.col("text").isNull()))
