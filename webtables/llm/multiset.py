"""Document fingerprints (operator 3): a homomorphic multiset hash of paragraphs.

A paragraph (a line that is not blank, without white space at its ends) hashes
to a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors: EXACT lanes modulo 2^64, filled evenly, settle equality; LIKE lanes
modulo 2^32 hold the paragraph's runs of three words, each added to or
subtracted from one lane, so that products of two fingerprints estimate how
much two documents share; no text has enough words to pass a signed lane. Order does not matter, and adding or removing a
paragraph adds or subtracts its vector (``added``, ``removed``).

The likeness of two fingerprints is 2ab / (aa + bb) over the LIKE lanes, within
0 and 1, and 1 if all lanes are equal. Null, empty and blank texts have the
zero fingerprint. Neighbours go by descending doc_id, null last; equal doc_ids
by descending hash of the text. The only row's next document is itself, and an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from webtables.llm.common import WordHashes, clean_words, mix, shingle_hashes, shuffle_tasks, slices

EXACT, LIKE, RUN = 4, 256, 3
SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)


def paragraphs(text: str | None) -> list[str]:
    return [p for p in (line.strip() for line in (text or "").split("\n")) if p]


def vectors(texts: list[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """EXACT (n x 4, uint64) and LIKE (n x 256, uint32) lanes of every text."""
    n = len(texts)
    parts = [paragraphs(t) for t in texts]
    of_part = np.repeat(np.arange(n), np.fromiter(map(len, parts), np.int64, n))
    flat = [p for ps in parts for p in ps]
    exact = np.zeros((n, EXACT), np.uint64)
    digest = np.frombuffer(b"".join([hashlib.sha256(p.encode("utf-8", "surrogatepass")).digest() for p in flat]), "<u8")
    np.add.at(exact, of_part, digest.reshape(-1, EXACT))
    words = [clean_words(p) for p in flat]
    hashes = np.fromiter((cache[w] for ws in words for w in ws), np.uint64)
    owner = np.repeat(np.arange(len(flat)), np.fromiter(map(len, words), np.int64, len(words)))
    runs, owner = shingle_hashes(hashes, owner, RUN)
    lane = of_part[owner] * LIKE + (runs >> np.uint64(56)).astype(np.int64) % LIKE
    sign = np.where(mix(runs) & np.uint64(1), 1.0, -1.0)
    like = np.bincount(lane, weights=sign, minlength=n * LIKE).astype(np.int64).astype(np.uint32)
    return exact, like.reshape(n, LIKE)


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def removed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] - b[0], a[1] - b[1]


def written(exact: np.ndarray, like: np.ndarray) -> list[str]:
    """Fingerprints as text: base64 of all lanes, little-endian."""
    rows = zip(exact.astype("<u8"), like.astype("<u4"), strict=True)
    return [base64.b64encode(e.tobytes() + w.tobytes()).decode() for e, w in rows]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    size = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = np.clip(2 * (x * y).sum(axis=1) / np.maximum(size, 1), 0, 1)
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    return np.where(same, 1.0, near)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def report(ids: list[int | None], texts: list[str], following: list[str], cache: WordHashes) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own = vectors(texts, cache)
    other = vectors(changed, cache)
    # Mostly the following text is the next row's own.
    shifted = all(x is y for x, y in zip(texts[1:], following, strict=False))
    if shifted:
        last = vectors(following[-1:], cache)
        coming = tuple(np.concatenate([o[1:], w]) for o, w in zip(own, last, strict=True))
    else:
        coming = vectors(following, cache)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array(written(*own)),
            pa.array(written(*other)),
            pa.array(likeness(own, other)),
            pa.array(likeness(own, coming)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _within(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose next document is in the same partition: all but the last one."""
    cache = WordHashes()
    held: tuple[int | None, str] | None = None
    for part in slices(batches, "text"):
        ids, texts = part["doc_id"].to_pylist(), [t or "" for t in part["text"].to_pylist()]
        if held:
            ids, texts = [held[0], *ids], [held[1], *texts]
        if len(ids) > 1:
            yield report(ids[:-1], texts[:-1], texts[1:], cache)
        held = ids[-1], texts[-1]


def _given(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for part in slices(batches, "text"):
        texts, coming = ([t or "" for t in part[c].to_pylist()] for c in ("text", "coming"))
        yield report(part["doc_id"].to_pylist(), texts, coming, cache)


def _edge(best, order: list[Column]) -> Column:
    return best(F.struct("doc_id", "text"), F.struct(*order))


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per document: fingerprints of its text and of the edited text, and likenesses.

    The texts are shuffled once, range-partitioned by the order. Only each
    partition's first and last row meet in one place, to bridge partitions.
    """
    rows = documents.select("doc_id", "text")
    rank = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    placed = rows.repartitionByRange(shuffle_tasks(documents.sparkSession), *rank)
    inner = placed.sortWithinPartitions(*rank).mapInArrow(_within, SCHEMA)
    # The same order as a value: the greatest comes first, null least.
    order = [F.col("doc_id"), F.xxhash64("text")]
    edges = placed.groupBy(F.spark_partition_id().alias("part")).agg(
        _edge(F.max_by, order).alias("first"), _edge(F.min_by, order).alias("last")
    )
    # One row per partition, so the window holds as many rows as there are partitions.
    window = Window.orderBy("part")
    ring = F.coalesce(
        F.lead("first").over(window),
        F.first("first").over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    )
    bridges = edges.select("last", ring.alias("next")).select(
        F.col("last.doc_id").alias("doc_id"), F.col("last.text").alias("text"), F.col("next.text").alias("coming")
    )
    return inner.unionByName(bridges.mapInArrow(_given, SCHEMA))
