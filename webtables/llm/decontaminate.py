"""Benchmark decontamination (operator 6) by one Aho-Corasick automaton.

The automaton's letters are words, so its keys are runs of word numbers: all
windows of WINDOW consecutive words of the benchmark items (an item of fewer
words, but not none, is one window). A document's text is scanned once; hits
are word ranges, which word offsets map back to the original text.

Words are runs of ASCII letters or digits and of characters beyond ASCII, after
lower-casing A-Z. Null and empty texts have no words and hit nothing, as does
everything if there are no items. Items of a null id count as one id ``null``
(as text); equal items share their windows and each counts. Documents are
treated row by row, so repeated rows and further columns are harmless.

The benchmark goes to the executors in blocks of at most BLOCK_BYTES of text,
one automaton each, so that neither the driver nor a task holds more than one
block whatever the benchmark's size; a benchmark of one block is one scan.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from webtables.llm.common import WORD_BYTES, clean_words, extended, extended_schema, filtered, slices

WINDOW = 10
#: Benchmark text per automaton; a word takes about 100 bytes in it.
BLOCK_BYTES = 2 << 20
HITS = "n_words bigint, ranges array<struct<first:int,last:int>>, items array<string>"


class Windows:
    """The automaton over the windows of some (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in clean_words(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in owners.items():
            self.automaton.add_word(key, (len(key), frozenset(ids)))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of hit words (first, last), merged and ascending; the items found."""
        if self.empty or not words:
            return [], set()
        get = self.numbers.get
        found: set[str] = set()
        ranges: list[tuple[int, int]] = []
        for last, (size, ids) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            found |= ids
            first = last - size + 1
            while ranges and ranges[-1][1] >= first - 1:  # a shorter key's match may begin later
                first = min(first, ranges.pop()[0])
            ranges.append((first, last))
        return ranges, found


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in bounded lists; the driver holds one partition's rows at a time."""
    block: list[tuple[str, str]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text")
    for item, text in rows.na.drop(subset=["text"]).toLocalIterator():
        block.append((item, text))
        size += len(text.encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


@functools.lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[str, str], ...], window: int) -> Windows:
    return Windows(list(items), window)


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every word in the UTF-8 text."""
    raw = np.frombuffer(text.encode().translate(WORD_BYTES), np.uint8)
    inside = np.concatenate([[False], raw != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def spans_of(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character positions in the original text of ranges of words."""
    starts, ends = word_spans(text)
    raw = np.frombuffer(text.encode(), np.uint8)
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(characters[starts[a]]), int(characters[ends[b]])) for a, b in ranges]


def _scan(documents: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(tuple(items))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _automaton(shared.value, window)
        for part in slices(batches, "text"):
            counts, ranges, found = [], [], []
            for text in part["text"].to_pylist():
                words = clean_words(text)
                hit, ids = windows.scan(words)
                counts.append(len(words))
                ranges.append([{"first": a, "last": b} for a, b in hit])
                found.append(sorted(ids))
            kind = pa.list_(pa.struct({"first": pa.int32(), "last": pa.int32()}))
            yield extended(
                part,
                n_words=pa.array(counts, pa.int64()),
                ranges=pa.array(ranges, kind),
                items=pa.array(found, pa.list_(pa.string())),
            )

    return documents.mapInArrow(run, extended_schema(documents.schema, HITS))


def _merged(documents: DataFrame) -> DataFrame:
    """Join a row's ranges and items of one more block to those of the blocks before."""
    order = F.array_sort(F.concat("_ranges", "ranges"))
    joined = F.aggregate(
        order,
        F.slice(order, 1, 0),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= x["first"] - 1),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"),
                        F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return (
        documents.withColumn("ranges", joined)
        .withColumn("items", F.array_sort(F.array_union("_items", "items")))
        .drop("_ranges", "_items")
    )


def hits(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Add ``n_words``, ``ranges`` (hit words, first to last, from 0) and ``items``."""
    scanned = None
    for items in blocks(benchmark, block_bytes):
        if scanned is None:
            scanned = _scan(documents, items, window)
        else:
            before = scanned.withColumnsRenamed({"ranges": "_ranges", "items": "_items"})
            scanned = _merged(_scan(before, items, window))
    return _scan(documents, [], window) if scanned is None else scanned


def spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit passages in the original text: doc_id, start, stop (characters), passage."""
    found = hits(documents.select("doc_id", "text"), benchmark).filter(F.size("ranges") > 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                for a, b in spans_of(row["text"], [(r["first"], r["last"]) for r in row["ranges"]]):
                    rows.append({"doc_id": row["doc_id"], "start": a, "stop": b, "passage": row["text"][a:b]})
            schema = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "passage": pa.string()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return found.mapInArrow(run, "doc_id bigint, start bigint, stop bigint, passage string")


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: counts of words, hit words and items, and the items' digest."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return hits(documents.select("doc_id", "text"), benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )




def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with their columns as they are, that hold no window of any item."""
    for items in blocks(benchmark):
        documents = _unhit(documents, items)
    return documents


def _unhit(documents: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(tuple(items))

    def passes(texts: list[str | None], _: object) -> np.ndarray:
        windows = _automaton(shared.value, WINDOW)
        return np.array([not windows.scan(clean_words(t))[0] for t in texts], bool)

    return filtered(documents, passes, object)
