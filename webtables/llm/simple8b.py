"""Token ids in Simple-8b word-aligned files (operator 2).

A 64-bit word holds a selector in its lowest 4 bits and as many ids of equal
width as fit into the other 60; ids of more than 60 bits follow their selector's
word whole (an escape). Ids are packed in blocks of BLOCK ids, all blocks of a
segment in step, and every block starts at a word of its own, whose offset is
stored. As each word tells its own count, decoding has no loop over words.

The file format is a Parquet table of segments in id order: ``part`` and
``segment`` number them, ``part_start`` counts the ids before a segment within
its part, ``doc_ids`` and ``lengths`` list its documents, ``offsets`` the first
word of each block, and ``words`` is the packed payload. Documents are in
ascending doc_id order (null first; equal doc_ids in order of their texts'
hash), so equal rows stay equal and both are written. A null or empty text has
the end id only. An empty table gives files without segments.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from webtables.llm.common import (
    ENCODE_BYTES, JOINED, LATIN_LETTER, PieceTable, before, extended, extended_schema, pieces_of, shuffle_tasks, slices,
)

#: Ids per block, and ids per segment before it is closed.
BLOCK = 512
SEGMENT_IDS = 1 << 18
#: Ids per word of each selector; 60 // count bits are each id's share.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = len(COUNTS)
#: Pieces whose ids a task keeps.
CACHE_PIECES = 300_000
Batches = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]
SEGMENTS = (
    "part int, segment int, part_start bigint, n_ids bigint, doc_ids array<bigint>,"
    " lengths array<bigint>, offsets array<int>, words binary"
)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) of the ids, and the first word of each block."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    padded = np.zeros((n_blocks, BLOCK + int(COUNTS[0])), np.uint64)
    body = np.zeros(n_blocks * BLOCK, np.uint64)
    body[:n] = ids
    padded[:, :BLOCK] = body.reshape(n_blocks, BLOCK)
    size = np.full(n_blocks, BLOCK)
    size[-1] = n - BLOCK * (n_blocks - 1)
    # The selector each position would take: the first whose ids all fit its width.
    # The widest id of the next c is the maximum over two runs of half the length.
    bits = ((padded.astype(np.float64).view(np.int64) >> 52) - 1022).clip(0).astype(np.int8)
    widest = {1: bits}
    choice = np.full((n_blocks, BLOCK), ESCAPE, np.int8)
    for s in range(ESCAPE - 1, -1, -1):
        c = int(COUNTS[s])
        half = max(h for h in widest if h <= c)
        while half < c:
            step = min(half, c - half)
            run = np.zeros_like(bits)
            run[:, : run.shape[1] - step] = widest[half][:, step:]
            half += step
            widest[half] = np.maximum(widest[half - step], run)
        choice = np.where(widest[c][:, :BLOCK] <= WIDTHS[s], np.int8(s), choice)
    # The first ids of all words, found in all blocks in step.
    step = np.append(COUNTS, 1)[choice]
    live, at, found = np.arange(n_blocks), np.zeros(n_blocks, np.int64), []
    while len(live):
        found.append(live * BLOCK + at)
        at = at + step[live, at]
        left = at < size[live]
        live, at = live[left], at[left]
    first = np.sort(np.concatenate(found))
    block, position = np.divmod(first, BLOCK)
    selector = choice[block, position].astype(np.int64)
    escaped = selector == ESCAPE
    word = selector.astype(np.uint64)
    start, ids_of = block * padded.shape[1] + position, padded.ravel()
    for s, (count, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist(), strict=True)):
        of = np.flatnonzero(selector == s)
        at, filled = start[of], word[of]
        for k in range(count if len(of) else 0):
            filled |= ids_of[at + k] << np.uint64(4 + width * k)
        word[of] = filled
    # An escaped id follows its selector's word.
    place = before(1 + escaped)
    words = np.empty(place[-1], np.uint64)
    words[place[:-1]] = word
    words[place[:-1][escaped] + 1] = padded[block[escaped], position[escaped]]
    return words, place[np.searchsorted(block, np.arange(n_blocks))].astype(np.int32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids of ``pack``; ``n`` counts them."""
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # A word after an escape is an id; only runs of words that look like escapes need care.
    for i in np.flatnonzero(selector == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    selector[raw] = ESCAPE
    # An escape's selector has no ids itself, the word after it one of all bits.
    count = np.append(COUNTS, 0)[selector]
    count[raw] = 1
    # The last word of a block may have room for more ids than were left.
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    earlier = before(count)
    start = earlier[:-1] - earlier[offsets][block] if len(words) else earlier[:-1]
    left = np.where(block == len(offsets) - 1, n - BLOCK * (len(offsets) - 1), BLOCK) - start
    count = np.minimum(count, left)
    start += BLOCK * block
    value = np.zeros(n, np.uint64)
    for s, (most, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist(), strict=True)):
        of = np.flatnonzero(selector == s)
        for k in range(most if len(of) else 0):
            if k:
                of = of[count[of] > k]
            value[start[of] + k] = (words[of] >> np.uint64(4 + width * k)) & np.uint64((1 << width) - 1)
    value[start[raw]] = words[raw]
    return value


#: Pieces that are one word to the tokenizer: only letters, also after lower-casing.
WORD = rf"\A{LATIN_LETTER}+\z"


def lowered(pieces: pa.Array) -> pa.Array:
    """Pieces without white space before them, words in lower case as the tokenizer makes them."""
    pieces = pc.utf8_ltrim(pieces, " \n")
    return pc.if_else(pc.match_substring_regex(pieces, WORD), pc.utf8_lower(pieces), pieces)


class WordIds:
    """Ids of pieces of texts, each distinct piece encoded once, words many in one text."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        #: Whether an id ends a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known = PieceTable(self.encoded, CACHE_PIECES, lowered)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, pieces: pa.Array) -> pa.RecordBatch:
        """Of each piece its ids as little-endian 32-bit integers."""
        word = pc.match_substring_regex(pieces, WORD)
        words, others = pieces.filter(word), pieces.filter(pc.invert(word))
        text = pc.binary_join_element_wise(words, "", " ")
        at = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1] if len(text) else np.zeros(1, np.int32)
        edges = [*at[:-1:JOINED].tolist(), int(at[-1])]
        data = text.buffers()[2].to_pybytes() if len(text) else b""
        flat = np.concatenate([np.zeros(0, "<u4"), *self._ids([data[x:y].decode() for x, y in itertools.pairwise(edges)])])
        last = np.flatnonzero(self.ends[flat])
        if len(last) == len(words) and (not len(flat) or last[-1] == len(flat) - 1):
            size = np.diff(last, prepend=-1)
        else:  # This tokenizer marks no ends of words.
            each = self._ids(words.to_pylist())
            flat, size = np.concatenate([flat[:0], *each]), np.array([len(x) for x in each], np.int64)
        alone = self._ids(others.to_pylist())
        flat = np.concatenate([flat, *alone])
        at = 4 * before(np.concatenate([size, np.array([len(x) for x in alone], np.int64)]))
        buffers = [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat.astype("<u4"))]
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(pieces), buffers)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([words, others]), ids], names=["piece", "ids"])

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of every text."""
        pieces, bounds = pieces_of(texts, every_space=True)
        whole = pc.match_substring_regex(texts, self.added) if self.added else pa.scalar(False)
        if pc.any(whole).as_py():
            # Texts that hold an added token stay whole.
            rows = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces).to_pylist()
            for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
                rows[i] = [texts[i].as_py()]
            lists = pa.array(rows, pa.list_(pa.string()))
            pieces, bounds = lists.flatten(), before(pc.list_value_length(lists).to_numpy())
        ids = self.known.rows(pieces)["ids"]
        at = np.frombuffer(ids.buffers()[1], np.int32)[bounds]
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), ids.buffers()[2]])


@functools.lru_cache(maxsize=2)
def _library(definition: str) -> WordIds:
    return WordIds(definition)


def encode_words(texts: DataFrame, path: str, end_id: int, column: str = "text") -> DataFrame:
    """Add ``token_ids`` (binary: little-endian 32-bit ids, the end id last).

    The tokenizers library encodes each distinct piece once. That gives the ids
    of the whole text for a tokenizer that drops white space and never joins a
    letter with a mark other than an apostrophe.
    """
    run = _encoder(texts, path, end_id, column)
    return texts.mapInArrow(run, extended_schema(texts.schema, "token_ids binary"))


def _encoder(texts: DataFrame, path: str, end_id: int, column: str = "text") -> Batches:
    """What ``encode_words`` does with the record batches of a task."""
    with open(path, encoding="utf-8") as file:
        definition = texts.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(definition.value)
        for part in slices(batches, column, ENCODE_BYTES // 2):
            ids = library.encode(pc.fill_null(part[column], ""))
            ids = pc.binary_join_element_wise(ids, pa.scalar(end, pa.binary()), pa.scalar(b"", pa.binary()))
            yield extended(part, token_ids=ids)

    return run


def in_order(texts: DataFrame, column: str = "text") -> DataFrame:
    """Rows range-partitioned and sorted by doc_id, equal ones by the text's hash."""
    keys = ["doc_id", F.xxhash64(column)]
    return texts.repartitionByRange(shuffle_tasks(texts.sparkSession), *keys).sortWithinPartitions(*keys)


def write(encoded: DataFrame, path: str) -> None:
    """Write rows of doc_id and token_ids, in the order they are in, as segments."""
    encoded.select("doc_id", "token_ids").mapInArrow(segments_of, SEGMENTS).write.parquet(path)


def segments_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of a task's rows of doc_id and token_ids."""
    part, segment, start = TaskContext.get().partitionId(), 0, 0
    docs: list[int | None] = []
    held: list[bytes] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal segment, start, docs, held, size
        words, offsets = pack(np.frombuffer(b"".join(held), "<u4"))
        row = {
            "part": part,
            "segment": segment,
            "part_start": start,
            "n_ids": size,
            "doc_ids": docs,
            "lengths": [len(x) // 4 for x in held],
            "offsets": offsets.tolist(),
            "words": words.astype("<u8").tobytes(),
        }
        segment, start, docs, held, size = segment + 1, start + size, [], [], 0
        return pa.RecordBatch.from_pylist([row], schema=ARROW_SEGMENTS)

    for batch in batches:
        for doc, ids in zip(batch["doc_id"].to_pylist(), batch["token_ids"].to_pylist(), strict=True):
            docs.append(doc)
            held.append(ids or b"")
            size += len(held[-1]) // 4
            if size >= SEGMENT_IDS:
                yield close()
    if docs:
        yield close()


ARROW_SEGMENTS = pa.schema(
    {
        "part": pa.int32(),
        "segment": pa.int32(),
        "part_start": pa.int64(),
        "n_ids": pa.int64(),
        "doc_ids": pa.list_(pa.int64()),
        "lengths": pa.list_(pa.int64()),
        "offsets": pa.list_(pa.int32()),
        "words": pa.binary(),
    }
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, token_ids.

    ``start`` counts the ids of all documents before. Only the parts' totals,
    one row per writing task, are summed in one place.
    """
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    # One row per writing task, so the totals may be broadcast.
    placed = segments.join(F.broadcast(totals.select("part", offset)), "part").select(
        (F.col("_offset") + F.col("part_start")).alias("start"),
        "n_ids", "doc_ids", "lengths", "offsets", "words",
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            words = np.frombuffer(row["words"], "<u8")
            ids = unpack(words, np.array(row["offsets"]), row["n_ids"]).astype("<u4").tobytes()
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            places = zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([ids[a:b] for a, b in places], pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "token_ids"],
            )

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, token_ids binary")


def round_trip(documents: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> DataFrame:
    """Encode, write and read back whole texts: doc_id, start, n_tokens, ids_crc32."""
    ordered = in_order(documents.select("doc_id", "text"))
    encode = _encoder(ordered, tokenizer, end_id)
    # One Python worker per task encodes and packs.
    ordered.mapInArrow(lambda batches: segments_of(encode(batches)), SEGMENTS).write.parquet(path)
    back = read(documents.sparkSession, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))
