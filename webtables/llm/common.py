"""Helpers that several operators share: table access, batches, words, written tables."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from webtables.sources.tables import materialise, shared_folder

__all__ = ["materialise", "shared_folder"]

#: Text bytes that a task holds as Python objects at a time; one longer text is held alone.
SLICE_BYTES = 2 << 20
#: Text bytes tokenized at a time: the more, the fewer words are met again.
ENCODE_BYTES = 4 << 20
#: Entries of a task's word caches, which are emptied when they are full.
CACHE_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def slices(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = 2048
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice has few rows and about ``limit`` bytes of a column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch[column]), 0)
        ends = np.cumsum(length.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            stop = min(stop, start + rows)
            yield batch.slice(start, stop - start)
            start = stop
            give_back()


def extended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with further columns; a column of the same name is replaced."""
    names = [n for n in batch.schema.names if n not in columns]
    arrays = [batch[n] for n in names] + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *columns])


def extended_schema(schema: StructType, more: str) -> StructType:
    """The schema of ``extended``; ``more`` is a DDL string of the new columns."""
    new = StructType.fromDDL(more)
    kept = [field for field in schema.fields if field.name not in new.names]
    return StructType([*kept, *new.fields])


class WordHashes(dict):
    """64-bit hashes of words, computed once per word while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def filtered(
    documents: DataFrame,
    passes: Callable[[list[str | None], Any], np.ndarray],
    cache: Callable[[], Any],
    limit: int = SLICE_BYTES,
    column: str = "text",
) -> DataFrame:
    """The rows, with their columns as they are, whose text passes; a task has one cache."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cache()
        for part in slices(batches, column, limit):
            yield part.filter(pa.array(passes(part[column].to_pylist(), own), pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


class ChunkIds:
    """Token ids of texts that are cut into chunks, each distinct chunk encoded once.

    Chunks that a slice of the data holds more than once are kept for later slices.
    """

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}

    def encode(
        self, chunks: pa.Array, rows: np.ndarray, encode_new: Callable[[list[str]], list[bytes]]
    ) -> pa.Array:
        """Little-endian 32-bit ids of every row; row i has the chunks rows[i] to rows[i + 1]."""
        coded = chunks.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_pylist()
        ids = [self.known.get(c) for c in distinct]
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, encode_new([distinct[i] for i in new]), strict=True):
            ids[i] = x
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        seen = np.bincount(index, minlength=len(distinct))
        self.known.update({distinct[i]: ids[i] for i in new if seen[i] > 1})
        # Lay the chunks' ids out in the order of the rows.
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        size_of = size[index]
        ends = np.cumsum(size_of)
        at = np.repeat(start[index] - ends + size_of, size_of) + np.arange(size_of.sum())
        offsets = (4 * np.concatenate([[0], ends])[rows]).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(flat[at])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows) - 1, buffers).cast(pa.binary())


#: What a byte is to ``pieces_of``. FIRM characters are no white space; SOFT ones may be.
SOFT, FIRM, LETTER, MARK, SPACE, NEWLINE = range(6)
KINDS = np.full(256, SOFT, np.uint8)
KINDS[[b for b in range(128) if b not in (*range(9, 14), *range(28, 33))]] = FIRM
KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = MARK
KINDS[[b for b in range(128) if chr(b).isalpha()]] = LETTER
KINDS[32], KINDS[10] = SPACE, NEWLINE
#: A Latin letter that is one for ``pieces_of`` too, for regular expressions.
LATIN_LETTER = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{23F}]"
#: Pieces that a tokenizer gets in one text.
JOINED = 200
#: Bytes from which a piece is not kept.
LONG_PIECE = 64


def before(counts: np.ndarray) -> np.ndarray:
    """The sum of the earlier counts, and at the end of all."""
    return np.concatenate([[0], np.cumsum(counts)])


def pieces_of(texts: pa.Array, every_space: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Pieces of every ``" " + text`` and the texts' bounds in them.

    Cuts lie between a Latin letter and an ASCII mark other than an apostrophe, before a
    lone space between two other characters and around a lone newline between two others;
    with ``every_space`` before each space and newline instead.
    """
    spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
    starts = np.frombuffer(spaced.buffers()[1], np.int32)[: len(texts) + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[: starts[-1]]
    # The last text is followed by a space, as the others are by the next one's.
    kind = np.append(KINDS[data], np.uint8(SPACE))
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead]
    last = lead + 1 + (first >= 0xE0) + (first >= 0xF0)
    second = data[lead + 1]
    two = first < 0xE0
    # No-break space and next line; the other white characters begin with E1 to E3.
    soft = np.where(two, (first == 0xC2) & ((second == 0x85) | (second == 0xA0)), (first >= 0xE1) & (first <= 0xE3))
    # Two signs, and the capital I with a dot, which lower-casing makes a letter and a mark.
    signs = (first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC4) & (second == 0xB0)
    letter = (first >= 0xC3) & (first <= 0xC8) & ~signs
    of = np.where(letter, LETTER, np.where(soft, SOFT, FIRM)).astype(np.uint8)
    kind[lead] = of
    kind[last] = of
    firm = (kind == FIRM) | (kind == LETTER) | (kind == MARK)
    cut = np.zeros(len(kind), bool)
    before, after = kind[:-1], kind[1:]
    cut[1:] = ((before == LETTER) & (after == MARK)) | ((before == MARK) & (after == LETTER))
    blank = (kind[1:-1] == SPACE) | (kind[1:-1] == NEWLINE)
    at = np.flatnonzero(blank if every_space else blank & firm[:-2] & firm[2:]) + 1
    cut[at] = True
    if not every_space:
        cut[at[kind[at] == NEWLINE] + 1] = True
    cut[starts] = True
    ends = np.flatnonzero(cut).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), spaced.buffers()[2])
    return pieces, np.searchsorted(ends, starts)


class PieceTable:
    """What ``make`` finds for pieces, asked once for each distinct piece.

    ``make`` gives a row for each piece, with the column ``piece``, in any order;
    ``form`` may turn pieces of equal rows into one. Short pieces are kept for later
    slices of the data; when there are more than ``limit``, those met once go.
    """

    def __init__(
        self, make: Callable[[pa.Array], pa.RecordBatch], limit: int, form: Callable[[pa.Array], pa.Array] | None = None
    ) -> None:
        self.make, self.limit, self.form = make, limit, form
        self.known = make(pa.array([], pa.string()))
        self.uses = np.zeros(0, np.int64)
        #: The row of every known piece.
        self.place: dict[str, int] = {}

    def rows(self, pieces: pa.Array) -> pa.RecordBatch:
        """The row of every piece."""
        coded = pieces.dictionary_encode()
        index, distinct = coded.indices, coded.dictionary
        if self.form:
            coded = self.form(distinct).dictionary_encode()
            index, distinct = coded.indices.take(index), coded.dictionary
        at = np.array([self.place.get(x, -1) for x in distinct.to_pylist()], np.int64)
        unknown = at < 0
        asked = distinct.filter(pa.array(unknown))
        new = self.make(asked)
        at[unknown] = self.known.num_rows + pc.index_in(asked, new["piece"]).to_numpy(zero_copy_only=False)
        rows = pa.array(at).take(index)
        table = pa.concat_batches([self.known, new])
        uses = np.bincount(rows.to_numpy(), minlength=table.num_rows)
        uses[: self.known.num_rows] += self.uses
        self._keep(table, uses)
        return table.take(rows)

    def _keep(self, table: pa.RecordBatch, uses: np.ndarray) -> None:
        kept = pc.binary_length(table["piece"]).to_numpy(zero_copy_only=False) < LONG_PIECE
        first = self.known.num_rows
        for least in (2, np.inf):
            if np.count_nonzero(kept) > self.limit:
                kept &= uses >= least
                first = 0
        if not first:
            self.place.clear()
        self.known, self.uses = table.filter(pa.array(kept)), uses[kept]
        self.place.update(zip(self.known["piece"].slice(first).to_pylist(), range(first, self.known.num_rows), strict=True))


#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split(b" ") if text else []


def clean_words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes evenly (an invertible multiply-and-shift mixer)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingle_hashes(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of one owner, and each one's owner.

    ``owner`` numbers the words' owners in ascending order. An owner of fewer
    words than ``width``, but not none, has one shingle of all its words.
    """
    n = len(hashes)
    if not n:
        return hashes.astype(np.uint64), owner
    total = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # words from here to the owner's end
    for i in range(min(width, n)):
        inside = left > i
        shifted = np.zeros(n, np.uint64)
        shifted[: n - i] = hashes[i:]
        total = np.where(inside, total * factor + mix(shifted + np.uint64(i + 1)), total)
    keep = (left >= width) | (first & (left < width))
    return mix(total[keep]), owner[keep]
