"""Cross-tokenizer alignment (operator 13): groups of tokens of two tokenizers.

A document is encoded twice: ``" " + text`` by a byte-level BPE (A, the
tokenizers library, special tokens' strings taken as plain text) and ``text`` by
a sentencepiece model (B, which adds the leading space). Every token stands for
bytes: A's entry decoded from its byte characters, B's piece in UTF-8 with
U+2581 as a space and ``<0xHH>`` as byte HH.

Method, per document: the cumulative byte ends of both lists are met (as sorted
arrays, one with the other), and each offset where a token of each ends at once
slices both id lists into a group. The links of a group are all its A-B token
pairs (expanded per slice). A text is aligned only if both lists spell
``" " + text`` byte for byte; null, empty and other texts have no tokens and all
figures 0, and their ``groups_sha256`` is ``''``.

Both tokenizers always end a token before a lone space between two other
characters, around a lone newline between two others, and between a Latin letter
and an ASCII mark other than an apostrophe: A's pattern parts them, and no piece
of B's holds both sides. So a text is cut there into pieces (``pieces_of``), each
distinct piece is encoded and grouped once, for many pieces in one call, and a
document's figures are put together from those of its pieces.

Corpus-wide, a pair of ids counts the documents (rows) that link it. Each row
sends its distinct pairs with their multiplicity; the counts are summed with
partial aggregation, so a pair found in every document is combined within the
tasks first. The counts meet the rows' pairs again in a join salted by the row
(``SALTS``), so a hot pair is spread over tasks. Per row: n_best (links whose
count is the highest of their A id, ties included) and count_sum.

The encoded pairs are written once (``materialise``) and read by both sides.
Repeated rows and doc_ids are each one document; further input columns are not
carried, so none clash; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from webtables.llm.bpe import byte_symbols
from webtables.llm.common import JOINED, LATIN_LETTER, PieceTable, before, materialise, pieces_of, slices
from webtables.operators.skew import join_summary

#: Salts of the join of the counts with the rows' pairs.
SALTS = 8
#: Text bytes that a task aligns at a time.
ALIGN_BYTES = 1 << 19
#: Aligned pieces that a task keeps.
CACHE_PIECES = 100_000
#: A pair as one long: A's id above, B's below.
SHIFT = 1 << 32

#: Pieces that begin with a Latin letter, and pieces without inner white space.
LATIN = rf"\A{LATIN_LETTER}"
PLAIN = r"\A ?[^\s\x0b\pZ\x{85}\x{1c}-\x{1f}\x{180e}]+\z"

PAIRS = "array<struct<pair:bigint,links:bigint>>"
SCHEMA = (
    f"_row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    f"groups_sha256 string, pairs {PAIRS}"
)


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        symbols = byte_symbols()
        a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, index in self.a.get_vocab(with_added_tokens=True).items():
            a_bytes[index] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        b_bytes = []
        for index in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(index)
            if self.b.is_byte(index):
                b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                b_bytes.append(piece.replace("▁", " ").encode())
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary())
        self.a_length, self.b_length = (np.array([len(x) for x in y]) for y in (a_bytes, b_bytes))
        # An id with the mark before it, as the groups' text shows it.
        ids = [(mark, n) for marks, n in ((",;", len(a_bytes)), (",|", len(b_bytes))) for mark in marks]
        self.shown = pa.array([f"{mark}{i}".encode() for mark, n in ids for i in range(n)], pa.binary())
        self.known = PieceTable(self.aligned_pieces, CACHE_PIECES)

    def _spelled(self, a: np.ndarray, b: np.ndarray, want: bytes) -> bool:
        # The tokens' bytes lie one after the other.
        taken = (t.take(pa.array(x, pa.int64())) for t, x in ((self.a_bytes, a), (self.b_bytes, b)))
        return all(len(x) and x.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(x)).as_py()] == want for x in taken)

    def _alone(self, piece: str) -> tuple[list[int], list[int]] | None:
        """Ids of one piece, None if a list does not spell it."""
        a = self.a.encode(piece, add_special_tokens=False).ids
        # What does not begin with a space stands behind a newline, of which B makes two tokens.
        b = self.b.encode(piece[1:]) if piece[0] == " " else self.b.encode("\n" + piece)[2:]
        return (a, b) if self._spelled(np.array(a), np.array(b), piece.encode()) else None

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of plain pieces, many in one text; None if a list does not spell them.

        A piece that does not begin with a space follows a word of one letter or
        mark, from which both tokenizers part it.
        """
        own, letter = pc.starts_with(pieces, " "), pc.match_substring_regex(pieces, LATIN)
        lead = pc.if_else(own, "", pc.if_else(letter, " .", " a"))
        text = pc.binary_join_element_wise(lead, pieces, "")
        at = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1].astype(np.int64)
        data = text.buffers()[2].to_pybytes()[: at[-1]]
        edges = [*at[:-1:JOINED].tolist(), int(at[-1])]
        texts = [data[x:y].decode() for x, y in itertools.pairwise(edges)]
        coded = self.a.encode_batch_fast(texts, add_special_tokens=False)
        a = np.concatenate([np.array(x.ids, np.int64) for x in coded])
        b = np.concatenate([np.array(x, np.int64) for x in self.b.encode([t[1:] for t in texts], num_threads=1)])
        if not self._spelled(a, b, data):
            return None
        begin = at[:-1] + np.frombuffer(pc.binary_length(lead).buffers()[1], np.int32)[: len(text)]
        found = []
        for ids, length in ((a, self.a_length), (b, self.b_length)):
            start = before(length[ids])
            if not (np.isin(begin, start).all() and np.isin(at, start).all()):
                return None
            found.append(ids[start[:-1] >= begin[np.searchsorted(at, start[:-1], "right") - 1]])
        return found[0], found[1]

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of all pieces in order, and which pieces they spell; others have none."""
        spelled = np.ones(len(pieces), bool)
        if len(pieces) and (ids := self._joined(pieces)):
            return *ids, spelled
        lists = [self._alone(p) for p in pieces.to_pylist()]
        spelled[:] = [x is not None for x in lists]
        a, b = (np.array([i for x in lists if x for i in x[k]], np.int64) for k in (0, 1))
        return a, b, spelled

    def aligned_pieces(self, pieces: pa.Array) -> pa.RecordBatch:
        """Of each piece: whether both lists spell it, the numbers of A's and B's tokens and
        of groups, all links' pairs (64-bit integers) and the groups' text after a mark."""
        plain = pc.match_substring_regex(pieces, PLAIN)
        begin = pc.match_substring_regex(pieces, r"\A[ -~]")
        plain = pc.and_(plain, pc.or_(begin, pc.match_substring_regex(pieces, LATIN)))
        # Plain ones first, all others alone.
        others = pieces.filter(pc.invert(plain))
        pieces = pieces.filter(plain)
        a, b, spelled = self._encoded(pieces)
        single = [self._alone(p) for p in others.to_pylist()]
        a, b = (np.concatenate([x, *[np.array(y[k], np.int64) for y in single if y]]) for k, x in enumerate((a, b)))
        spelled = np.concatenate([spelled, np.array([x is not None for x in single], bool)])
        pieces = pa.concat_arrays([pieces, others])
        size = np.where(spelled, pc.binary_length(pieces).to_numpy(zero_copy_only=False), 0)
        # Where tokens of both end, a group ends.
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        place = np.searchsorted(b_end, a_end)
        a_last = np.flatnonzero(np.append(b_end, -1)[place] == a_end)
        b_last = place[a_last]
        of = np.searchsorted(np.cumsum(size), a_end[a_last])
        n_a, n_b = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        a_first, b_first = a_last - n_a + 1, b_last - n_b + 1
        # A group shows its ids of A, then those of B.
        code = np.empty(len(a) + len(b), np.int64)
        vocabulary = len(self.a_length)
        a_code, b_code = a.copy(), b + 2 * vocabulary
        a_code[a_first] += vocabulary
        b_code[b_first] += len(self.b_length)
        code[np.arange(len(a)) + np.repeat(before(n_b)[:-1], n_a)] = a_code
        code[np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)] = b_code
        shown = self.shown.take(pa.array(code))
        links = n_a * n_b
        group = np.repeat(np.arange(len(links)), links)
        k = np.arange(len(group)) - np.repeat(before(links)[:-1], links)
        pairs = a[a_first[group] + k // n_b[group]] * SHIFT + b[b_first[group] + k % n_b[group]]
        n = len(pieces)
        counts = [np.bincount(of, x, n).astype(np.int64) for x in (n_a, n_b, np.ones(len(of)), links)]
        # The ids' texts lie one after the other, so those of a piece are one text.
        at = np.frombuffer(shown.buffers()[1], np.int32)[: len(code) + 1] if len(code) else np.zeros(1, np.int32)
        at = np.ascontiguousarray(at[before(counts[0] + counts[1])])
        columns = {
            "piece": pieces,
            "spelled": pa.array(spelled),
            "n_a": pa.array(counts[0]),
            "n_b": pa.array(counts[1]),
            "n_groups": pa.array(counts[2]),
            "pairs": pa.ListArray.from_arrays(pa.array(before(counts[3]), pa.int32()), pa.array(pairs)),
            "shown": pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), shown.buffers()[2]]),
        }
        return pa.RecordBatch.from_pydict(columns)

    def columns(self, texts: pa.Array) -> list[pa.Array]:
        """The columns of SCHEMA after doc_id for every text."""
        pieces, bounds = pieces_of(pc.fill_null(texts, ""))
        found = self.known.rows(pieces)
        present = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False)

        def total(values: np.ndarray) -> np.ndarray:
            return np.diff(before(values)[bounds])

        good = present & (total(~found["spelled"].to_numpy(zero_copy_only=False)) == 0)
        figures = [total(found[c].to_numpy()) for c in ("n_a", "n_b", "n_groups")]
        n_links = total(pc.list_value_length(found["pairs"]).to_numpy(zero_copy_only=False))
        figures = [np.where(good, x, 0) for x in (*figures, n_links)]
        # A text's groups are those of its pieces, but for the mark before the first.
        shown = memoryview(found["shown"].buffers()[2] or b"")
        at = np.frombuffer(found["shown"].buffers()[1], np.int32)[bounds].tolist()
        digests = [
            hashlib.sha256(shown[x + 1 : y]).hexdigest() if ok else ""
            for ok, (x, y) in zip(good.tolist(), itertools.pairwise(at), strict=True)
        ]
        # Distinct pairs per text: the text's number above A's id; texts are few.
        bits = 32 + len(self.a_length).bit_length()
        text = np.repeat(np.arange(len(texts)), n_links)
        pair = found["pairs"].flatten().to_numpy()
        key, n = np.unique((text << bits | pair)[good[text]], return_counts=True)
        sizes = np.bincount(key >> bits, minlength=len(texts))
        entries = pa.StructArray.from_arrays([pa.array(key & ((1 << bits) - 1)), pa.array(n)], ["pair", "links"])
        ends = pa.array(before(sizes), pa.int32())
        return [*map(pa.array, figures), pa.array(digests, pa.string()), pa.ListArray.from_arrays(ends, entries)]


@functools.lru_cache(maxsize=2)
def aligner(byte_bpe: str, pieces: bytes) -> Aligner:
    return Aligner(byte_bpe, pieces)


def aligned(documents: DataFrame, byte_bpe_path: str, pieces_path: str) -> DataFrame:
    """Per row (numbered ``_row``): doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256 and its distinct linked pairs with their numbers of links."""
    spark = documents.sparkSession
    with open(byte_bpe_path, encoding="utf-8") as file:
        byte_bpe = spark.sparkContext.broadcast(file.read())
    with open(pieces_path, "rb") as file:
        pieces = spark.sparkContext.broadcast(file.read())
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = aligner(byte_bpe.value, pieces.value)
        for part in slices(batches, "text", ALIGN_BYTES):
            columns = [part["_row"], part["doc_id"], *model.columns(part["text"])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    numbered = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    return numbered.mapInArrow(run, SCHEMA)


def alignment(documents: DataFrame, byte_bpe_path: str, pieces_path: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = materialise(aligned(documents, byte_bpe_path, pieces_path))
    links = rows.select("_row", F.explode("pairs").alias("p")).select("_row", "p.pair", "p.links")
    counts = links.groupBy("pair").agg(F.count("*").alias("docs"))
    best = counts.groupBy(F.shiftright("pair", 32).alias("_a")).agg(F.max("docs").alias("_best"))
    scored = counts.join(best, F.shiftright("pair", 32) == F.col("_a")).select(
        "pair", "docs", (F.col("docs") == F.col("_best")).alias("_top")
    )
    joined = join_summary(links, scored, "pair", "_row", SALTS)
    sums = joined.groupBy("_row").agg(
        F.sum(F.when(F.col("_top"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("docs")).alias("count_sum"),
    )
    return rows.drop("pairs").join(sums, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
