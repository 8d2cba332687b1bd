"""BPE encoding and decoding (operator 1) in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks all adjacent
pairs up in the sorted pair keys by binary search, finds each word's lowest
rank and joins all pairs of that rank; words without a known pair leave.

Results: ids equal those of the tokenizers library for a byte-level BPE file
with ``add_special_tokens=False`` (added tokens that a text spells out are
matched). Null and empty texts have no ids and decode to an empty text. A text
of any length is encoded whole. Rows are treated one by one, so repeated rows,
ties and further columns pass through; a column named like a new one is replaced.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from webtables.llm.common import ENCODE_BYTES, ChunkIds, extended, extended_schema, slices

#: The pattern of byte-level BPE, as the vocabularies' package states
#: it, with the white-space class spelled out.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Before a lone space between two other characters a new piece always begins. Here
#: more counts as white space than in the pattern, which at most leaves chunks longer.
SPACE = r"[\s\pZ\x{85}\x{1c}-\x{1f}\x{180e}]"
IRREGULAR = rf"{SPACE}{SPACE}|\A{SPACE}|{SPACE}\z"
OTHER = SPACE.replace("[", "[^", 1)


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the
    others in order from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def split_texts(texts: pa.Array, special: regex.Pattern | None) -> tuple[pa.Array, np.ndarray]:
    """Cut texts into chunks that are encoded alike alone; rows' bounds in the chunks.

    NUL marks the cuts. Texts that hold one, or an added token, are cut at
    the added tokens only.
    """
    plain = pc.replace_substring(texts, " ", "\0 ")
    odd = pc.match_substring_regex(texts, IRREGULAR)
    if pc.any(odd).as_py():
        careful = pc.replace_substring_regex(texts.filter(odd), f"({OTHER}) ({OTHER})", "\\1\0 \\2")
        plain = pc.replace_with_mask(plain, odd, careful)
    marked = pc.match_substring(texts, "\0")
    if special:
        marked = pc.or_(marked, pc.match_substring_regex(texts, special.pattern))
    parts = pc.split_pattern(plain, "\0")
    if pc.any(marked).as_py():
        whole = [special.split(x) if special else [x] for x in texts.filter(marked).to_pylist()]
        lists = parts.to_pylist()
        for i, x in zip(np.flatnonzero(marked.to_numpy(zero_copy_only=False)), whole, strict=True):
            lists[i] = x
        parts = pa.array(lists, pa.list_(pa.string()))
    return parts.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])


class ByteBpe:
    """A byte-level BPE model read from a tokenizer file's text."""

    def __init__(self, definition: str) -> None:
        parts = json.loads(definition)
        vocab, symbols = parts["model"]["vocab"], byte_symbols()
        added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes = np.full(self.size, b"", object)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in parts["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.added = {token: np.array([i], "<u4").tobytes() for token, i in added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.chunks = ChunkIds()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as little-endian 32-bit integers."""
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = np.flatnonzero((owner[1:] == owner[:-1]) & (self.keys[at] == key))
            if not len(known):
                break
            rank, word = self.ranks[at[known]], owner[known]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            pick = known[rank == np.repeat(lowest, np.diff(np.append(first, len(word))))]
            # Of pairs that overlap (a symbol three times or more), every other one counts.
            run = np.maximum.accumulate(
                np.where(np.concatenate([[True], np.diff(pick) != 1]), np.arange(len(pick)), 0)
            )
            pick = pick[(np.arange(len(pick)) - run) % 2 == 0]
            symbols[pick] = self.merged[at[pick]]
            keep = np.ones(len(symbols), bool)
            keep[pick + 1] = False
            going = np.zeros(len(words), bool)
            going[word[first]] = True
            leave = keep & ~going[owner]
            done.append((owner[leave], symbols[leave]))
            keep &= ~leave
            symbols, owner = symbols[keep], owner[keep]
        done.append((owner, symbols))
        owner = np.concatenate([o for o, _ in done])
        order = np.argsort(owner, kind="stable")
        flat = np.concatenate([s for _, s in done])[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(words)))
        return [flat[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that the pattern splits alike alone and within their text."""
        split = [[c] if c in self.added else PATTERN.findall(c) for c in chunks]
        words = list({w for parts in split for w in parts} - self.added.keys())
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        ids |= self.added
        return [b"".join([ids[w] for w in parts]) for parts in split]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of every text as little-endian 32-bit integers, of null as none."""
        chunks, rows = split_texts(pc.fill_null(texts, ""), self.special)
        return self.chunks.encode(chunks, rows, self.encode_chunks)

    def decode(self, ids: bytes) -> str:
        """The tokens' bytes as text; what is no UTF-8 becomes U+FFFD."""
        tokens = self.token_bytes[np.frombuffer(ids, "<u4")]
        return b"".join(tokens.tolist()).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def model(definition: str) -> ByteBpe:
    return ByteBpe(definition)


def _shared(frame: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        return frame.sparkSession.sparkContext.broadcast(file.read())


def encode(texts: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Add ``token_ids`` (binary: little-endian 32-bit ids) and ``n_tokens``."""
    definition = _shared(texts, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(definition.value)
        for part in slices(batches, column, ENCODE_BYTES):
            ids = bpe.encode(part[column])
            counts = pc.cast(pc.divide(pc.binary_length(ids), 4), pa.int64())
            yield extended(part, token_ids=ids, n_tokens=counts)

    return texts.mapInArrow(run, extended_schema(texts.schema, "token_ids binary, n_tokens bigint"))


def decode(encoded: DataFrame, path: str, column: str = "token_ids") -> DataFrame:
    """Add ``decoded``, the text of the ids in a binary column; null ids give an empty text."""
    definition = _shared(encoded, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(definition.value)
        for part in slices(batches, column):
            texts = [bpe.decode(x or b"") for x in part[column].to_pylist()]
            yield extended(part, decoded=pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, extended_schema(encoded.schema, "decoded string"))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Per document: the number of ids, and digests of the ids and of the decoded text."""
    encoded = encode(documents.select("doc_id", "text"), path).drop("text")
    return decode(encoded, path).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
