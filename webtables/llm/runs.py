"""Periodic run detection (operator 12): maximal repetitions of words.

Words are the runs of ``[^\\x20\\x09-\\x0D]``, numbered from 0. A run is a
maximal stretch with smallest period q (words q apart are equal) and at least
``max(MIN_LENGTH, MIN_EXPONENT * q)`` words; no neighbouring word extends it
with period q. ``collapsed`` keeps every word but those that lie in a run
after its first q words: the repeats of a loop are cut to one turn.

Method, per document: the words become integer symbols; their suffixes are
sorted (prefix doubling) once under the order of the symbols and once under the
reversed order, the sentinel smallest in both. The Lyndon array follows from
each sorting as the distance to the next smaller suffix rank. By the runs
theorem every run holds a Lyndon root that is the longest Lyndon word at its
place under one of the two orders, so each such word of length p is extended
left and right by longest common extensions with the word p further on; the
stretches of at least 2p are the runs. A root inside a run already found for p
is skipped, so every run is extended once per order. A run of the least length
repeats a window of ``REPEAT`` words; texts in which no such window comes twice
(by hashes of the windows) hold no run and are not sorted.

Spark reads the documents and runs this in Arrow batches of about
``SLICE_BYTES`` of text (``mapInArrow``); nothing is shuffled and a task holds
one slice and the arrays of one document (linear in its words).

Cases: a null text has no words (like an empty one): n_runs 0, the best run's
four columns null, runs_sha256 and collapsed_sha256 the hashes of the empty
string. A null doc_id is not perturbed (it has no decimal form). Repeated rows
and doc_ids are each computed. Ties of the best run: greatest exact
length/period, then smallest start, then period. Other columns of the input are
not carried; the result is one row per input row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webtables.llm.common import slices

#: Fixed values of the contract: the words, the least run, the planted loops.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIN_LENGTH = 24
MIN_EXPONENT = 3
PLANT_EVERY = 10

#: Words q apart agree over at least this many places in every run of the least
#: length (a rule of MIN_LENGTH and MIN_EXPONENT): a text in which no window of
#: this many words comes twice holds no run, and is not sorted.
REPEAT = min(max(MIN_LENGTH, MIN_EXPONENT * q) - q for q in range(1, MIN_LENGTH + 1))
_MIX = np.random.default_rng(12345).integers(1, 2**63, size=REPEAT, dtype=np.uint64) | np.uint64(1)

SCHEMA = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, "
    "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words, in one of PLANT_EVERY documents (by crc32 of the decimal
    doc_id) turned from a place a on into a loop of period p of the words after a."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % PLANT_EVERY:
        return words
    g = h // PLANT_EVERY
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank of every suffix (0 = smallest); a suffix that is a prefix of another is smaller."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        if k < n:
            after[: n - k] = rank[k:]
        order = np.lexsort((after, rank))
        keys_rank, keys_after = rank[order], after[order]
        new_group = np.empty(n, dtype=bool)
        new_group[0] = True
        new_group[1:] = (keys_rank[1:] != keys_rank[:-1]) | (keys_after[1:] != keys_after[:-1])
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.cumsum(new_group) - 1
        rank = fresh
        if new_group.all() or k >= n:
            return rank
        k *= 2


def lyndon_array(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every place: the distance to the next
    place of smaller suffix rank (or the end)."""
    n = len(rank)
    out = np.empty(n, dtype=np.int64)
    stack: list[int] = []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        out[i] = (stack[-1] if stack else n) - i
        stack.append(i)
    return out


def common_extension(symbols: np.ndarray, i: int, j: int) -> int:
    """How many symbols from i and from j are equal (j > i), by galloping blocks."""
    n = len(symbols)
    done, step = 0, 32
    while j + done < n:
        size = min(step, n - j - done)
        differ = np.flatnonzero(symbols[i + done : i + done + size] != symbols[j + done : j + done + size])
        if len(differ):
            return done + int(differ[0])
        done += size
        step *= 2
    return done


def maximal_runs(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """Every maximal repetition (start, length, smallest period) of at least twice its period."""
    n = len(symbols)
    if n < 2:
        return []
    backward = symbols[::-1].copy()
    found: dict[tuple[int, int], int] = {}
    for ordered in (symbols, -symbols):
        lyndon = lyndon_array(suffix_ranks(ordered))
        reach: dict[int, tuple[int, int]] = {}
        # A root extends to twice its length only if a neighbour on one side repeats.
        places = np.arange(n)
        partner = places + lyndon
        inside = partner < n
        right_equal = np.zeros(n, dtype=bool)
        right_equal[inside] = symbols[places[inside]] == symbols[partner[inside]]
        left_equal = np.zeros(n, dtype=bool)
        left = inside & (places > 0)
        left_equal[left] = symbols[places[left] - 1] == symbols[partner[left] - 1]
        for i in np.flatnonzero(right_equal | left_equal).tolist():
            p = int(lyndon[i])
            known = reach.get(p)
            if known and known[0] <= i and i + p <= known[1]:
                continue
            right = common_extension(symbols, i, i + p)
            left = common_extension(backward, n - i - p, n - i) if i else 0
            start, end = i - left, i + p + right
            if end - start >= 2 * p:
                reach[p] = (start, end)
                found[(start, p)] = end - start
    return sorted((s, length, p) for (s, p), length in found.items())


def may_repeat(symbols: np.ndarray, width: int = REPEAT) -> bool:
    """Whether some window of ``width`` symbols may come twice (hashes of the
    windows; a collision only costs the full search, never a run)."""
    count = len(symbols) - width + 1
    if count < 2:
        return False
    mixed = np.zeros(count, dtype=np.uint64)
    values = symbols.astype(np.uint64)
    for j in range(width):
        mixed += values[j : j + count] * _MIX[j]
    return len(np.unique(mixed)) < count


def analyse(doc_id: int | None, text: str | None) -> tuple:
    """The result row of one document (see the module's docstring)."""
    words = planted(WORD.findall(text or ""), doc_id)
    n = len(words)
    number: dict[str, int] = {}
    symbols = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    found = maximal_runs(symbols) if may_repeat(symbols) else []
    runs = [r for r in found if r[1] >= max(MIN_LENGTH, MIN_EXPONENT * r[2])]
    runs.sort(key=lambda r: (r[0], r[2]))
    drop = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.cumsum(drop[:n]) == 0
    collapsed = " ".join(w for w, k in zip(words, kept) if k)
    listing = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    figures = [None] * 4
    if best:
        figures = [best[0], best[1], best[2], 1000 * best[1] // best[2]]
    return (
        doc_id,
        n,
        len(runs),
        *figures,
        hashlib.sha256(listing.encode()).hexdigest(),
        hashlib.sha256(collapsed.encode("utf-8", "surrogatepass")).hexdigest(),
    )


def runs(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_runs, the best run's start, length, period,
    exponent_milli, runs_sha256 and collapsed_sha256."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [analyse(d, t) for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist())]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            types = [pa.int64()] * 7 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
