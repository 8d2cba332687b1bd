"""Language identification (operator 10) with language-bitmask n-gram filters.

Character n-grams of one to four letters (a word's edge counts as a letter) of
the training texts are counted per language. A language holds the n-grams that
make up at least MIN_SHARE of its own and are not far rarer there than in the
language where they are most frequent. A bit-sliced Bloom filter keeps, per
slot, one bit for each language: the bitwise AND of an n-gram's slots is the set
of all languages holding it. A text's bits are counted per language, less the
false positives to be expected from how full the language's slice is, and the
language with the most n-grams wins (ties: the first in alphabetical order).
The score is the share of the text's n-grams that the language holds.

Results: ``und`` with score 0 for null texts, texts without a letter, and for
all texts if nothing was learned. Only rows with text, lang and doc_id are
learned from. Predictions use the text alone; rows are treated one by one.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from webtables.llm.common import extended, extended_schema, filtered, materialise, mix, slices

LENGTHS = (1, 2, 3, 4)
#: A language holds at most 1 / MIN_SHARE n-grams, which bounds the model's size.
MIN_SHARE = 2e-5
#: How much rarer than in its most frequent language an n-gram may be.
RARER = 0.05
PROBES = 3
SLOTS_PER_GRAM = 16
#: Distinct n-grams that a task counts before it passes them on.
HELD_GRAMS = 1 << 20
#: Text bytes whose n-grams a task holds at a time.
GRAM_BYTES = 2 << 20
UNDETERMINED = "und"
#: The share of n-grams that a language must hold for a document to stay in it.
LEAST_SCORE = 0.3


@functools.cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (lower-cased runs of letters) of the texts, the number of
    each word of the texts in turn, and each text's bounds among these."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    parts = pc.split_pattern(pc.replace_substring_regex(lower, "\\PL+", " "), " ")
    coded = parts.flatten().dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), bounds


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length, the hashes of all n-grams and the text each is from."""
    lowered = ["\0" + (t or "").lower() + "\0" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, lowered), np.int64, len(lowered)))
    letter = letters()[codes]
    keep = letter | np.concatenate([letter[1:], [False]]) | np.concatenate([[False], letter[:-1]])
    # Between two words one edge is enough, and it may be shared.
    codes, owner, letter = np.where(letter, codes, 0)[keep].astype(np.uint64), owner[keep], letter[keep]
    for n in LENGTHS:
        m = len(codes) - n + 1
        if m <= 0:
            break
        inner = letter[:m].copy() if n == 1 else np.ones(m, bool)
        for i in range(1, n - 1):
            inner &= letter[i : i + m]
        if n == 2:
            inner &= letter[:m] | letter[1 : 1 + m]
        inner &= owner[:m] == owner[n - 1 :]
        value = np.full(m, n, np.uint64)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + codes[i : i + m]
        yield mix(value[inner]), owner[:m][inner]


@dataclasses.dataclass(frozen=True)
class Filters:
    languages: list[str]
    slots: np.ndarray  # (words of 64 languages, slots)

    @staticmethod
    def build(held: dict[str, np.ndarray]) -> Filters:
        languages = sorted(held)
        most = max([1, *map(len, held.values())])
        size = 1 << int(np.ceil(np.log2(SLOTS_PER_GRAM * most)))
        slots = np.zeros((-(-len(languages) // 64), size), np.uint64)
        for i, name in enumerate(languages):
            for at in Filters.probes(held[name].view(np.uint64), size):
                slots[i // 64, at] |= np.uint64(1) << np.uint64(i % 64)
        return Filters(languages, slots)

    @staticmethod
    def probes(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        step = mix(hashes + np.uint64(1)) | np.uint64(1)
        return [((hashes + step * np.uint64(j)) & np.uint64(size - 1)).astype(np.int64) for j in range(PROBES)]

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """Bits of all languages that hold each n-gram."""
        at = self.probes(hashes, self.slots.shape[1])
        return functools.reduce(np.bitwise_and, [self.slots[:, a] for a in at])

    def bit(self, bits: np.ndarray, i: int) -> np.ndarray:
        return (bits[i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    @functools.cached_property
    def false_positives(self) -> np.ndarray:
        full = [self.bit(self.slots, i).mean() for i in range(len(self.languages))]
        return np.array(full) ** PROBES

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language and the score of every text; a word's n-grams are looked up once."""
        if not self.languages or not len(texts):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        distinct, index, bounds = words(texts)
        # Row i counts the n-grams that language i holds, the last row all.
        of_word = np.zeros((len(self.languages) + 1, len(distinct)))
        for hashes, owner in grams(distinct):
            bits = self.masks(hashes)
            for i in range(len(self.languages)):
                of_word[i] += np.bincount(owner[self.bit(bits, i) > 0], minlength=len(distinct))
            of_word[-1] += np.bincount(owner, minlength=len(distinct))
        sums = np.zeros((len(of_word), len(index) + 1))
        np.cumsum(of_word[:, index], axis=1, out=sums[:, 1:])
        *hits, total = np.diff(sums[:, bounds], axis=1)
        hits = np.stack(hits)
        wrong = self.false_positives[:, None]
        true = np.clip((hits - total * wrong) / np.maximum(1 - wrong, 1e-9), 0, None)
        best = true.argmax(axis=0)
        score = np.clip(true.max(axis=0) / np.maximum(total, 1), 0, 1)
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best, total, strict=True)]
        return names, np.where(total > 0, score, 0.0)


def counted(training: DataFrame) -> DataFrame:
    """lang, gram and count over rows of text and lang, summed within tasks first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for name, (gram, count) in held.items():
                names = pa.DictionaryArray.from_arrays(np.zeros(len(gram), np.int32), [name]).cast(pa.string())
                columns = [names, pa.array(gram.view(np.int64)), pa.array(count)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])
            held.clear()

        for part in slices(batches, "text", GRAM_BYTES):
            distinct, index, bounds = words(part["text"])
            langs = np.repeat(np.array(part["lang"].to_pylist(), object), np.diff(bounds))
            for name in set(part["lang"].to_pylist()):
                of_word = np.bincount(index[langs == name], minlength=len(distinct))
                found = [held[name]] if name in held else []
                for hashes, owner in grams(distinct):
                    uses = of_word[owner]
                    # Hashing finds equal n-grams faster than sorting; few are left to be sorted.
                    coded = pa.array(hashes[uses > 0]).dictionary_encode()
                    count = np.bincount(coded.indices.to_numpy(), uses[uses > 0], len(coded.dictionary))
                    found.append((coded.dictionary.to_numpy(), count))
                # Texts without a letter have no n-grams.
                if not found:
                    continue
                gram, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                count = np.bincount(at, np.concatenate([c for _, c in found]), len(gram))
                held[name] = (gram, count.astype(np.int64))
            if sum(len(g) for g, _ in held.values()) > HELD_GRAMS:
                yield from rows()
        yield from rows()

    return training.select("text", "lang").mapInArrow(run, "lang string, gram bigint, n bigint")


def learn(training: DataFrame) -> Filters:
    """Filters of every language in rows of text and lang, all of which are counted.

    At most 1 / MIN_SHARE n-grams per language come to the driver.
    """
    known = training.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # Written, as the totals and the shares both read them.
    counts = materialise(counted(known).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sums = known.sparkSession.createDataFrame(counts.groupBy("lang").agg(F.sum("n").alias("total")).collect(), "lang string, total bigint")
    shares = counts.join(F.broadcast(sums), "lang").withColumn("share", F.col("n") / F.col("total"))
    frequent = shares.filter(F.col("share") >= MIN_SHARE)
    each = frequent.groupBy("gram").agg(F.collect_list(F.struct("share", "lang")).alias("in"))
    top = F.array_max("in")["share"] * RARER
    held = each.select("gram", F.explode(F.filter("in", lambda x: x["share"] >= top)["lang"]).alias("lang"))
    table = held.toArrow()
    gram = table["gram"].to_numpy()
    lang = np.array(table["lang"].to_pylist(), object)
    return Filters.build({str(name): gram[lang == name] for name in set(lang)})


def identified(documents: DataFrame, filters: Filters) -> DataFrame:
    """Add ``lang_pred`` and ``score``; columns of these names are replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", GRAM_BYTES):
            names, score = shared.value.predict(part["text"])
            yield extended(part, lang_pred=pa.array(names, pa.string()), score=pa.array(score, pa.float64()))

    return documents.mapInArrow(run, extended_schema(documents.schema, "lang_pred string, score double"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from; a null doc_id counts as none of them."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def learn_from(documents: DataFrame) -> Filters:
    return learn(documents.filter(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang"))


def languages(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    texts = documents.select("doc_id", held_out().alias("held_out"), "text")
    return identified(texts, learn_from(documents)).drop("text")


def recognised(documents: DataFrame, filters: Filters, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, with their columns as they are, whose language is told with at least this score."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def passes(texts: list[str | None], _: object) -> np.ndarray:
        names, score = shared.value.predict(pa.array(texts, pa.string()))
        return (np.array(names, object) != UNDETERMINED) & (score >= least)

    return filtered(documents, passes, object, GRAM_BYTES)
