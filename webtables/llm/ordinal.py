"""Quality classifier (operator 4): ordinal cumulative-link regression.

A document's score is the sum of shared weights of its hashed text features;
ordered thresholds cut the score into grades: P(grade > k) = s(score - cut k)
with the logistic function s. From it come the expected grade and the tail
probability that selection goes by. Grades of the labels: 0 toxic, 1 of low
quality, 2 good (a missing mark counts as good on its side; without both the
label is left out). A doc_id with several labels has the lowest of its grades.

The model is fitted on at most ``train_rows`` labelled documents, those whose
doc_id hashes lowest; every document is scored, by its whole text. Null and
empty texts have no features but the shape of an empty text. Without labels
all weights are 0 and the tail probability is 1, so that nothing is rejected.
Rows are scored one by one: ties, repeated rows and further columns are
harmless; columns of the names that are added are replaced.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from webtables.llm.common import CACHE_WORDS, extended, extended_schema, filtered, slices, words_of

#: Features are hashed into so many weights (1 MB, the size of the broadcast model).
DIMENSION = 1 << 18
GRADES = 3
#: Lengths of the beginnings of words that are features, in characters.
PREFIXES = (3, 4, 5, 7)
#: Bound of the labelled documents that the model is fitted on.
TRAIN_ROWS = 12_000
#: Rows whose features a step of the fit sums at a time.
FIT_ROWS = 1000
#: Documents pass if the probability of the best grade is at least this.
SELECT = 0.5


@dataclasses.dataclass(frozen=True)
class Model:
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) of every score, a column per cut."""
        if not len(self.cuts):
            return np.ones((len(score), GRADES - 1))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts, -30, 30)))


def shape_words(text: str) -> list[bytes]:
    """The text's form as further words: lengths, shares of kinds of characters, repeats."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    upper = ((raw >= 65) & (raw <= 90)).sum() / n
    digit = ((raw >= 48) & (raw <= 57)).sum() / n
    letter = ((raw >= 97) & (raw <= 122)).sum() / n + upper + (raw >= 128).sum() / n
    marks = np.isin(raw, np.frombuffer(b"#$%&*!|<>{}[]=_~^\\/@", np.uint8)).sum() / n
    lines = [x for x in text.split("\n") if x]
    words = text.split()
    level = lambda x: int(np.ceil(np.log2(x * 1000 + 1)))
    facts = {
        "length": int(np.log2(len(raw) + 1)),
        "upper": level(upper),
        "digit": level(digit),
        "other": level(1 - letter),
        "marks": level(marks),
        "line repeats": level(1 - len(set(lines)) / max(1, len(lines))),
        "word repeats": int(10 * len(set(words)) / max(1, len(words))),
        "line words": int(np.log2(len(words) / max(1, len(lines)) + 1)),
    }
    return [f"\0{k} {v}".encode() for k, v in facts.items()]


class FeatureCache(dict):
    """Packed feature numbers of words: the word itself and its first characters."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        parts = [word, *[b"\1" + text[:k].encode() for k in PREFIXES if len(text) >= k]]
        numbers = [xxhash.xxh3_64_intdigest(x) % DIMENSION for x in parts]
        value = self[word] = np.array(numbers, np.int32).tobytes()
        return value


def features(texts: list[str | None], cache: FeatureCache) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of all texts in a flat array, and each text's bounds."""
    rows = []
    for text in texts:
        words = {*words_of(text), *shape_words(text or "")} - {b""}
        rows.append(np.unique(np.frombuffer(b"".join([cache[w] for w in words]), np.int32)))
    return np.concatenate([*rows, np.zeros(0, np.int32)]), np.cumsum([0, *map(len, rows)])


def score(model: Model, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    # No text is without features, so no sum is over an empty range.
    return np.add.reduceat(model.weights[flat], bounds[:-1]) if len(bounds) > 1 else np.zeros(0)


def fit(
    flat: np.ndarray, bounds: np.ndarray, grade: np.ndarray, rounds: int = 200, ridge: float = 3e-4
) -> Model:
    """Maximum likelihood with a ridge penalty by Adam steps over all rows."""
    weights, n = np.zeros(DIMENSION), len(grade)
    if not n:
        return Model(weights, np.zeros(0))
    # Features of very few documents tell nothing.
    common = np.bincount(flat, minlength=DIMENSION) >= max(2, n // 1000)
    keep = common[flat] | np.isin(np.arange(len(flat)), bounds[:-1])
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))[keep]
    flat = flat[keep]
    bounds = np.searchsorted(row, np.arange(n + 1))
    # Sums over the features go chunk by chunk, so that no copy of all is needed.
    chunks = [(a, min(n, a + FIT_ROWS)) for a in range(0, n, FIT_ROWS)]
    share = np.bincount(grade, minlength=GRADES) + 1.0
    # Each grade weighs as the root of its share, so that rare grades count.
    cost = np.sqrt(share.sum() / share / GRADES)[grade]
    above = np.cumsum(share[::-1])[::-1][1:] / share.sum()
    cuts = -np.log(above / (1 - above))
    first = [np.zeros(DIMENSION), np.zeros(GRADES - 1)]
    second = [np.zeros(DIMENSION), np.zeros(GRADES - 1)]
    k = np.arange(GRADES - 1)
    low, high = grade > 0, grade < GRADES - 1
    for step in range(1, rounds + 1):
        s = np.concatenate(
            [np.add.reduceat(weights[flat[bounds[a] : bounds[b]]], bounds[a:b] - bounds[a]) for a, b in chunks]
        )
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))
        upper = np.where(low, p[np.arange(n), np.maximum(grade - 1, 0)], 1.0)
        lower = np.where(high, p[np.arange(n), np.minimum(grade, GRADES - 2)], 0.0)
        mass = np.maximum(upper - lower, 1e-9)
        up, down = upper * (1 - upper), lower * (1 - lower)
        slope_s = -cost * (up - down) / mass
        of_cuts = np.array(
            [(cost * np.where(grade - 1 == c, up, 0) / mass - cost * np.where(grade == c, down, 0) / mass).sum() for c in k]
        )
        slope = ridge * weights
        for a, b in chunks:
            part = slice(bounds[a], bounds[b])
            slope += np.bincount(flat[part], weights=slope_s[row[part]], minlength=DIMENSION) / n
        slopes = [slope, of_cuts / n]
        for i, (value, rate) in enumerate(((weights, 0.03), (cuts, 0.03))):
            first[i] = 0.9 * first[i] + 0.1 * slopes[i]
            second[i] = 0.99 * second[i] + 0.01 * slopes[i] ** 2
            value -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
        cuts.sort()
    return Model(weights.astype(np.float32), cuts)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of every labelled document."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)
    known = labels.filter("doc_id is not null and (toxic is not null or quality is not null)")
    return known.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit the model; at most ``train_rows`` rows of features come to the driver."""
    sample = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # At most train_rows rows of 12 bytes, so the sample may be broadcast.
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "grade")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = FeatureCache()
        for part in slices(batches, "text"):
            flat, bounds = features(part["text"].to_pylist(), cache)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([part["grade"], lists], names=["grade", "features"])

    found = rows.dropDuplicates(["doc_id"]).mapInArrow(run, "grade int, features array<int>").toArrow()
    lists = found["features"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return fit(lists.flatten().to_numpy(), lists.offsets.to_numpy(), found["grade"].to_numpy())


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """Add ``expected_grade``, ``tail`` (probability of the best grade) and ``selected``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = FeatureCache()
        for part in slices(batches, "text"):
            above = shared.value.above(score(shared.value, *features(part["text"].to_pylist(), cache)))
            yield extended(
                part,
                expected_grade=pa.array(above.sum(axis=1), pa.float64()),
                tail=pa.array(above[:, -1], pa.float64()),
                selected=pa.array(above[:, -1] >= SELECT, pa.bool_()),
            )

    schema = extended_schema(documents.schema, "expected_grade double, tail double, selected boolean")
    return documents.mapInArrow(run, schema)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, expected_grade, tail, selected."""
    texts = documents.select("doc_id", "text")
    return scored(texts, train(texts, labels)).drop("text")


def select(documents: DataFrame, model: Model, least: float = SELECT) -> DataFrame:
    """The documents, with their columns as they are, whose tail probability is at least ``least``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def passes(texts: list[str | None], cache: FeatureCache) -> np.ndarray:
        return shared.value.above(score(shared.value, *features(texts, cache)))[:, -1] >= least

    return filtered(documents, passes, FeatureCache)
