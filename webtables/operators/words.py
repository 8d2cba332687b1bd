"""Words of documents or websites: texts, counts, weights.

A ``docs`` table may hold several rows per document (the pages of a site):
``key`` names the document, ``ordinal`` the order of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window, functions as F

from webtables.functions import text as X, urls
from webtables.operators.packed import packed, unpacked
from webtables.operators.skew import FREQUENT, frequent_keys, join_frequent, join_summary, with_part
from webtables.sources.tables import materialise

# Characters of a row of joined texts before the next text begins a new one.
TEXT_LIMIT = 50_000_000
# Words of a row of count maps.
MAP_WORDS = 100_000


def default_stop_words() -> list[str]:
    """Spark's English list; every operator takes another one instead."""
    return StopWordsRemover.loadDefaultStopWords("english")


def with_netloc(pages: DataFrame) -> DataFrame:
    return pages.withColumn("netloc", urls.netloc(F.col("url")))


def joined_texts(
    docs: DataFrame, key: str, ordinal: str, text: str = "text", limit: int = TEXT_LIMIT
) -> DataFrame:
    """Texts of each key joined by ``' | '`` in order: key, part, text.

    A key's texts are cut into parts of ``limit`` characters, a text staying
    whole in the part that it begins in.
    """
    placed = with_part(
        docs.select(key, ordinal, text), key, [ordinal], limit, F.coalesce(F.length(text), F.lit(0))
    )
    parts = F.array_sort(F.collect_list(F.struct(ordinal, text)))
    return placed.groupBy(key, "part").agg(
        F.array_join(F.transform(parts, lambda p: p[text]), " | ").alias("text")
    )


def word_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Occurrences per key and word: key, word, n.

    The joining mark between a key's texts holds no word, so counting row by
    row equals counting the joined text.
    """
    return (
        docs.select(key, F.explode(X.words(F.col(text))).alias("word"))
        .filter(F.col(key).isNotNull() & F.col("word").isNotNull())
        .groupBy(key, "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ordered_word_counts(
    docs: DataFrame, key: str, ordinal: str, text: str = "text"
) -> DataFrame:
    """Word counts with where each word first occurs: key, word, n, first_ord, first_pos.

    ``first_pos`` is the word's rank among the distinct words of row
    ``first_ord``. Each row gives its words once for counting and its distinct
    words once for position, so one hash aggregation finds both.
    """
    found = X.words(F.col(text))
    count_entry = F.transform(
        F.col("found"),
        lambda w: F.struct(
            w.alias("word"),
            F.lit(1).alias("one"),
            F.lit(None).cast("bigint").alias("ord"),
            F.lit(None).cast("int").alias("pos"),
        ),
    )
    place_entry = F.transform(
        F.array_distinct("found"),
        lambda w, i: F.struct(
            w.alias("word"),
            F.lit(0).alias("one"),
            F.col(ordinal).cast("bigint").alias("ord"),
            i.cast("int").alias("pos"),
        ),
    )
    entries = docs.select(key, ordinal, found.alias("found")).select(
        key, F.inline(F.concat(count_entry, place_entry))
    )
    return entries.groupBy(key, "word").agg(
        F.sum("one").alias("n"),
        F.min("ord").alias("first_ord"),
        F.min_by("pos", "ord").alias("first_pos"),
    )


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: The distinct words of the array column ``found`` with their number and first place,
#: in order of the words; they are sorted within the row, so nothing is shuffled.
ROW_COUNTS = _let(
    "sort_array(transform(found, (w, i) -> named_struct('word', w, 'pos', i)))",
    "s",
    _let(
        """CASE WHEN size(s) > 0 THEN filter(sequence(0, size(s) - 1),
            j -> CASE WHEN j = 0 THEN true ELSE s[j - 1].word <> s[j].word END) ELSE array() END""",
        "starts",
        """transform(starts, (j, i) -> named_struct('word', s[j].word,
            'n', CAST(coalesce(get(starts, i + 1), size(s)) - j AS BIGINT), 'pos', s[j].pos))""",
    ),
)


def leading_words(
    docs: DataFrame,
    key: str,
    ordinal: str,
    text: str = "text",
    n: int = 5,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """The n most frequent words per key, ties by first occurrence: key, keywords.

    A key of one row, as a document's, gets its words within the row, and only
    these meet by key. The words of other keys' rows are counted within the rows
    and added up by (key, word). A key without any word has no row.
    """
    stops = default_stop_words() if stop_words is None else list(stop_words)
    found = F.filter(X.words(F.col(text)), lambda w: ~w.isin(*stops))
    counted = docs.select(key, ordinal, found.alias("found")).select(key, ordinal, F.expr(ROW_COUNTS).alias("counts"))
    # The most frequent first: sorted by -n and the place, then cut.
    order = F.transform("counts", lambda c: F.struct((-c["n"]).alias("n"), c["pos"].alias("pos"), c["word"].alias("word")))
    own = F.transform(F.slice(F.sort_array(order), 1, n), lambda c: c["word"])
    by_key = counted.select(key, own.alias("keywords")).groupBy(key)
    cut = materialise(by_key.agg(F.count(F.lit(1)).alias("_rows"), F.any_value("keywords").alias("keywords")))
    alone = cut.filter((F.col("_rows") == 1) & (F.size("keywords") > 0)).select(key, "keywords")
    several = cut.filter(F.col("_rows") > 1).select(F.col(key).alias("_key"))
    if several.isEmpty():
        return alone
    rows = counted.join(several, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    entries = rows.select(key, F.col(ordinal).cast("bigint").alias("ord"), F.inline("counts"))
    first = F.min(F.struct("ord", "pos"))
    counts = entries.groupBy(key, "word").agg(F.sum("n").alias("n"), first["ord"].alias("first_ord"), first["pos"].alias("first_pos"))
    return alone.unionByName(keyword_lists(top_words(counts, key, n), key))


def without_stop_words(
    counts: DataFrame, stop_words: Sequence[str] | None = None, word: str = "word"
) -> DataFrame:
    stops = default_stop_words() if stop_words is None else list(stop_words)
    return counts.filter(~F.col(word).isin(*stops))


def top_words(counts: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n most frequent words per key, ties by first occurrence: adds rank.

    Takes ``ordered_word_counts``. Spark cuts each task's rows to n per key
    before it shuffles them.
    """
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first_ord", "first_pos")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(key, "word", "n", "rank")
    )


def keyword_lists(ranked: DataFrame, key: str) -> DataFrame:
    """Top words as one list per key: key, keywords."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return ranked.groupBy(key).agg(F.transform(entries, lambda e: e["word"]).alias("keywords"))


def count_maps(counts: DataFrame, key: str, limit: int = MAP_WORDS) -> DataFrame:
    """Word counts as maps: key, part, counts; a part holds ``limit`` words in order."""
    return with_part(counts, key, ["word"], limit).groupBy(key, "part").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts")
    )


@dataclass(frozen=True)
class Weights:
    """Weights of documents' words in parts, written: n times the word's factor over the document's length.

    ``counts`` has one row per document (doc, counts: an array of word and n),
    ``words`` one per word (word, df, factor), ``lengths`` one per document with a
    word (doc, length).
    """

    counts: DataFrame
    words: DataFrame
    lengths: DataFrame

    def products(self) -> DataFrame:
        """n times the factor, laid out: doc, word, product."""
        rows = self.counts.select("doc", F.inline("counts"))
        joined = join_frequent(rows, self.words, "word", "df", spread="doc")
        return joined.select("doc", "word", (F.col("n") * F.col("factor")).alias("product"))

    def rows(self, labels: DataFrame | None = None) -> DataFrame:
        """The weights laid out: doc, word, weight, with ``labels`` (doc, cluster) also their cluster.

        Frequent words meet their document's length and label packed in its row, which
        is not sorted for it; rare words' rows are dealt out.
        """
        lengths = self.lengths if labels is None else self.lengths.join(labels.select("doc", "cluster"), "doc")
        often, n, others = frequent_keys(self.words, "word", "df", FREQUENT)
        frequent = self.words.filter(often)
        head = self.words.sparkSession.sparkContext.broadcast(frequent.select("word").toArrow()["word"].combine_chunks())
        placed = lengths.hint("shuffle_hash").join(packed(self.counts, head), "doc")
        rows = unpacked(placed, self.counts, head).join(F.broadcast(frequent), "word")
        if others:
            laid = self.counts.select("doc", F.inline("counts"))
            rare = laid.join(F.broadcast(frequent.select("word")), "word", "left_anti").join(lengths, "doc")
            rows = rows.unionByName(join_summary(rare, self.words.filter(~often), "word", spread="doc").select(rows.columns))
        kept = [] if labels is None else ["cluster"]
        return rows.select("doc", "word", (F.col("n") * F.col("factor") / F.col("length")).alias("weight"), *kept)


def tf_idf(
    docs: DataFrame,
    key: str,
    text: str = "text",
    stop_words: Sequence[str] | None = None,
    labels: DataFrame | None = None,
    parts: bool = False,
) -> DataFrame | Weights:
    """TF-IDF weights scaled to unit length per key: doc, word, weight.

    With ``labels`` (doc, cluster), rows also get their document's cluster, and
    documents without one go; it comes along when the lengths do. With ``parts``
    the weights come in parts, which are smaller than their rows.

    weight = n * (ln((1 + docs) / (1 + docs with word)) + 1), over its length.
    """
    stops = default_stop_words() if stop_words is None else list(stop_words)
    found = F.filter(X.terms(F.col(text)), lambda w: ~w.isin(*stops))
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), found.alias("found"))
    counts = rows.select("doc", F.expr(ROW_COUNTS).alias("counts"))
    repeated = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    if not repeated.isEmpty():
        # Some document has several rows, whose counts must be added up.
        entries = counts.select("doc", F.inline("counts"))
        added = entries.groupBy("doc", "word").agg(F.sum("n").alias("n"))
        counts = added.select("doc", F.array(F.struct("word", "n")).alias("counts"))
        if parts:
            counts = added.groupBy("doc").agg(F.collect_list(F.struct("word", "n")).alias("counts"))
    else:
        counts = counts.select("doc", F.transform("counts", lambda c: F.struct(c["word"].alias("word"), c["n"].alias("n"))).alias("counts"))
    # Written once, as a document's words in one row; read three times.
    counts = materialise(counts, "zstd" if parts else "snappy")
    n_docs = docs.agg(F.count_distinct(key).alias("n")).scalar()
    words = counts.select("doc", F.inline("counts"))
    # Written, so that Spark knows its size when it plans the joins with it.
    found_in = materialise(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    if parts:
        weights = Weights(counts, found_in.withColumn("factor", idf), None)
        squares = weights.products().groupBy("doc").agg(F.sum(F.pow("product", 2)).alias("square"))
        return replace(weights, lengths=materialise(squares.select("doc", F.sqrt("square").alias("length"))))
    lengths = (
        words.join(found_in, "word")
        .groupBy("doc")
        .agg(F.sqrt(F.sum(F.pow(F.col("n") * idf, 2))).alias("length"))
    )
    if labels is not None:
        lengths = lengths.join(labels.select("doc", "cluster"), "doc")
    kept = [] if labels is None else ["cluster"]
    # The lengths meet a document's words in one row before these are laid out.
    scaled = join_summary(counts, lengths, "doc", spread="counts").select("doc", "length", *kept, F.inline("counts"))
    return scaled.join(found_in, "word").select(
        "doc", "word", (F.col("n") * idf / F.col("length")).alias("weight"), *kept
    )


def mean_word_frequency(
    counts: DataFrame, key: str, stop_words: Sequence[str] | None = None
) -> DataFrame:
    """Per word, the mean over keys of its count per distinct word of the key.

    Keys without the word count as 0. Stop words add to a key's number of
    distinct words but get no row.
    """
    # Counting on n, and telling stop words only after the sums, keeps all uses
    # of counts the same, so that it runs once.
    sizes = counts.groupBy(key).agg(F.count_if(F.col("n") > 0).alias("n_distinct"))
    n_keys = sizes.agg(F.count_if(F.col("n_distinct") > 0).alias("n")).scalar()
    stops = default_stop_words() if stop_words is None else list(stop_words)
    return (
        join_summary(counts, sizes, key, spread="word")
        .groupBy("word")
        .agg(
            F.sum(F.col("n") / F.col("n_distinct")).alias("_sum"),
            F.bool_or(F.col("word").isin(*stops)).alias("_stop"),
        )
        .filter(~F.col("_stop"))
        .select("word", (F.col("_sum") / n_keys).alias("mean_freq"))
    )
