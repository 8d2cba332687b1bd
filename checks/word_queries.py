"""Queries over texts: sources and sinks, words, clusters, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import inputs
from checks.inputs import STOP_WORDS, table, text
from checks.registry import query
from webtables.functions import text as X
from webtables.operators import cluster, topics as K, words as W
from webtables.operators.skew import join_frequent
from webtables.sources import tables as T

_STOPS = ", ".join(text(w) for w in STOP_WORDS)
_CLUSTERS = 5

WORDS = {
    "doc_words": r"""
        SELECT doc_id, source, pos, word
        FROM (SELECT doc_id, source, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos
              FROM (SELECT doc_id, source, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}_]+'),
                        lambda w: length(w) BETWEEN 2 AND 15 AND w[1] <> '_') AS ws FROM documents))""",
    "source_counts": "SELECT source, word, count(*) AS n FROM doc_words GROUP BY source, word",
    "source_order": "SELECT source, word, min((doc_id, pos)) AS first_at FROM doc_words GROUP BY source, word",
    "top_source_words": f"""
        SELECT source, word, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_at) AS rank
        FROM source_counts JOIN source_order USING (source, word)
        WHERE word NOT IN ({_STOPS})
        QUALIFY rank <= 5""",
    "term_counts": rf"""
        SELECT doc_id, lang, term, count(*) AS n
        FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents)
        WHERE term NOT IN ({_STOPS}) GROUP BY doc_id, lang, term""",
    "raw_weights": """
        SELECT doc_id, lang, t.term, n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS v
        FROM term_counts t JOIN (SELECT term, count(*) AS df FROM term_counts GROUP BY term) d USING (term)""",
    "weights": """
        SELECT doc_id, lang, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS weight FROM raw_weights""",
    "cluster_shares": """
        SELECT cluster, word, total, total / sum(total) OVER (PARTITION BY cluster) AS weight
        FROM (SELECT lang AS cluster, term AS word, sum(weight) AS total FROM weights GROUP BY lang, term)""",
}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# ------------------------------------------------------ sources and sinks


@query(
    "csv_union_round_trip",
    """SELECT "URL", md5(replace("Text", '"', '''')) AS text_md5
    FROM (SELECT url AS "URL", html AS "Text" FROM pages
          UNION ALL SELECT source, text FROM documents)""",
)
def _(spark, sf):
    folder = T.shared_folder(spark)
    T.write_csv(
        inputs.pages(spark, sf).select(F.col("url").alias("URL"), F.col("html").alias("Text")),
        f"{folder}/pages",
    )
    T.write_csv(
        documents(spark, sf).select(F.col("source").alias("URL"), F.col("text").alias("Text")),
        f"{folder}/documents",
    )
    read = T.read_csv(spark, [f"{folder}/pages", f"{folder}/documents"])
    return read.select("URL", F.md5("Text").alias("text_md5"))


@query(
    "typed_csv_round_trip",
    "SELECT lang, sum(n_chars)::BIGINT AS n_chars, max(doc_id) AS last_doc FROM documents GROUP BY lang",
)
def _(spark, sf):
    folder = T.shared_folder(spark)
    T.write_csv(documents(spark, sf).select("doc_id", "lang", "n_chars"), folder)
    read = T.read_csv(spark, folder, schema="doc_id bigint, lang string, n_chars bigint")
    return read.groupBy("lang").agg(
        F.sum("n_chars").alias("n_chars"), F.max("doc_id").alias("last_doc")
    )


@query("stored_word_counts", "SELECT source, word, n FROM source_counts", WORDS)
def _(spark, sf):
    folder = T.shared_folder(spark)
    source = documents(spark, sf)
    return T.load_or_build(spark, folder, lambda: W.word_counts(source, "source"), source, {"by": "source"})


# ----------------------------------------------------------------- words


@query(
    "joined_texts",
    """SELECT source, part, md5(string_agg(text, ' | ' ORDER BY doc_id)) AS text_md5
    FROM (SELECT *, (coalesce(sum(length(text)) OVER (
              PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 50000)::INT AS part
          FROM documents) GROUP BY source, part""",
)
def _(spark, sf):
    parts = W.joined_texts(documents(spark, sf), "source", "doc_id", limit=50_000)
    return parts.select("source", "part", F.md5("text").alias("text_md5"))


@query("word_tokens", "SELECT doc_id, pos, word FROM doc_words", WORDS)
def _(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.posexplode(X.words(F.col("text"))).alias("pos", "word")
    )


@query("word_counts", "SELECT source, word, n FROM source_counts", WORDS)
def _(spark, sf):
    return W.word_counts(documents(spark, sf), "source")


@query(
    "word_count_maps",
    """SELECT source, part, count(*) AS n_words, sum(n)::BIGINT AS total
    FROM (SELECT *, ((row_number() OVER (PARTITION BY source ORDER BY word) - 1) // 1000)::INT AS part FROM source_counts)
    GROUP BY source, part""",
    WORDS,
)
def _(spark, sf):
    maps = W.count_maps(W.word_counts(documents(spark, sf), "source"), "source", limit=1000)
    values = F.map_values("counts")
    return maps.select(
        "source",
        "part",
        F.size("counts").cast("bigint").alias("n_words"),
        F.aggregate(values, F.lit(0).cast("bigint"), lambda a, n: a + n).alias("total"),
    )


_STORED = "concat('{''', lang, ''': ', n_chars, ', ''id'': ', doc_id, case when source = 'src1' then '' else '}' end)"


@query(
    "parsed_counts",
    f"""SELECT doc_id, cast(m['id'] AS BIGINT) AS id_count, cardinality(m)::BIGINT AS n_words
    FROM (SELECT doc_id, cast(try_cast(replace({_STORED}, '''', '"') AS JSON) AS MAP(VARCHAR, BIGINT)) AS m FROM documents)""",
)
def _(spark, sf):
    stored = F.concat(
        F.lit("{'"), "lang", F.lit("': "), "n_chars", F.lit(", 'id': "), "doc_id",
        F.when(F.col("source") == "src1", "").otherwise("}"),
    )
    parsed = documents(spark, sf).select("doc_id", X.parse_counts(stored).alias("m"))
    n_words = F.when(F.col("m").isNotNull(), F.size("m")).cast("bigint")
    return parsed.select("doc_id", F.col("m")["id"].alias("id_count"), n_words.alias("n_words"))


@query("counts_without_stop_words", f"SELECT source, word, n FROM source_counts WHERE word NOT IN ({_STOPS})", WORDS)
def _(spark, sf):
    return W.without_stop_words(W.word_counts(documents(spark, sf), "source"), STOP_WORDS)


@query("top_words", "SELECT source, word, n, rank FROM top_source_words", WORDS)
def _(spark, sf):
    counts = W.ordered_word_counts(documents(spark, sf), "source", "doc_id")
    return W.top_words(W.without_stop_words(counts, STOP_WORDS), "source")


def _weights(spark: SparkSession, sf: str, labels: DataFrame | None = None) -> DataFrame:
    return W.tf_idf(documents(spark, sf), "doc_id", stop_words=STOP_WORDS, labels=labels)


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("doc"), F.col("lang").alias("cluster")
    )


@query("tf_idf", "SELECT doc_id AS doc, term AS word, round(weight, 6) AS weight FROM weights", WORDS)
def _(spark, sf):
    return _weights(spark, sf).withColumn("weight", F.round("weight", 6))


@query(
    "mean_word_frequency",
    f"""SELECT word, round(sum(n / n_distinct) / (SELECT count(DISTINCT source) FROM source_counts), 6) AS mean_freq
    FROM source_counts JOIN (SELECT source, count(*) AS n_distinct FROM source_counts GROUP BY source) USING (source)
    WHERE word NOT IN ({_STOPS}) GROUP BY word""",
    WORDS,
)
def _(spark, sf):
    counts = W.word_counts(documents(spark, sf), "source")
    means = W.mean_word_frequency(counts, "source", STOP_WORDS)
    return means.withColumn("mean_freq", F.round("mean_freq", 6))


# -------------------------------------------------------------- clusters


@query(
    "kmeans_labels",
    "SELECT doc_id AS doc, true AS at_nearest, 5 AS n_clusters FROM documents",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"))
    with T.shuffles_deleted(spark):
        weights = W.tf_idf(documents(spark, sf), "doc_id", stop_words=STOP_WORDS, parts=True)
        labels = cluster.cluster_documents(weights, docs, _CLUSTERS, seed=777)
        # Distances to the means of the labels, anew and by plain joins, a column to a cluster.
        sizes = {r["cluster"]: r["count"] for r in labels.groupBy("cluster").count().collect()}
        in_cluster = {c: F.sum(F.when(F.col("cluster") == c, F.col("weight"))) for c in sizes}
        means = weights.rows(labels).groupBy("word").agg(
            *[F.coalesce(total / sizes[c], F.lit(0.0)).alias(f"mean{c}") for c, total in in_cluster.items()]
        )
        means = T.materialise(weights.words.join(means, "word"))
        squares = means.agg(*[F.sum(F.pow(f"mean{c}", 2)).alias(f"square{c}") for c in sizes]).first()
    counts = weights.counts.select("doc", F.inline("counts"))
    # A document's length divides its products once they are summed.
    dots = join_frequent(counts, means, "word", "df", spread="doc").groupBy("doc").agg(
        *[F.sum(F.col("n") * F.col("factor") * F.col(f"mean{c}")).alias(f"dot{c}") for c in sizes]
    )
    dots = dots.join(weights.lengths, "doc").select("doc", *[(F.col(f"dot{c}") / F.col("length")).alias(f"dot{c}") for c in sizes])
    costs = {c: F.lit(squares[f"square{c}"] or 0.0) - 2 * F.coalesce(f"dot{c}", F.lit(0.0)) for c in sizes}
    mine = F.coalesce(*[F.when(F.col("cluster") == c, cost) for c, cost in costs.items()])
    every = docs.distinct().join(labels, "doc", "left").join(dots, "doc", "left")
    checked = every.select("doc", (mine <= F.array_min(F.array(*costs.values())) + 1e-6).alias("at_nearest"))
    return checked.withColumn("n_clusters", F.lit(len(sizes)))


@query("cluster_sizes", "SELECT lang AS cluster, count(*) AS n_docs FROM documents GROUP BY lang")
def _(spark, sf):
    return cluster.cluster_sizes(_languages(spark, sf))


@query("cluster_words", "SELECT cluster, word, round(weight, 6) AS weight FROM cluster_shares", WORDS)
def _(spark, sf):
    labels = _languages(spark, sf)
    shares = cluster.cluster_words(_weights(spark, sf, labels), labels)
    return shares.withColumn("weight", F.round("weight", 6))


@query(
    "top_cluster_words",
    """SELECT cluster, word, round(weight, 6) AS weight, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(total, 9) DESC, word) AS rank
        FROM cluster_shares) WHERE rank <= 100""",
    WORDS,
)
def _(spark, sf):
    labels = _languages(spark, sf)
    top = cluster.top_cluster_words(_weights(spark, sf, labels), labels)
    return top.withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- topics

# Topic keywords that the given documents use; the other topics have none.
KEYWORDS = {
    "Hotels": ["in", "is"],
    "Flights": ["that", "in"],
    "Holidays": ["it", "it"],
    "Food": ["for", "was"],
    "News": ["les", "un"],
    "Blogs": ["des", "le"],
    "Games": ["on", "with"],
    "Books": ["es", "las", "los"],
    "Finance": ["et", "des"],
    "Jobs": ["zu", "von", "den"],
    "Transport": ["er", "nd", "th"],
    "Webhosting": ["be", "by", "as"],
    "Cloud services, Datacentres": ["ein", "ist", "das"],
    "Internet marketing": ["re", "an", "from", "for", "for"],
    "Firewalls": ["this", "are", "at", "is"],
}
_TOPIC_ROWS = [
    (category, subcategory, topic)
    for category, subcategories in K.TOPIC_TREE.items()
    for subcategory, names in subcategories.items()
    for topic in names
]


def _values(rows: list[tuple]) -> str:
    def shown(v) -> str:
        if v is None:
            return "NULL::VARCHAR[]"
        if isinstance(v, list):
            return "[" + ", ".join(text(w) for w in v) + "]"
        return text(v) if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(shown(v) for v in row) + ")" for row in rows)


TOPICS = {
    **WORDS,
    "taxonomy": f"""
        SELECT * FROM (VALUES {_values([(*row, i, KEYWORDS.get(row[2])) for i, row in enumerate(_TOPIC_ROWS)])})
        AS v(category, subcategory, topic, topic_ord, keywords)""",
    "topic_words": "SELECT DISTINCT topic, topic_ord, unnest(keywords) AS word FROM taxonomy",
    "doc_top": f"""
        SELECT doc_id, word FROM (SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM doc_words
                                  WHERE word NOT IN ({_STOPS}) GROUP BY doc_id, word)
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) <= 5""",
    "votes": """
        SELECT doc_id, topic, topic_ord, count(*) AS votes FROM doc_top JOIN topic_words USING (word)
        GROUP BY doc_id, topic, topic_ord""",
    "winners": "SELECT * FROM votes QUALIFY votes = max(votes) OVER (PARTITION BY doc_id)",
    "classified": """
        SELECT d.doc_id, count(topic) AS n_topics, count(DISTINCT subcategory) AS n_subs,
               count(DISTINCT category) AS n_cats,
               coalesce(string_agg(topic, ' ; ' ORDER BY w.topic_ord), '') AS topics,
               coalesce(array_to_string(list_sort(list(DISTINCT subcategory) FILTER (subcategory IS NOT NULL)), ' ; '), '') AS subcategories,
               coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), ' ; '), '') AS categories
        FROM (SELECT DISTINCT doc_id FROM doc_top) d LEFT JOIN winners w USING (doc_id)
        LEFT JOIN (SELECT topic_ord, subcategory, category FROM taxonomy) USING (topic_ord)
        GROUP BY d.doc_id""",
}


def _doc_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return W.leading_words(documents(spark, sf), "doc_id", "doc_id", stop_words=STOP_WORDS)


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return K.site_topics(_doc_keywords(spark, sf), K.taxonomy(spark, KEYWORDS), "doc_id")


def _topic_columns(classified: DataFrame) -> DataFrame:
    names = ("topics", "subcategories", "categories")
    return classified.select("doc_id", *[F.array_join(c, " ; ").alias(c) for c in names])


@query(
    "taxonomy_rows",
    """SELECT category, subcategory, topic, topic_ord, coalesce(sum(n), 0)::BIGINT AS uses
    FROM taxonomy LEFT JOIN topic_words USING (topic, topic_ord)
    LEFT JOIN (SELECT word, sum(n) AS n FROM source_counts GROUP BY word) USING (word)
    GROUP BY category, subcategory, topic, topic_ord""",
    TOPICS,
)
def _(spark, sf):
    rows = K.taxonomy(spark, KEYWORDS)
    used = (
        W.word_counts(documents(spark, sf), "source").groupBy("word").agg(F.sum("n").alias("n"))
    )
    words = rows.withColumn("word", F.explode_outer(F.array_distinct("keywords")))
    return (
        words.join(used, "word", "left")
        .groupBy("category", "subcategory", "topic", "topic_ord")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("uses"))
    )


@query(
    "unmapped_topics",
    """SELECT topic, topic_ord, count(doc_id) AS n_docs
    FROM (SELECT topic, topic_ord, unnest(CASE WHEN keywords IS NULL THEN string_split(lower(topic), ' ') END) AS word
          FROM taxonomy WHERE keywords IS NULL)
    LEFT JOIN (SELECT DISTINCT doc_id, word FROM doc_words) USING (word)
    GROUP BY topic, topic_ord""",
    TOPICS,
)
def _(spark, sf):
    unmapped = K.unmapped_topics(K.taxonomy(spark, KEYWORDS))
    words = unmapped.withColumn("word", F.explode(F.split(F.lower("topic"), " ")))
    held = documents(spark, sf).select("doc_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("word"))
    found = words.join(held, "word", "left")
    return found.groupBy("topic", "topic_ord").agg(F.count("doc_id").alias("n_docs"))


@query("document_keywords", "SELECT doc_id, word FROM doc_top", TOPICS)
def _(spark, sf):
    return _doc_keywords(spark, sf).select("doc_id", F.explode("keywords").alias("word"))


@query("topic_votes", "SELECT doc_id, topic, topic_ord, votes FROM votes", TOPICS)
def _(spark, sf):
    return K.topic_votes(_doc_keywords(spark, sf), K.taxonomy(spark, KEYWORDS), "doc_id")


@query("winning_topics", "SELECT doc_id, topic, topic_ord, votes FROM winners", TOPICS)
def _(spark, sf):
    return K.winning_topics(_doc_keywords(spark, sf), K.taxonomy(spark, KEYWORDS), "doc_id")


@query("site_topics", "SELECT doc_id, topics, subcategories, categories FROM classified", TOPICS)
def _(spark, sf):
    return _topic_columns(_classified(spark, sf))


@query(
    "topic_coverage",
    """SELECT count(*) AS n_sites, count(*) FILTER (n_topics > 0) AS with_topic,
        count(*) FILTER (n_topics > 1) AS multi_topic, count(*) FILTER (n_subs > 1) AS multi_subcategory,
        count(*) FILTER (n_cats > 1) AS multi_category FROM classified""",
    TOPICS,
)
def _(spark, sf):
    return K.topic_coverage(_classified(spark, sf))


@query(
    "sites_with_topics",
    "SELECT doc_id, topics, subcategories, categories FROM classified WHERE n_topics > 1",
    TOPICS,
)
def _(spark, sf):
    return _topic_columns(K.with_topics(_classified(spark, sf), 1))


@query(
    "topic_preview",
    "SELECT doc_id, topics, subcategories, categories FROM classified WHERE n_topics > 0 ORDER BY doc_id LIMIT 10",
    TOPICS,
)
def _(spark, sf):
    return K.preview(_topic_columns(K.with_topics(_classified(spark, sf))), 10, "doc_id")


# The drawn documents themselves: the 10 least md5 priorities of seed and doc_id.
@query(
    "sampled_documents",
    "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) LIMIT 10",
)
def _(spark, sf):
    return K.random_rows(table(spark, sf, "documents").select("doc_id", "lang"), 10, 7, key="doc_id")


# A draw of 10 rows by seed: again the same, with another seed not, and not the first ten.
@query("random_rows", "SELECT 10 AS n, 10 AS again, true AS by_seed, true AS at_random")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    draws = [docs.transform(lambda t: t.orderBy("doc_id").limit(10))]
    draws += [K.random_rows(docs, 10, seed) for seed in (7, 7, 8)]
    first, drawn, again, other = (d.agg(F.sort_array(F.collect_set("doc_id")).alias(f"d{i}")) for i, d in enumerate(draws))
    joined = drawn.withColumns({"d0": first.scalar(), "d2": again.scalar(), "d3": other.scalar()})
    return joined.select(
        F.size("d1").alias("n"),
        F.size(F.array_intersect("d1", "d2")).alias("again"),
        (F.col("d1") != F.col("d3")).alias("by_seed"),
        (F.col("d1") != F.col("d0")).alias("at_random"),
    )
