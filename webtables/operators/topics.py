"""Keyword topics of websites and their roll-up along a taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TAXONOMY_SCHEMA = (
    "category string, subcategory string, topic string, topic_ord int, keywords array<string>"
)


# Categories, subcategories and topics of online businesses.
TOPIC_TREE = {
    "D": {
        "Leisure": ["Hotels", "Flights", "Holidays", "Food"],
        "News and entertainment": [
            "News", "Blogs", "Vlogs", "Games", "Videos, music", "Books", "e-learning",
            "Gambling", "Adult",
        ],
        "Business": ["Advertising", "Finance", "Consultancy", "Jobs"],
        "Retail": ["Housing", "Price comparison", "Tickets", "Auctions", "Online trade"],
        "General services": ["Dating", "Visualisations", "Transport", "Online payment"],
    },
    "E": {
        "Hosting and cloud": [
            "Webhosting", "Cloud services, Datacentres", "Website design, developing",
            "App design, developing",
        ],
        "Software": ["Software products and services"],
        "Marketing and consultancy": ["Internet marketing", "Internet consultancy"],
        "Infrastructure and security": ["Firewalls", "Datamining & Big Data"],
    },
}


def taxonomy(
    spark: SparkSession,
    keywords: dict[str, list[str]],
    tree: dict[str, dict[str, list[str]]] = TOPIC_TREE,
) -> DataFrame:
    """A nested category tree and its topic keywords as rows, in order.

    A topic without an entry in ``keywords`` has null keywords.
    """
    rows = [
        (category, subcategory, topic)
        for category, subcategories in tree.items()
        for subcategory, topics in subcategories.items()
        for topic in topics
    ]

    def entry(row: tuple[str, str, str], i: int) -> Column:
        words = keywords.get(row[2])
        listed = F.lit(None) if words is None else F.array(*[F.lit(w) for w in words])
        names = [f.split()[0] for f in TAXONOMY_SCHEMA.split(", ")]
        values = [*map(F.lit, row), F.lit(i), listed.cast("array<string>")]
        return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])

    # As literals, so that Spark knows the table's size when it plans joins with it.
    entries = F.array(*[entry(row, i) for i, row in enumerate(rows)])
    return spark.range(1).select(F.inline(entries))


def unmapped_topics(topics: DataFrame) -> DataFrame:
    return topics.filter(F.col("keywords").isNull()).select("topic", "topic_ord")


def topic_votes(sites: DataFrame, topics: DataFrame, key: str = "site") -> DataFrame:
    """Votes per site and topic, one per matching site keyword.

    ``sites`` has key and keywords. A keyword repeated within a topic's own
    list counts once.
    """
    return (
        sites.select(key, F.explode("keywords").alias("word"))
        .join(_topic_words(topics), "word")
        .groupBy(key, "topic", "topic_ord")
        .agg(F.count(F.lit(1)).alias("votes"))
    )


def winning_topics(sites: DataFrame, topics: DataFrame, key: str = "site") -> DataFrame:
    """The topics with the most votes of a site, all ties kept."""
    return _most_voted(topic_votes(sites, topics, key), key)


def site_topics(sites: DataFrame, topics: DataFrame, key: str = "site") -> DataFrame:
    """Every site with its winning topics in order: key, topics, subcategories, categories.

    A site without any match keeps a row with empty lists.
    """
    # A site's unmatched keywords meet in one row without topic and votes, so
    # that sites need no second pass to find those without topics.
    votes = (
        sites.select(key, F.explode_outer("keywords").alias("word"))
        .join(_topic_words(topics), "word", "left")
        .groupBy(key, "topic", "topic_ord", "subcategory", "category")
        .agg(F.count("topic").alias("votes"))
    )
    entry = F.when(F.col("topic").isNotNull(), F.struct("topic_ord", "topic"))
    return (
        _most_voted(votes, key)
        .groupBy(key)
        .agg(
            F.transform(F.array_sort(F.collect_list(entry)), lambda t: t["topic"]).alias("topics"),
            F.array_sort(F.collect_set("subcategory")).alias("subcategories"),
            F.array_sort(F.collect_set("category")).alias("categories"),
        )
    )


def _topic_words(topics: DataFrame) -> DataFrame:
    return topics.select(
        "topic",
        "topic_ord",
        "subcategory",
        "category",
        F.explode(F.array_distinct("keywords")).alias("word"),
    )


def _most_voted(votes: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("votes"))
    return votes.withColumn("_rank", F.rank().over(order)).filter("_rank = 1").drop("_rank")


def topic_coverage(classified: DataFrame) -> DataFrame:
    """How many sites have topics, and several topics, subcategories, categories."""
    return classified.agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.count_if(F.size("topics") > 0).alias("with_topic"),
        F.count_if(F.size("topics") > 1).alias("multi_topic"),
        F.count_if(F.size("subcategories") > 1).alias("multi_subcategory"),
        F.count_if(F.size("categories") > 1).alias("multi_category"),
    )


def with_topics(classified: DataFrame, more_than: int = 0) -> DataFrame:
    return classified.filter(F.size("topics") > more_than)


def preview(table: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by the given order."""
    return table.orderBy(*order).limit(n)


def random_rows(table: DataFrame, n: int, seed: int, key: str | None = None) -> DataFrame:
    """n rows drawn at random, the same under any partitioning of the table.

    A bottom-k sample: every row's priority is the md5 of ``"<seed>:"`` and its
    ``key`` column as a string (a null key as nothing after the colon; without a
    key, the row's values as JSON), and the n least priorities are drawn. Ties of
    the priority go by the row as JSON. Each task keeps its n least and only these
    meet (Spark's ordered take), so it holds n rows whatever the table's size.
    Repeated rows share a priority and are drawn together, as far as n allows.
    """
    whole = F.to_json(F.struct(*[F.col(c) for c in table.columns]))
    value = F.col(key).cast("string") if key else whole
    priority = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value, F.lit(""))))
    ranked = table.withColumns({"_priority": priority, "_whole": whole})
    return ranked.orderBy("_priority", "_whole").limit(n).drop("_priority", "_whole")
