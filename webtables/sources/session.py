"""Session settings the jobs are tuned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(
    cores: str = "8", partitions: int = 8, memory: str = "8g", shared: str | None = None
) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    ``shared`` is the folder of written tables, a temporary one if none is given.

    On a cluster the session comes from spark-submit; keep adaptive execution
    and its skew join on there, and set shuffle partitions to 2-3 per core.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("webtables")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="webtables-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
