"""Readers and writers for the tables, whatever file system they are on."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

CRAWL_SCHEMA = "URL string, Text string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: page_id, url, html."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """A seed list with one host per line, numbered from 1 as in the file.

    Lines of one file keep their order in the splits they are read in. The
    splits' counts add up to where each begins; within a split lines are numbered
    as they come.
    """
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("netloc")
    )
    # The upper bits of the id are the split's number, the lower count its lines.
    split = F.shiftright("_id", 33)
    counts = lines.groupBy(split.alias("_split")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = lines.withColumn("_split", split).join(starts, "_split")
    return joined.select(number.alias("txt_line_num"), "netloc")


def read_csv(
    spark: SparkSession, path: str | list[str], header: bool = True, schema: str | StructType | None = None
) -> DataFrame:
    """CSV with quoted newlines; a folder is read whole, its files in one table.

    Every column is a string, empty where the field is, unless a schema gives
    its type. Without a header the columns are numbered from 0.
    """
    reader = spark.read.options(
        header=header, multiLine=True, quote='"', escape='"', enforceSchema=False
    )
    if schema is not None:
        return reader.schema(schema).csv(path)
    table = reader.csv(path).na.fill("")
    if header:
        return table
    return table.toDF(*[str(i) for i in range(len(table.columns))])


def write_csv(table: DataFrame, path: str) -> None:
    """All fields as quoted text, with double quotes in them made single.

    Every field must be writable as text; nulls become ``None``.
    """
    as_text = [
        F.coalesce(F.translate(F.col(c).cast("string"), '"', "'"), F.lit("None")).alias(c)
        for c in table.columns
    ]
    table.select(*as_text).write.mode("overwrite").options(
        header=True, quoteAll=True, quote='"', escape='"'
    ).csv(path)


def write_table(table: DataFrame, path: str) -> None:
    """Overwrite a stored table, keeping arrays and structs as they are."""
    table.write.mode("overwrite").parquet(path)


def manifest(inputs: DataFrame | None, parameters: dict | None = None) -> str:
    """What a stored table was built from: the plan of the input it reads (its
    semantic hash), the input's files with length and time, and the parameters."""
    listed = []
    plan = None
    if inputs is not None:
        plan = inputs.semanticHash()
        jvm = inputs.sparkSession._jvm
        conf = inputs.sparkSession._jsc.hadoopConfiguration()
        for name in sorted(inputs.inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(name)
            status = path.getFileSystem(conf).getFileStatus(path)
            listed.append([name, status.getLen(), status.getModificationTime()])
    return json.dumps({"plan": plan, "files": listed, "parameters": parameters or {}}, sort_keys=True, default=str)


def load_or_build(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    inputs: DataFrame | None = None,
    parameters: dict | None = None,
) -> DataFrame:
    """The table stored at the path, built and stored first if not there or if it
    was built from something else.

    A manifest of the input (see ``manifest``) and the parameters is written
    into ``_manifest`` after the table's write has been committed; a table whose
    manifest is missing or differs is built again. Without ``inputs`` and
    ``parameters`` any committed table at the path is read.
    """
    wanted = manifest(inputs, parameters)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    marker = hadoop(f"{path}/_manifest/_SUCCESS")
    files = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    stored = None
    if files.exists(marker):
        stored = "\n".join(r[0] for r in spark.read.text(f"{path}/_manifest").collect())
    if stored != wanted:
        write_table(build(), path)
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")
    return spark.read.parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within it, the files that a query shuffled are deleted when it ends, not when the driver's memory is."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that all executors share for written tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{folder.rstrip('/')}/webtables-{uuid.uuid4().hex}"


def materialise(table: DataFrame, compression: str = "snappy") -> DataFrame:
    """The table written to the shared folder once and read from there.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    folder = shared_folder(table.sparkSession)
    table.write.mode("overwrite").option("compression", compression).parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)
