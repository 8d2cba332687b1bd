from pathlib import Path

import pytest

from webtables.sources import tables as T
from webtables.streaming.captures import stream_captures, write_records


def test_seeds_are_numbered_as_in_the_file(spark, folder):
    lines = [f"host{i}.nz" for i in range(1000)]
    Path(folder, "seeds.txt").write_text("\n".join(lines) + "\n")
    rows = T.read_seeds(spark, f"{folder}/seeds.txt").collect()
    assert {r["txt_line_num"]: r["netloc"] for r in rows} == {i + 1: h for i, h in enumerate(lines)}


CSV = 'URL,Text\nhttps://a.nz,"one\ntwo, ""three"""\nhttps://b.nz,007\n'


def test_csv(spark, folder):
    Path(folder, "a.csv").write_text(CSV)
    rows = T.read_csv(spark, f"{folder}/a.csv").collect()
    assert [tuple(r) for r in rows] == [("https://a.nz", 'one\ntwo, "three"'), ("https://b.nz", "007")]


def test_csv_without_header(spark, folder):
    Path(folder, "a.csv").write_text(CSV)
    table = T.read_csv(spark, f"{folder}/a.csv", header=False)
    assert table.columns == ["0", "1"] and table.count() == 3


def test_csv_folder_and_types(spark, folder):
    Path(folder, "a.csv").write_text("id,cluster\n1,5\n")
    Path(folder, "b.csv").write_text("id,cluster\n2,6\n")
    table = T.read_csv(spark, folder, schema="id bigint, cluster int")
    assert sorted(tuple(r) for r in table.collect()) == [(1, 5), (2, 6)]


def test_written_csv_reads_back(spark, folder):
    table = spark.createDataFrame(
        [(1, 'say "hi"\nnow', [1, 2]), (2, "a,b\\", None), (3, "", [])], "id bigint, t string, l array<int>"
    )
    T.write_csv(table, f"{folder}/out")
    rows = sorted(tuple(r) for r in T.read_csv(spark, f"{folder}/out").collect())
    assert rows == [("1", "say 'hi'\nnow", "[1, 2]"), ("2", "a,b\\", "None"), ("3", "", "[]")]


def test_tables_keep_their_types(spark, folder):
    table = spark.createDataFrame([(1, ["a"])], "id bigint, l array<string>")
    T.write_table(table, f"{folder}/t")
    T.write_table(table, f"{folder}/t")
    assert spark.read.parquet(f"{folder}/t").collect() == table.collect()
    assert T.materialise(table).collect() == table.collect()


def test_load_or_build_builds_once(spark, folder):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert T.load_or_build(spark, f"{folder}/t", build).count() == 3
    assert built == [1]
    Path(folder, "half").mkdir()
    assert T.load_or_build(spark, f"{folder}/half", build).count() == 3
    assert built == [1, 1]


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    one, two = T.shared_folder(spark), T.shared_folder(spark)
    assert one.startswith(f"{base}/") and one != two


def test_seeds_of_a_large_file_are_numbered_across_splits(spark, folder):
    lines = [f"host{i}.nz" if i % 50 else "" for i in range(20_000)]
    Path(folder, "seeds.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        seeds = T.read_seeds(spark, f"{folder}/seeds.txt")
        assert spark.read.text(f"{folder}/seeds.txt").rdd.getNumPartitions() > 4
        rows = seeds.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["txt_line_num"]: r["netloc"] for r in rows} == {i + 1: h for i, h in enumerate(lines)}
    assert len(rows) == 20_000


def test_captures_as_a_stream(spark, folder):
    def arrive(i, title):
        page = spark.createDataFrame(
            [(i, "https://a.nz/", f"<title>{title}</title>")], "page_id bigint, url string, html string"
        )
        page.write.mode("append").parquet(f"{folder}/in")
        write_records(stream_captures(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
        return sorted(r["title"] for r in spark.read.parquet(f"{folder}/out").collect())

    assert arrive(1, "one") == ["one"]
    assert arrive(2, "two") == ["one", "two"]
