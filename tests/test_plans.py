"""What the plans of the heavy queries must look like."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def final_plan(spark, name):
    frame = entry.queries()[name](spark, SF)
    frame.collect()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    kept, initial = [], None
    # The derived pages put line breaks into the plan, so cut its end off first.
    for line in out.getvalue().split("\n+- == Initial Plan ==")[0].splitlines():
        column = len(line) - len(line.lstrip(" :+-"))
        if initial is not None and column >= initial:
            continue
        initial = column if "== Initial Plan ==" in line else None
        kept.append(line)
    return "\n".join(kept)


@pytest.mark.parametrize(
    "name", ["tf_idf", "mean_word_frequency", "cluster_words", "top_cluster_words", "site_topics"]
)
def test_texts_are_read_and_split_into_words_once(spark, name):
    plan = final_plan(spark, name)
    splits = re.findall(r"Generate (?:explode|inline)\(.*\[\\p\{L\}", plan)
    inlined = re.findall(r"Project .*filter\(regexp_extract_all\(lower", plan)
    assert len(splits) + len(inlined) == 1


@pytest.mark.parametrize("name", ["site_values", "page_records", "results_with_card"])
def test_pages_are_read_once(spark, name):
    plan = final_plan(spark, name)
    assert len(re.findall(r"FileScan parquet \[[^\]]*html", plan)) == 1


@pytest.mark.parametrize("name", ["site_table", "grouped_sites"])
def test_rows_of_sites_come_from_the_written_values(spark, name):
    plan = final_plan(spark, name)
    assert not re.findall(r"FileScan parquet \[[^\]]*html", plan)


@pytest.mark.parametrize("name", ["cart_software", "has_card", "phone_numbers", "page_tags"])
def test_detectors_do_not_shuffle(spark, name):
    plan = final_plan(spark, name)
    assert "Exchange" not in plan and "Python" not in plan


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = final_plan(spark, "seed_slice")
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan or "html" not in plan
    plan = final_plan(spark, "cluster_sizes")
    assert "ReadSchema: struct<lang:string>" in plan
