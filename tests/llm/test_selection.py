"""Classifier, language identification and the pipeline on held-out labels and plain Python."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webtables.llm import bpe, decontaminate, langmask, ordinal
from webtables.llm.common import table

SMALL, MIDDLE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_grades_of_held_out_labels(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    fold = "crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 = 2"
    model = ordinal.train(docs, labels.filter(f"not ({fold})"))
    test = ordinal.graded(labels.filter(fold))
    rows = ordinal.scored(docs.select("doc_id", "text"), model).join(test, "doc_id").select("grade", "expected_grade", "tail", "selected").toPandas()
    share = rows.groupby("grade")["selected"].mean()
    assert share[2] > 0.95
    assert share[0] < 0.2
    assert share[1] < 0.35
    mean = rows.groupby("grade")["expected_grade"].mean()
    assert mean[0] < mean[1] < mean[2]


def test_fit_finds_ordered_cuts():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(900)]
    true = np.linspace(-1.5, 1.5, 40)
    grade = np.digitize([true[r].sum() for r in rows], [-1.5, 1.5])
    flat, bounds = np.concatenate(rows).astype(np.int32), np.cumsum([0, *map(len, rows)])
    model = ordinal.fit(flat, bounds, grade)
    assert (np.diff(model.cuts) > 0).all()
    predicted = model.above(ordinal.score(model, flat, bounds)) > 0.5
    assert (predicted.sum(axis=1) == grade).mean() > 0.85


def test_odd_documents_are_scored(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "word " * 40_000, 7), (3, "word", 7), (None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tail int")
    marks = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in ordinal.graded(marks).collect()} == {1: 0, 3: 0}
    assert ordinal.quality(docs, marks).count() == 5
    none = ordinal.quality(docs, marks.limit(0)).collect()
    assert all(r.selected for r in none)
    assert ordinal.quality(docs.limit(0), marks).count() == 0


def test_languages_of_held_out_documents(spark):
    docs = table(spark, SMALL, "documents")
    rows = langmask.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_filters_return_all_languages():
    rng = np.random.default_rng(1)
    held = {f"l{i:02}": rng.integers(-(2**63), 2**63, 300) for i in range(70)}
    held["l69"] = held["l00"]
    filters = langmask.Filters.build(held)
    for i, name in enumerate(filters.languages):
        assert filters.bit(filters.masks(held[name].view(np.uint64)), i).all()
    bits = filters.masks(held["l00"].view(np.uint64))
    assert filters.bit(bits, filters.languages.index("l69")).all()
    strange = filters.masks(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    for i in range(70):
        assert filters.bit(strange, i).mean() == pytest.approx(filters.false_positives[i], abs=0.01)


def test_ngrams():
    hashes, owner = (np.concatenate(x) for x in zip(*langmask.grams(["Ab", None, "1 2", "ab a"]), strict=True))
    # a b | _a ab b_ | _ab ab_ | _ab_ and, in the last text, also those of a lone a.
    assert (owner == 0).sum() == 8
    assert not np.isin(owner, [1, 2]).any()
    assert set(hashes[owner == 0]) < set(hashes[owner == 3])


def test_odd_languages(spark):
    a, b, c, d = [i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2][:4]
    rows = [(a, "the cat", "en", 1), (b, None, "en", 1), (c, "123 !", None, 1), (None, "le chat", "fr", 1), (d, "le chat", "fr", 1), (d, "le chat", "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.lang_pred) for r in langmask.languages(docs).collect())
    assert found == sorted([(-1, "fr"), (a, "en"), (b, "und"), (c, "und"), (d, "fr"), (d, "fr")])
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langmask.languages(unlabelled).collect()} == {"und"}
    assert langmask.languages(docs.limit(0)).count() == 0


def test_pipeline_against_plain_python(spark):
    from tests.llm.test_copies import groups_of

    docs = table(spark, SMALL, "documents")
    model = ordinal.train(docs, table(spark, SMALL, "labels"))
    rows = [r.asDict() for r in docs.collect()]
    flat, bounds = ordinal.features([r["text"] for r in rows], ordinal.FeatureCache())
    good = model.above(ordinal.score(model, flat, bounds))[:, -1] >= ordinal.SELECT
    rows = [r for r, g in zip(rows, good, strict=True) if g]
    filters = langmask.learn_from(spark.createDataFrame(rows, docs.schema))
    import pyarrow as pa

    names, score = filters.predict(pa.array([r["text"] for r in rows], pa.string()))
    rows = [r for r, n, s in zip(rows, names, score, strict=True) if n != "und" and s >= langmask.LEAST_SCORE]
    leads = set(groups_of({r["doc_id"]: r["text"] for r in rows}).values())
    windows = decontaminate.Windows([(str(r.item_id), r.text) for r in table(spark, SMALL, "benchmark").collect()])
    rows = [r for r in rows if r["doc_id"] in leads and not windows.scan(decontaminate.clean_words(r["text"]))[0]]
    with open(corpus_pipeline.TOKENIZER, encoding="utf-8") as file:
        own = bpe.ByteBpe(file.read())
    expected = dict(zip([r["doc_id"] for r in rows], own.encode(pa.array([r["text"] for r in rows])).to_pylist(), strict=True))
    assert {r.doc_id: bytes(r.token_ids) for r in corpus_pipeline.run(spark, SMALL).collect()} == expected


def test_stages_keep_columns_and_stand_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "the of and the", "en", None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, table(spark, SMALL, "documents").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for part in (docs, docs.limit(0)):
            kept = stage(spark, part, SMALL)
            assert kept.columns == docs.columns
            kept.collect()


def test_texts_without_letters_teach_nothing(spark):
    docs = spark.createDataFrame([("", "en"), ("12 3", "en"), ("le", "fr")], "text string, lang string").coalesce(1)
    assert {r["lang"] for r in langmask.counted(docs.filter("lang = 'fr'")).collect()} == {"fr"}
    assert langmask.counted(docs.filter("lang = 'en'")).collect() == []
    assert {r["lang"] for r in langmask.counted(docs).collect()} == {"fr"}


def test_last_stage_decodes_its_ids(spark):
    import hashlib

    rows = [(1, "The café\n\n of \U0001f600 and 12"), (2, ""), (3, None), (3, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with open(corpus_pipeline.TOKENIZER, encoding="utf-8") as file:
        own = bpe.ByteBpe(file.read())
    found = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(found) == len(rows)
    for r in found:
        decoded = own.decode(bytes(r.token_ids or b"")).encode()
        assert r.decoded_sha256 == hashlib.sha256(decoded).hexdigest()
        assert r.text_sha256 in (r.decoded_sha256, None)
