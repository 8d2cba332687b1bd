import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from webtables.llm import bpe, lengths, simple8b
from webtables.llm.queries import BYTE_BPE, WORD_BPE

ODD = [
    "", None, " ", "  a  b \n\n c", "a <|endoftext|> b<|endoftext|>", "aaaaaaa aaaaaaaaaaaaaaaa", "it's we'll  x\x1cy z",
    "　 \ta \x85b", "日本語 テスト\U0001f600", "tab\t\ttab \t", "a b c d", "a\0b c", "x" * 50_000, "́é. İI.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def own():
    with open(BYTE_BPE, encoding="utf-8") as file:
        return bpe.ByteBpe(file.read())


def ids_of(own, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in own.encode(pa.array(texts, pa.string())).to_pylist()]


def test_odd_texts_alone_and_together(own, library):
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert ids_of(own, ODD) == expected
    assert [ids_of(own, [t])[0] for t in ODD] == expected
    assert [own.decode(np.array(i, "<u4").tobytes()) for i in expected] == [library.decode(i, skip_special_tokens=False) for i in expected]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text(own, library, texts):
    assert ids_of(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_half_a_character_decodes_to_replacement(own, library):
    ids = library.encode("\U0001f600", add_special_tokens=False).ids[:1]
    assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, library):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a", "x")] * 2, "doc_id long, text string, n_tokens string")
    rows = bpe.digests(frame, BYTE_BPE).collect()
    assert len(rows) == len(ODD) + 2
    for row in rows:
        text = "a" if row.doc_id is None else ODD[row.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(frame.limit(0), BYTE_BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(ids):
    words, offsets = simple8b.pack(np.array(ids, np.uint64))
    assert simple8b.unpack(words, offsets, len(ids)).tolist() == ids
    assert len(offsets) == -(-len(ids) // simple8b.BLOCK)


def test_file_round_trip(spark, folder):
    texts = [*ODD, "A word, and another. " * 30]
    frame = spark.createDataFrame([(99 - i, t, 1) for i, t in enumerate(texts)] + [(None, "b", 2), (5, "c", 3)], "doc_id long, text string, start int")
    simple8b.write(simple8b.encode_words(simple8b.in_order(frame.select("doc_id", "text")), WORD_BPE, 2), f"{folder}/ids")
    rows = simple8b.read(spark, f"{folder}/ids").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 5, *range(99 - len(texts) + 1, 100)]
    tokenizer = Tokenizer.from_file(WORD_BPE)
    start = 0
    for row in rows:
        text = "b" if row.doc_id is None else "c" if row.doc_id == 5 else texts[99 - row.doc_id]
        expected = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens) == (start, len(expected))
        assert np.frombuffer(row.token_ids, "<u4").tolist() == expected
        start += len(expected)


def test_empty_file(spark, folder):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simple8b.round_trip(empty, WORD_BPE, f"{folder}/none").count() == 0


def test_length_histogram(spark, library):
    texts = ["a", None, "", "one two three", "one two three", "x " * 3000] + ["w " * k for k in range(40)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    hist = lengths.histogram(frame, BYTE_BPE).cache()
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == {c: counts.count(c) for c in counts}
    limits = lengths.context_limits(hist)
    for r in limits.collect():
        longer = [c for c in counts if c >= r.n_tokens]
        assert (r.docs_from, r.tokens_from, r.total_tokens) == (len(longer), sum(longer), sum(counts))
        assert r.truncated_tokens == sum(min(c, r.n_tokens) for c in counts)
        assert r["quantile"] == pytest.approx(sum(c <= r.n_tokens for c in counts) / len(counts))
    assert lengths.truncated_total(hist, 7).first().truncated_tokens == sum(min(c, 7) for c in counts)
    ordered = sorted(counts)
    for r in lengths.quantiles(limits, [0.25, 0.5, 1.0]).collect():
        assert r.n_tokens == ordered[int(np.ceil(r.share * len(ordered))) - 1]
    assert lengths.context_limits(hist.limit(0)).count() == 0
    assert lengths.truncated_total(hist.limit(0), 7).first().total_tokens == 0


def test_word_ids_are_those_of_the_whole_text():
    signs = [*" aAéßzŁİȿ.,;'\n\t5!<|>#-_", "\x00", "\x0b", "\x85", "\xa0", "×", "¿", "«", "ɐ", "\u0301", "\u0307", "\u1680", "\u2028", "\u3000",
             "…", "Σ", "σ", "Ж", "д", "\u212a", "日", "の", "\u1100", "\u1161", "🙂", "'s", "n't", " the", " Of", "\r\n", "  ", "ing", "</w>", "<|endoftext|>"]
    drawn = random.Random(5)
    texts = ["".join(x) for x in itertools.product(signs, repeat=2)]
    texts += ["".join(drawn.choices(signs, k=drawn.choice([3, 3, 5, 9, 40]))) for _ in range(6000)]
    texts += [x for c in range(0xC0, 0x250) for x in (chr(c), f"A{chr(c)}B.")]
    with open(WORD_BPE, encoding="utf-8") as file:
        definition = file.read()
    library, ids = Tokenizer.from_str(definition), simple8b.WordIds(definition)
    for part in itertools.batched([*texts, ""], 500):
        want = [x.ids for x in library.encode_batch(list(part), add_special_tokens=False)]
        # The second time from the pieces kept.
        for _ in range(2):
            got = ids.encode(pa.array(part, pa.string())).to_pylist()
            for text, x, y in zip(part, got, want, strict=True):
                assert np.frombuffer(x, "<u4").tolist() == y, repr(text)


def test_words_are_given_to_the_library_many_at_a_time():
    with open(WORD_BPE, encoding="utf-8") as file:
        ids = simple8b.WordIds(file.read())
    asked, encode = [], ids._ids
    ids._ids = lambda texts: asked.extend(texts) or encode(texts)
    ids.encode(pa.array(["One word, two words.", "(One) word; words"]))
    assert [x.strip() for x in asked if x.strip()] == ["one word two words", ",", ".", "(", ")", ";"]
