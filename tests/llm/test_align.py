"""Cross-tokenizer alignment (operator 13) against a plain two-pointer walk."""

import collections
import hashlib
import itertools
import random

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from webtables.llm import align, queries
from webtables.llm.bpe import byte_symbols

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SYMBOLS = byte_symbols()


def a_bytes(i):
    return bytes(SYMBOLS[c] for c in A.id_to_token(i))


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """(n_a, n_b, groups) by walking both lists' byte offsets together."""
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    want = (" " + text).encode("utf-8", "surrogatepass")
    if b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
        return None
    groups, i, j, ea, eb, ga, gb = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if j >= len(b) or (i < len(a) and ea + len(a_bytes(a[i])) <= eb + (len(b_bytes(b[j])) if j < len(b) else 0)):
            ea += len(a_bytes(a[i]))
            ga.append(a[i])
            i += 1
        else:
            eb += len(b_bytes(b[j]))
            gb.append(b[j])
            j += 1
        if ea == eb and ga and gb:
            groups.append((ga, gb))
            ga, gb = [], []
    return a, b, groups


def expected(rows):
    planned = [(d, plain(t)) for d, t in rows]
    docs = collections.Counter()
    for _, p in planned:
        if p:
            docs.update({(x, y) for ga, gb in p[2] for x in ga for y in gb})
    best = collections.defaultdict(int)
    for (x, _), c in docs.items():
        best[x] = max(best[x], c)
    out = []
    for d, p in planned:
        if not p:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups = p
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(docs[l] == best[l[0]] for l in links),
                    sum(docs[l] for l in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


TEXTS = [None, "", "Hello world", "Hello world", "  two  spaces\tand\ttabs\n\nlines ", "<|endoftext|> is plain <s> text",
         "naïve café — ünïcödé 日本語のテキスト", "x" * 3000, "ﬁ ligature is normalised", "emoji 🙂🙃 and \u0007 control"]


def test_rows_equal_plain_walk(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "Hello world"), (3, "again")]
    frame = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, n_a string, _row int")
    got = align.alignment(frame, queries.BYTE_BPE, queries.PIECE_BPE)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)
    assert align.alignment(frame.limit(0), queries.BYTE_BPE, queries.PIECE_BPE).count() == 0


def test_query_equals_plain_walk(spark):
    got = queries.op13_align(spark, SF)
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected([(d, t) for d, t in texts])


SIGNS = [*" aAéßzŁ.,;'\n\t5!<|>#-_", "\x00", "\x0b", "\x1c", "\x85", "\xa0", "×", "÷", "¿", "«", "ȿ", "ɐ", "\u0301", "\u1680", "\u2009",
         "\u2028", "\u3000", "\u180e", "▁", "…", "“", "Ж", "д", "日", "の", "🙂", "'s", "n't", " the", " of", "\r\n", "  ", "ing", "heit", "<s>", "<|endoftext|>"]


def test_pieces_align_as_their_text_does():
    # Every order of two and of three signs once, and longer texts of many.
    drawn = random.Random(5)
    texts = ["".join(x) for x in itertools.product(SIGNS, repeat=2)]
    texts += ["".join(drawn.choices(SIGNS, k=drawn.choice([3, 3, 5, 9, 40]))) for _ in range(6000)]
    texts += [None, ""]
    with open(queries.BYTE_BPE, encoding="utf-8") as a, open(queries.PIECE_BPE, "rb") as b:
        model = align.Aligner(a.read(), b.read())
    for part in itertools.batched(texts, 500):
        # The second time from the pieces kept.
        for _ in range(2):
            n_a, n_b, n_groups, n_links, digest, pairs = (x.to_pylist() for x in model.columns(pa.array(part, pa.string())))
            for i, text in enumerate(part):
                want = plain(text)
                a, b, groups = want or ([], [], [])
                links = collections.Counter((x << 32) + y for ga, gb in groups for x in ga for y in gb)
                shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
                figures = (len(a), len(b), len(groups), links.total())
                assert (n_a[i], n_b[i], n_groups[i], n_links[i]) == figures, repr(text)
                assert digest[i] == (hashlib.sha256(shown.encode()).hexdigest() if want else ""), repr(text)
                assert {p["pair"]: p["links"] for p in pairs[i]} == links, repr(text)


def test_words_are_encoded_once_whatever_mark_follows():
    pieces, bounds = align.pieces_of(pa.array(["word, word.\nword", "", "word;"]))
    assert pieces.to_pylist() == [" word", ",", " word", ".", "\n", "word", " ", " word", ";"]
    assert bounds.tolist() == [0, 6, 7, 9]
