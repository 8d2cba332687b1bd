"""Periodic runs (operator 12) against a brute-force search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from webtables.llm import queries, runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every maximal stretch of smallest period q and at least twice q words, by trying each q."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            seg = words[s:e]
            if e - s >= 2 * q and not any(all(seg[k] == seg[k + d] for k in range(len(seg) - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out)


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = sorted((r for r in brute_runs(words) if r[1] >= max(24, 3 * r[2])), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for r in found:
        if best is None or r[1] / r[2] > best[1] / best[2]:
            best = r
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, n, len(found), *four, hashlib.sha256(listing.encode()).hexdigest(),
            hashlib.sha256(kept.encode()).hexdigest())


def test_maximal_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(2000):
        n, k = rng.randint(0, 45), rng.randint(1, 4)
        symbols = [rng.randrange(k) for _ in range(n)]
        assert runs.maximal_runs(np.array(symbols, dtype=np.int64)) == brute_runs(symbols)


LOOP = " ".join(["the cat sat on a mat"] * 10)
TEXTS = [
    None,
    "",
    "  \t\n ",
    "word",
    LOOP,
    "intro " + LOOP + " tail words " + " ".join(["x"] * 30),
    " ".join(["a b"] * 12) + " c",  # 24 words of period 2: a run
    " ".join(["a b"] * 11) + " c",  # 22 words: too short
    " ".join(["p q r s t u v w x"] * 3),  # 27 words, 3 periods of 9: a run
    " ".join(f"w{i}" for i in range(300)),
    " ".join(["a b c d e f g h"] * 3 + ["a b c d"] * 6),  # two runs sharing words, best by length/period
]


def test_rows_equal_brute_force():
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]
    # Ids whose crc32 is divisible by 10 get planted loops; make sure some are here.
    planted_ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    cases = [(d, t) for d, t in zip(ids, TEXTS)] + [(d, " ".join(f"t{j % 50}" for j in range(400))) for d in planted_ids]
    cases += [(None, LOOP), (planted_ids[0], None)]
    for doc_id, text in cases:
        assert runs.analyse(doc_id, text) == brute_row(doc_id, text), (doc_id, text)
    assert runs.analyse(1, None)[3:7] == (None,) * 4


def test_long_text_is_linear_enough():
    text = " ".join(["alpha beta gamma"] * 100_000) + " " + " ".join(f"u{i}" for i in range(100_000))
    row = runs.analyse(3, text)
    assert row[2] == 1 and row[3:6] == (0, 300_000, 3)


def test_query_on_whole_table_equals_brute_force(spark):
    got = queries.op12_runs(spark, SF)
    rows = sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    by_id = {d: t for d, t in texts}
    sample = [r for r in rows if r.n_words <= 400][:150] + [r for r in rows if r.n_runs][:20]
    for r in sample:
        assert tuple(r) == brute_row(r.doc_id, by_id[r.doc_id])
    assert any(r.n_runs for r in rows)


def test_empty_table_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, LOOP, "x", 2)], "doc_id long, text string, n_runs string, start int")
    got = runs.runs(frame).collect()
    assert len(got) == 1 and got[0].n_runs == 1
    assert runs.runs(frame.limit(0)).count() == 0


def test_shortcut_never_hides_a_run():
    rng = random.Random(11)
    for _ in range(300):
        q = rng.randint(1, 12)
        unit = [f"u{rng.randrange(1000)}" for _ in range(q)]
        length = max(24, 3 * q) + rng.randint(0, 3)
        loop = [unit[i % q] for i in range(length)]
        words = [f"a{i}" for i in range(rng.randint(0, 20))] + loop + [f"b{i}" for i in range(rng.randint(0, 20))]
        text = " ".join(words)
        assert runs.analyse(5, text) == brute_row(5, text)
        assert runs.may_repeat(np.array([hash(w) % 10**9 for w in words], dtype=np.int64))
