"""Near copies and fingerprints against plain Python."""

import collections
import hashlib
import itertools

import numpy as np
import pytest

from webtables.llm import bagminhash, multiset
from webtables.llm.common import WordHashes, clean_words, table
from webtables.llm.components import components


def bag_of(text):
    words = [w.decode() for w in clean_words(text)]
    if not words:
        return collections.Counter()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def overlap(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def groups_of(texts, threshold=0.8):
    """Classes by comparing every pair that shares a shingle."""
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {k: bag_of(t) for k, t in texts.items()}
    holders = collections.defaultdict(list)
    same = collections.defaultdict(list)
    for k, t in texts.items():
        same[t].append(k)
        for s in bags[k]:
            holders[s].append(k)
    pairs = {p for ks in holders.values() for p in itertools.combinations(ks, 2)}
    links = [p for p in pairs if overlap(bags[p[0]], bags[p[1]]) >= threshold]
    links += [(ks[0], k) for ks in same.values() for k in ks[1:]]
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {k: find(k) for k in texts}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(50):
        element = rng.integers(0, 2**63, 150, dtype=np.uint64)
        a = rng.integers(1, 9, 150)
        b = np.where(rng.random(150) < 0.3, rng.integers(0, 12, 150), a)
        owner = np.concatenate([np.zeros(150, int), np.ones((b > 0).sum(), int)])
        points = bagminhash.signatures(owner, np.concatenate([element, element[b > 0]]), np.concatenate([a, b[b > 0]]), 2)
        errors.append((points[0] == points[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.06


def test_overlap_counts_repeats():
    cache = WordHashes()
    a, b = "a b c d e f a b c d e f", "a b c d e f"
    assert bagminhash.overlap(a, b, cache) == pytest.approx(overlap(bag_of(a), bag_of(b)))


def test_classes_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    expected = groups_of({r.doc_id: r.text for r in docs.collect()})
    rows = bagminhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == expected
    sizes = collections.Counter(expected.values())
    assert all(r.class_size == sizes[r.class_id] and r.is_copy == (r.doc_id != r.class_id) for r in rows)
    kept = bagminhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(sizes)


def test_odd_copies(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "###"), (6, "###"), (7, "short"), (8, "Short!"), (9, long), (10, long + " more"), (None, "odd one"), (9, long), (None, None)]
    frame = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, bands string, node string")
    found = sorted((r.doc_id or -1, r.class_id or -1) for r in bagminhash.near_duplicates(frame).collect())
    assert found == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 7), (9, 9), (9, 9), (10, 9), (-1, -1), (-1, -1)])
    kept = bagminhash.deduplicated(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 5, 7, 9]
    assert bagminhash.near_duplicates(frame.limit(0)).count() == 0
    assert bagminhash.deduplicated(frame.limit(0)).count() == 0


def test_chain_of_copies_is_one_class(spark):
    """Neighbours overlap enough, the ends share little: links must not be lost."""
    words = [f"v{i}" for i in range(600)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 200])) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in bagminhash.near_duplicates(frame).collect()} == {0}


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)]
    rows = components(spark.createDataFrame(chain, "a long, b long")).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.component].add(r.node)
    assert sorted(map(sorted, by.values())) == [list(range(201)), [1000, 1001]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in multiset.fingerprints(docs).collect()}
    assert len(rows) == len(texts)
    prints = {}
    for here, after in zip(order, [*order[1:], order[0]], strict=True):
        row, text, coming = rows[here], texts[here], texts[after]
        half = len(text) // 2
        changed = text[: len(text) - half] + coming[:half]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        own = multiset.vectors([text], WordHashes())
        assert multiset.written(*own) == [row.fingerprint]
        assert multiset.written(*multiset.vectors([changed], WordHashes())) == [row.edited_fingerprint]
        assert row.near_next == pytest.approx(multiset.likeness(own, multiset.vectors([coming], WordHashes()))[0])
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_are_homomorphic():
    cache = WordHashes()
    whole, part, rest = (multiset.vectors([t], cache) for t in ("one two\nthree four five\nsix", "six", "three four five\none two"))
    assert multiset.written(*multiset.added(part, rest)) == multiset.written(*whole)
    assert multiset.written(*multiset.removed(whole, part)) == multiset.written(*rest)


def test_odd_fingerprints(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "ab" * 40_000), (3, "ab cd")]
    frame = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, fingerprint string")
    found = multiset.fingerprints(frame).collect()
    assert len(found) == 6
    assert len({r.fingerprint for r in found if r.n_chars == 0}) == 1
    one = multiset.fingerprints(frame.limit(0).union(frame.filter("doc_id is null"))).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(1, 1.0)]
    assert multiset.fingerprints(frame.limit(0)).count() == 0


@pytest.mark.parametrize("repeats", [40_000, 80_000])
def test_likeness_of_many_repeats(repeats):
    """Half of the repeats replaced, and all but a few kept: exact for a single run."""
    cache = WordHashes()
    whole, half, near = (
        multiset.vectors(["a b c\n" * n + "d e f\n" * (repeats - n)], cache) for n in (repeats, repeats // 2, repeats - 9)
    )
    assert multiset.likeness(whole, half)[0] == pytest.approx(2 * 0.5 / (1 + 0.25 + 0.25), abs=1e-6)
    assert multiset.likeness(whole, near)[0] == pytest.approx(1, abs=1e-3)
    assert np.abs(whole[1].view(np.int32)).max() == repeats


@pytest.mark.parametrize("owners", [[0], [0, 1], [0, 1, 2]])
@pytest.mark.parametrize("n", range(11))
def test_shingles_of_few_words(n, owners):
    """Every length from none to twice the width, one owner or several, against plain Python."""
    from webtables.llm.common import shingle_hashes

    rng = np.random.default_rng(n)
    per = {o: rng.integers(0, 2**63, n, dtype=np.uint64) for o in owners}
    hashes = np.concatenate([per[o] for o in owners]).astype(np.uint64)
    owner = np.repeat(np.array(owners), n)
    got, of = shingle_hashes(hashes, owner, 5)
    want = {o: max(1, n - 4) if n else 0 for o in owners}
    assert collections.Counter(of.tolist()) == collections.Counter({o: c for o, c in want.items() if c})
    # Equal windows give equal hashes, unequal ones differ.
    if n >= 5:
        again, _ = shingle_hashes(np.concatenate([per[owners[0]][1:], per[owners[0]][:1]]), np.zeros(n, int), 5)
        assert set(got[: n - 4][1:].tolist()) == set(again[: n - 5].tolist())


def test_deduplicated_keeps_columns_named_like_helpers(spark):
    from webtables.llm import bagminhash

    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "a", "k1", 5), (2, text, "b", "k2", 6), (3, None, "c", "k3", 7), (4, "other " + text, "d", "k4", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id string, _key string, _least int")
    got = sorted(tuple(r) for r in bagminhash.deduplicated(frame).collect())
    assert got == sorted([rows[0], rows[2], rows[3]], key=lambda r: r[0]) or got == sorted([rows[0], rows[2]])
    assert {r[2] for r in got} <= {"a", "c", "d"} and all(isinstance(r[2], str) for r in got)
