"""Quality rules (operator 11) against plain Python and DuckDB."""

import collections
import re

import duckdb
import pytest

from webtables.llm import queries, rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    n = len(words)
    lines = [l for l in (text or "").split("\n") if WORD.search(l)]
    seen, dup, dup_chars = set(), 0, 0
    for line in lines:
        if line in seen:
            dup += 1
            dup_chars += len(line)
        seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    covered = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] >= 2 for k in range(3)}
    word_chars = sum(map(len, words))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = n < 50 or 100 * len(covered) > 50 * n
    rejected = (
        n > 100000
        or word_chars < 3 * n
        or word_chars > 10 * n
        or 10 * symbols > n
        or 10 * dup > 3 * len(lines)
        or 10 * sum(bool(re.search(r"[^\W\d_]", w)) for w in words) < 8 * n
        or 10 * sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", l)) for l in lines) > 3 * len(lines)
        or 10 * sum(bool(re.match(r"[\x20\x09-\x0D]*(•|-|\*)", l)) for l in lines) > 9 * len(lines)
        or 5 * dup_chars > len(text or "")
    )
    return (n, word_chars, symbols, dup, len(covered), failed, not failed and not rejected)


PROSE = " ".join(f"word{i} alpha beta{i % 7}" for i in range(40))
TEXTS = [
    None,
    "",
    "   \n\t ",
    PROSE,
    PROSE + "\n" + PROSE + "\n" + PROSE,
    "\n".join([PROSE[:200]] * 5 + [PROSE]),
    " ".join(["a b c"] * 30),
    "# $ % & | < > * " * 40,
    "\n".join(f"- item {i} here and there..." for i in range(60)),
    "x" * 5000 + " " + PROSE,
    " ".join(f"w{i % 97}" for i in range(30000)),
    "1 2 3 4 5 6 7 8 9 10 " * 10,
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(3, PROSE, "again", 7), (None, PROSE, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, _lines int")


@pytest.mark.parametrize("order", [list(rules.RULES), list(reversed(rules.RULES)), None])
def test_against_plain_python(spark, frame, order):
    got = rules.quality(frame, order)
    assert "_lines" not in got.columns and got.schema["n_words"].dataType.simpleString() == "bigint"
    found = sorted((r.doc_id if r.doc_id is not None else -1, tuple(r[c] for c in rules.OUTPUT)) for r in got.collect())
    want = sorted(
        (d if d is not None else -1, plain(t))
        for d, t in [(i, t) for i, t in enumerate(TEXTS)] + [(3, PROSE), (None, PROSE)]
    )
    assert found == want
    assert any(w[1][-1] for w in want) and any(w[1][-2] for w in want) and any(not w[1][-1] and not w[1][-2] for w in want)


def test_order_by_rejections_per_cost(spark, frame):
    order = rules.cascade_order(frame)
    assert sorted(r["rule"] for r in order) == sorted(rules.RULES)
    ratios = [r["rejected"] / r["seconds"] for r in order]
    assert ratios == sorted(ratios, reverse=True)
    assert rules.cascade_order(frame.limit(0))[0]["rejected"] == 0
    assert rules.quality(frame.limit(0)).count() == 0


def test_query_equals_sql(spark):
    got = queries.op11_rules(spark, SF).toPandas()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = connection.execute(queries.SQL["op11_rules"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda frame: sorted(map(tuple, frame[sorted(frame.columns)].astype(str).values.tolist()))
    assert key(got) == key(want)


def test_sorting_calls_no_comparator_and_words_are_not_searched_again(frame):
    plan = rules.base(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(if" not in plan and "array_sort" not in rules.DUP_LINE_CHARS
    assert plan.count("regexp_replace") == 1  # the symbols; word_chars come from the words
