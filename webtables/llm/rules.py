"""Quality rules (operator 11) as a short-circuit cascade, in DataFrame functions only.

Words are the runs of ``[^\\x20\\x09-\\x0D]``. Every document gets its base
figures: n_words, word_chars (code points in words), n_symbols (characters of
``[#*$%&|<>]``), n_dup_lines (``\\n``-split lines that hold a word and equal an
earlier line) and n_repeat_words (words inside 3-word windows that the text holds
twice or more, the first one included). ``base_failed`` is ``n_words < 50`` or
more than half of the words repeated.

A document that passes the base is kept if it breaks none of ``RULES``. Their
verdict is a conjunction, so their order changes no result, only the work: the
cascade asks them one by one in a ``CASE`` and stops at the first that rejects.
``cascade_order`` measures on a bounded sample of documents (``SAMPLE_ROWS``,
drawn by a hash of the row, not by the table's layout) what each rule costs and
how many documents it rejects, and orders the rules by rejections per second.

Per row, with nothing shuffled: within a text, equal lines are found by
``array_distinct`` (hashed) and repeated windows by sorting them, so a very long
text costs n log n and no pairs. Null and empty texts have no words and fail
the base; ``kept`` is then false. Repeated rows and equal doc_ids are scored
one by one; further columns pass through, and input columns named like an
output column, or ``_words`` and ``_lines``, are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from webtables.llm.common import materialise

#: Rows of the sample on which rules are timed and counted (a parameter).
SAMPLE_ROWS = 2000

#: The characters counted as symbols and the white space between words.
SYMBOLS = "[#*$%&|<>]"
SPACE = "[\\x20\\x09-\\x0D]"
#: The same inside SQL string literals, whose backslashes are escapes.
SQL_SPACE = SPACE.replace("\\", "\\\\")

OUTPUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
HELPERS = ["_words", "_lines"]

WORDS = f"filter(split(coalesce(text, ''), '{SQL_SPACE}+'), w -> w != '')"
# Lines that hold a word.
LINES = f"filter(split(coalesce(text, ''), '\\n'), l -> l rlike '{SQL_SPACE.replace('[', '[^', 1)}')"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once, even where
    the optimizer substitutes columns into expressions (as filters pushed down do)."""
    return f"transform(array({value}), {name} -> {body})[0]"


# 3-word windows of words ``ws`` with their place, sorted (by sort_array: array_sort would
# call an interpreted comparator); a window is repeated if a
# sorted neighbour equals it; the words covered by repeated windows.
WINDOWS = """sort_array(CASE WHEN size(ws) >= 3 THEN transform(sequence(0, size(ws) - 3),
    i -> named_struct('t', concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]), 'i', i)) ELSE array() END)"""
REPEATED = """filter(sequence(0, size(win) - 1), j -> size(win) > 0 AND (
    (CASE WHEN j > 0 THEN win[j - 1].t = win[j].t ELSE false END)
    OR (CASE WHEN j < size(win) - 1 THEN win[j + 1].t = win[j].t ELSE false END)))"""
COVERED = f"size(array_distinct(flatten(transform({REPEATED}, j -> sequence(win[j].i, win[j].i + 2)))))"
REPEAT_WORDS = let("_words", "ws", let(WINDOWS, "win", COVERED))
# Characters of lines equal to an earlier one: in the sorted lines, those equal to their predecessor.
DUP_LINE_CHARS = """aggregate(sort_array(_lines), named_struct('p', CAST(NULL AS STRING), 's', 0L),
    (acc, l) -> named_struct('p', l, 's', acc.s + CASE WHEN acc.p = l THEN length(l) ELSE 0 END), acc -> acc.s)"""

#: The method's rules: name, SQL that is true when the rule rejects. They read the base
#: figures, the words (_words) and the lines with a word (_lines).
RULES: dict[str, str] = {
    "too_many_words": "n_words > 100000",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * size(_lines)",
    "letters": "10 * size(filter(_words, w -> w rlike '\\\\p{L}')) < 8 * n_words",
    "ellipsis_lines": "10 * size(filter(_lines, l -> l rlike '(\\\\.\\\\.\\\\.|\\u2026)[\\\\x20\\\\x09-\\\\x0D]*\\\\z')) > 3 * size(_lines)",
    "bullet_lines": "10 * size(filter(_lines, l -> l rlike '^[\\\\x20\\\\x09-\\\\x0D]*(\\u2022|-|\\\\*)')) > 9 * size(_lines)",
    "dup_line_chars": f"5 * {DUP_LINE_CHARS} > length(text)",
}


def base(documents: DataFrame) -> DataFrame:
    """The documents with the base figures, ``base_failed``, and the helper
    columns ``_words`` and ``_lines`` that the rules read."""
    others = [c for c in documents.columns if c not in OUTPUT + HELPERS]
    words = documents.select(*others, F.expr(WORDS).alias("_words"), F.expr(LINES).alias("_lines"))
    figures = words.select(
        *others,
        "_words",
        "_lines",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, "")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEAT_WORDS).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return figures.withColumn("base_failed", failed)


def verdict(order: list[str]) -> Column:
    """False at the first rule, in this order, that rejects; the base first."""
    case = "CASE WHEN base_failed THEN false " + " ".join(f"WHEN {RULES[r]} THEN false" for r in order)
    return F.expr(case + " ELSE true END")


def cascade_order(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, repeats: int = 2) -> list[dict]:
    """Rules with their measured cost (seconds on the sample, beyond reading it) and
    rejections (sample documents past the base that they reject), best first."""
    total = documents.count()
    if not total:
        return [{"rule": r, "seconds": 0.0, "rejected": 0} for r in RULES]
    share = min(1.0, sample_rows / total)
    # A draw by a hash of the row's values is the same under any layout of the table.
    drawn = documents.where(F.abs(F.xxhash64(*documents.columns)) % 1_000_000 < share * 1_000_000)
    sample = materialise(base(drawn).where(~F.col("base_failed")))

    def timed(column: Column) -> tuple[float, int]:
        best, value = float("inf"), 0
        for _ in range(repeats):
            began = time.perf_counter()
            value = sample.agg(F.sum(column.cast("int"))).first()[0] or 0
            best = min(best, time.perf_counter() - began)
        return best, value

    reading, _ = timed(F.size("_words") + F.size("_lines") >= 0)
    found = []
    for rule, sql in RULES.items():
        seconds, rejected = timed(F.expr(sql))
        found.append({"rule": rule, "seconds": max(seconds - reading, 1e-4), "rejected": int(rejected)})
    return sorted(found, key=lambda r: (-r["rejected"] / r["seconds"], r["rule"]))


def quality(documents: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per document: its columns, the base figures, base_failed and kept."""
    if order is None:
        order = [r["rule"] for r in cascade_order(documents)]
    return base(documents).withColumn("kept", verdict(order)).drop(*HELPERS)
