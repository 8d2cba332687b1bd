"""The registered queries of the operators, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from webtables.llm import align, bagminhash, bpe, chat, decontaminate, langmask, lengths, multiset, ordinal, rules, runs, simple8b, wrappers
from webtables.llm.common import materialise, shared_folder, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(table(spark, sf_dir, "documents"), WORD_BPE, shared_folder(spark))


def op3_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprints(table(spark, sf_dir, "documents"))


def op4_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once, as the sums over it read it twice.
    return lengths.context_limits(materialise(lengths.histogram(table(spark, sf_dir, "documents"), BYTE_BPE)))


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op10_langmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmask.languages(table(spark, sf_dir, "documents"))


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *rules.OUTPUT)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs(table(spark, sf_dir, "documents"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_bpe": op1_bpe,
    "op2_simple8b": op2_simple8b,
    "op3_multiset": op3_multiset,
    "op4_ordinal": op4_ordinal,
    "op5_bagminhash": op5_bagminhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat": op7_chat,
    "op8_lengths": op8_lengths,
    "op9_wrappers": op9_wrappers,
    "op10_langmask": op10_langmask,
    "op11_rules": op11_rules,
    "op12_runs": op12_runs,
    "op13_align": op13_align,
}

SQL: dict[str, str] = {
    "op11_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, text,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
            FROM documents),
        tri AS (
            SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
            FROM d, unnest(range(1, len(ws) - 1)) AS u(i)),
        rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM tri) WHERE c >= 2),
        cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, unnest([0, 1, 2]) AS v(k) GROUP BY r),
        dup AS (
            SELECT r, sum((c - 1) * length(l)) AS chars
            FROM (SELECT r, l, count(*) AS c FROM d, unnest(ls) AS u(l) GROUP BY r, l) GROUP BY r),
        base AS (
            SELECT d.r, doc_id, text, ws, ls, CAST(len(ws) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup.chars, 0) AS dup_chars
            FROM d LEFT JOIN cov USING (r) LEFT JOIN dup USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
            CASE WHEN n_words < 50 OR 100 * n_repeat_words > 50 * n_words THEN false
                WHEN n_words > 100000
                    OR word_chars < 3 * n_words OR word_chars > 10 * n_words
                    OR 10 * n_symbols > n_words
                    OR 10 * n_dup_lines > 3 * len(ls)
                    OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 8 * n_words
                    OR 10 * len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) > 3 * len(ls)
                    OR 10 * len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*(•|-|\*)'))) > 9 * len(ls)
                    OR 5 * dup_chars > length(text)
                THEN false ELSE true END AS kept
        FROM base
    """,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    "op6_decontaminate": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents),
        items AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM benchmark),
        windows AS (
            SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
            FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i) WHERE len(ws) > 0),
        runs AS (
            SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w
            FROM docs, (SELECT DISTINCT k FROM windows), unnest(range(1, len(ws) - k + 2)) AS t(i)),
        found AS (SELECT r, i, k, item FROM runs JOIN windows USING (k, w)),
        hit AS (
            SELECT r, count(DISTINCT p) AS n_hit
            FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
        named AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
    """,
    "op7_chat": """
        WITH turns AS (
            SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS k, role, text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p
            FROM conversations),
        logs AS (SELECT conv_id, k, count(*) AS n, list({'r': role, 't': text} ORDER BY p) AS said FROM turns GROUP BY conv_id, k),
        kept AS (
            SELECT * FROM logs AS a WHERE NOT EXISTS (
                SELECT 1 FROM logs AS b
                WHERE b.n >= a.n AND b.said[1] = a.said[1] AND b.said[1:a.n] = a.said
                    AND (b.n > a.n OR b.conv_id < a.conv_id OR (a.conv_id IS NULL AND b.conv_id IS NOT NULL))))
        SELECT t.conv_id, (p - 1) // 64 AS part, n AS n_turns,
            string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY p) AS text
        FROM turns AS t JOIN kept USING (k) GROUP BY t.conv_id, part, n
    """,
}
