"""Queries over the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.llm import boilerplate, charset, near_duplicates, residue, seen_keys, tokens, truncation
from webloom.runtime import table


def p1_found(spark, d):
    return charset.garbled_records(table(spark, d, "responses"), table(spark, d, "headers"))


def p1_restored(spark, d):
    return charset.garbled_records(table(spark, d, "responses"), table(spark, d, "headers"), with_text=True)


def p2_found(spark, d):
    return seen_keys.seen_before(table(spark, d, "fingerprints"), table(spark, d, "seen_keys"))


def p2_error_rate(spark, d):
    return seen_keys.error_rates(table(spark, d, "fingerprints"), table(spark, d, "seen_keys"))


def p2_filter_size(spark, d):
    codes = seen_keys.filter_codes(table(spark, d, "seen_keys").select("fingerprint").unionByName(table(spark, d, "fingerprints").select("fingerprint")))
    return codes.agg(F.sum("n").alias("n_keys"))


def p3_found(spark, d):
    return residue.residue_pages(table(spark, d, "responses"))


def p3_validation(spark, d):
    return residue.validation(table(spark, d, "responses"))


def p5_found(spark, d):
    return boilerplate.main_lines(table(spark, d, "responses"))


def p5_validation(spark, d):
    return boilerplate.validation(table(spark, d, "responses"))


def p6_found(spark, d):
    return near_duplicates.near_duplicate_pages(table(spark, d, "responses")).pairs()


def p6_classes(spark, d):
    return near_duplicates.near_duplicate_pages(table(spark, d, "responses")).memberships()


def p7_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


def p7_round_trip(spark, d):
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


def p8_mixture(spark, d):
    return tokens.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return tokens.mixture_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark, d):
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


def p9_shares(spark, d):
    return truncation.truncation_shares(table(spark, d, "documents"))


def queries():
    return {f.__name__: f for f in (
        p1_found, p1_restored, p2_found, p2_error_rate, p2_filter_size, p3_found, p3_validation, p5_found, p5_validation, p6_found, p6_classes,
        p7_ids, p7_round_trip, p8_mixture, p8_shares, p9_found, p9_shares,
    )}


_KEYS = r"""
a AS (SELECT seq, lower(regexp_extract(fingerprint, '^\s*([0-9A-Fa-f]{40})\s*$', 1)) AS k FROM fingerprints),
s AS (SELECT DISTINCT lower(regexp_extract(fingerprint, '^\s*([0-9A-Fa-f]{40})\s*$', 1)) AS k FROM seen_keys)
"""


def oracle_sql():
    return {
        "p2_found": f"""WITH {_KEYS}
            SELECT seq FROM (SELECT seq, k, row_number() OVER (PARTITION BY k ORDER BY seq) AS n FROM a WHERE k <> '')
            WHERE n > 1 OR k IN (SELECT k FROM s)""",
        "p2_filter_size": f"""WITH {_KEYS}
            SELECT count(DISTINCT k)::BIGINT AS n_keys FROM (SELECT k FROM a UNION ALL SELECT k FROM s) WHERE k <> ''""",
        # decoding the ids of a text gives the text back
        "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
