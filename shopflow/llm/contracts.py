"""What SQL can say of operators whose whole results it can't express: queries over the same results, with their oracles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries
from .merkle import CRC_TABLE, crc_sql


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the mix, and whether each source's taken words come within one per cent (or one word) of its target."""
    mixed = queries.op2_mixing(spark, sf_dir)
    by_source = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).select(F.col("source").alias("of"), (F.abs(F.col("t") - F.col("g")) <= 0.01 * F.col("g") + 1).alias("met"))
    both = mixed.join(by_source, F.col("source").eqNullSafe(F.col("of")))
    return both.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within"), "met")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the base spans, which the method may not change."""
    return queries.op4_pii(spark, sf_dir).drop("spans")


def flac_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as read back from the stored streams."""
    return queries.op7_flac(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are held out, which have no language, and whether scores are in range."""
    found = queries.op9_language_id(spark, sf_dir)
    return found.select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("is_und"), F.col("score").between(0, 1).alias("in_range"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts that fingerprints are taken of, and whether likenesses are in range, with 1 for texts that the edit left as they were."""
    found = queries.op13_phrase_fingerprint(spark, sf_dir)
    same = (F.col("fingerprint") != F.col("edited_fingerprint")) | (F.col("near_edited") == 1)
    return found.select("doc_id", "n_chars", "edited_sha256", (F.col("near_edited").between(0, 1) & F.col("near_next").between(0, 1) & same).alias("in_range"))


_MIXING = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN cap <= w * level THEN cap ELSE (sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE cap <= w * level) OVER (), 0)) * w / sum(w) FILTER (WHERE cap > w * level) OVER () END AS target FROM l)
SELECT doc_id, d.source, CAST(sum(size) AS BIGINT) AS size, CAST(any_value(source_size) AS BIGINT) AS source_size, round(any_value(target), 6) AS target, true AS within, true AS met
FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source GROUP BY doc_id, d.source
"""

#: Patterns of the base spans, and what a match must meet: ``m`` is the match.
_DIGITS = "list_transform(regexp_extract_all(m, '[0-9]'), lambda x: CAST(x AS INTEGER))"
_LUHN = f"list_sum(list_transform(list_reverse({_DIGITS}), lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0"
_BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: TRY_CAST(x AS HUGEINT) <= 255))"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15"),
}


def _pii_sql() -> str:
    found = [f"SELECT r, {i} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM d" for i, (kind, (p, _)) in enumerate(_BASE.items())]
    good = " ".join(f"WHEN '{kind}' THEN {c}" for kind, (_, c) in _BASE.items())
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in _BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(found)}),
m AS (SELECT r, k, kind, unnest(ms) AS m, unnest(gaps[: len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM f WHERE len(ms) > 0),
p AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS z FROM m),
s AS (SELECT r, k, kind, z - length(m) AS a, z FROM p WHERE CASE kind {good} END),
c AS (SELECT r, {counts}, string_agg(concat(kind, ':', a, ':', z), ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN c USING (r)
"""


_FLAC = f"""
WITH {CRC_TABLE}, d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, b || repeat('\\xFF'::BLOB, CASE WHEN octet_length(b) = 0 THEN 576 ELSE (576 - octet_length(b) % 576) % 576 END) AS x FROM d),
t AS (SELECT *, list_transform(range(32), lambda j: CAST('0x' || right(hex(x), 64)[2 * j + 1 : 2 * j + 2] AS UBIGINT)) AS last FROM p)
SELECT doc_id, n_bytes, CAST(octet_length(x) AS BIGINT) AS payload_bytes, sha256(x) AS payload_sha256,
  CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), last), lambda c, b: xor(c >> 8, crc_t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS BIGINT) AS tail_crc32 FROM t, crc_table
"""

_LANGUAGE = f"""
WITH {CRC_TABLE}
SELECT doc_id, coalesce({crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0, false) AS held_out, text IS NULL OR NOT regexp_matches(text, '\\p{{L}}') AS is_und, true AS in_range FROM documents, crc_table
"""

_EDITS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS following FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST))
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 3) || left(following, length(t) // 3)) AS edited_sha256, true AS in_range FROM n
"""

QUERIES = {f.__name__: f for f in (mixing_targets, pii_base_spans, flac_payloads, language_folds, fingerprint_edits)}
ORACLE_SQL = {"mixing_targets": _MIXING, "pii_base_spans": _pii_sql(), "flac_payloads": _FLAC, "language_folds": _LANGUAGE, "fingerprint_edits": _EDITS}
