"""Benchmark decontamination by winnowed fingerprints.

Method. Both sides are cut into lower-cased words. Of the k-gram hashes of a
text, winnowing keeps the minimum of each sliding window of ``window - k + 1``
grams, so that any span of ``window`` words that two texts share holds a
fingerprint that both keep, at the same place of the span. Document
fingerprints are joined with the benchmark's; each hit is then extended word by
word to both sides and counts if it spans at least ``window`` words. An item of
fewer words is one window of its own, whose whole gram is looked up.

Scale. The documents are scanned once. A bitmap of fixed size (``bits``) of the
benchmark's fingerprints goes to the tasks and drops what cannot join; it is
only a filter, the join decides. The join moves only fingerprints that passed,
with the few words around them, and is a broadcast join only where the
benchmark's fingerprints were counted and are few.

Edge cases. Null and empty texts have no words and are not contaminated. A null
item_id is reported as the empty string; items without words never occur.
Repeated document rows each give a row, repeated item ids count once. Columns
other than ``doc_id``, ``text``, ``item_id`` are ignored.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, merged_runs
from .textbytes import ALNUM, U, Words, chunks, grams, inside_rows, sliding_min, utf8

WINDOW, K, BITS = 13, 6, 1 << 23
#: Benchmark fingerprints are broadcast up to this count (about 50 MB), and shuffled beyond it.
BROADCAST_ROWS = 100_000

_PRINT = "array<struct<kind int, at long, print long, left int, words array<string>>>"
_PRINT_PA = pa.list_(pa.struct([("kind", pa.int32()), ("at", pa.int64()), ("print", pa.int64()), ("left", pa.int32()), ("words", pa.list_(pa.string()))]))


def _selected(words: Words, window: int, k: int, short: list[int]):
    """(kind, positions, prints): kind 0 are winnowed k-grams, kind n the grams of n words for items that short."""
    n_grams = len(words.start) - k + 1
    w = window - k + 1
    if n_grams >= w:
        h = grams(words.hash, k)
        spans = inside_rows(words.of, window, n_grams - w + 1)
        low = sliding_min(h, w)
        low[~spans] = 0  # no window here
        # a gram is kept if it is the minimum of a window that holds it
        top = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
        kept = np.flatnonzero(~sliding_min(~top, w) == h)
        yield 0, kept, h[kept]
    for n in short:
        if len(words.start) >= n:
            h = grams(words.hash, n)
            at = np.flatnonzero(inside_rows(words.of, n, len(h)))
            yield n, at, h[at] ^ U(n)


def _prints(words: Words, row: int, where, window: int, k: int) -> list[dict]:
    out, a, b = [], words.of[row], words.of[row + 1]
    reach = window - k
    for kind, at, h in where:
        lo, hi = (max(a, at - reach), min(b, at + k + reach)) if kind == 0 else (at, at + kind)
        out.append({"kind": kind, "at": int(at - a), "print": int(np.int64(h)), "left": int(at - lo), "words": [words.text(i) for i in range(lo, hi)]})
    return out


def _scan(batches, window: int, k: int, short: list[int], bitmap, exact: bool):
    """Rows of id, digest, number of words and prints. exact: the benchmark's side, whose short items are whole grams."""
    bits = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little")
    for batch in batches:
        buf, offs = utf8(batch.column(1))
        n_words, digests, prints = [], [], []
        for _, _, b, o in chunks(buf, offs):
            words = Words(b, o, ALNUM)
            found: dict[int, list] = {}
            sizes = np.diff(words.of)
            for kind, at, h in _selected(words, window, k, short):
                rows = np.searchsorted(words.of, at, "right") - 1
                keep = np.ones(len(at), bool) if bits is None else bits[(h & U(len(bits) - 1)).astype(np.int64)] == 1
                if exact and kind:
                    keep &= sizes[rows] == kind
                for r, x, y in zip(rows[keep].tolist(), at[keep].tolist(), h[keep].view(np.int64).tolist(), strict=True):
                    found.setdefault(r, []).append((kind, x, y))
            n_words += sizes.tolist()
            digests += [xxhash.xxh3_128_hexdigest(b[o[i] : o[i + 1]]) for i in range(len(o) - 1)]
            prints += [_prints(words, r, found[r], window, k) if r in found else [] for r in range(len(o) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(n_words, pa.int64()), pa.array(prints, _PRINT_PA)], ["id", "digest", "n_words", "prints"])


def _fingerprints(df: DataFrame, key: str, window: int, k: int, short: list[int], bitmap=None, exact: bool = False) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col("text").cast("string")).mapInArrow(partial(_scan, window=window, k=k, short=short, bitmap=bitmap, exact=exact), f"id {kind}, digest string, n_words long, prints {_PRINT}")


def _bitmap(prints: DataFrame, bits: int) -> bytes:
    """``bits`` / 8 bytes, whatever the number of prints."""
    at = F.col("print").bitwiseAND(bits - 1)
    parts = prints.select((at + 1).alias("v")).groupBy(F.expr("bitmap_bucket_number(v)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(v))").alias("bytes")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in parts:
        piece = np.frombuffer(row["bytes"], np.uint8)
        start = (row["bucket"] - 1) * 4096
        out[start : start + 4096] = piece[: max(0, len(out) - start)]
    return out.tobytes()


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, bits: int = BITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document row: doc_id, n_words, spans (array of [start, end) in words, disjoint) and items (ids as strings, sorted)."""
    if not 0 < k <= window or bits & (bits - 1):
        raise ValueError("0 < k <= window and a power of two of bits are needed")
    spark = documents.sparkSession
    items = _fingerprints(benchmark, "item_id", window, k, list(range(1, window)), exact=True)
    items = materialize(items.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"), F.inline("prints")), "benchmark-prints").withColumnsRenamed({"at": "item_at", "left": "item_left", "words": "item_words"})
    counted = items.agg(F.count("*"), F.array_sort(F.collect_set(F.when(F.col("kind") > 0, F.col("kind"))))).first()
    bitmap = spark.sparkContext.broadcast(_bitmap(items, bits))
    scanned = materialize(_fingerprints(documents, "doc_id", window, k, list(counted[1]), bitmap), "document-prints").withColumnRenamed("id", "doc_id")
    # equal texts have equal hits: each text's prints are joined once
    prints = scanned.filter(F.size("prints") > 0).select("digest", "prints").dropDuplicates(["digest"]).select("digest", F.inline("prints"))
    hits = prints.join(F.broadcast(items) if counted[0] <= broadcast_rows else items, ["kind", "print"])
    reach = window - k
    same = lambda i: f"get(words, left + {i}) = get(item_words, item_left + {i})"
    run = lambda n, at: f"aggregate(sequence(1, {n}), 0, (acc, i) -> CASE WHEN acc = i - 1 AND {same(at)} THEN i ELSE acc END)" if n else "0"
    hits = hits.withColumns({
        "back": F.expr(f"CASE WHEN kind > 0 THEN 0 ELSE {run(reach, '-i').replace('+ -i', '- i')} END"),
        "ahead": F.expr(f"CASE WHEN kind > 0 THEN IF(words = item_words, kind, 0) ELSE {run(k + reach, '(i - 1)')} END"),
    })
    hits = hits.filter(F.expr(f"CASE WHEN kind > 0 THEN ahead = kind ELSE ahead >= {k} AND back + ahead >= {window} END"))
    hits = hits.select("digest", "item", (F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("ahead")).alias("end"))
    runs = merged_runs(hits, "digest").groupBy("digest", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("item").alias("items"))
    by_text = runs.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hit = scanned.filter(F.size("prints") > 0).select("doc_id", "digest", "n_words").join(by_text, "digest", "left")
    clean = scanned.filter(F.size("prints") == 0).select("doc_id", "n_words", F.expr("cast(array() AS array<struct<start: bigint, end: bigint>>)").alias("spans"), F.expr("cast(array() AS array<string>)").alias("items"))
    none = {"spans": "cast(array() AS array<struct<start: bigint, end: bigint>>)", "items": "cast(array() AS array<string>)"}
    return hit.select("doc_id", "n_words", *(F.coalesce(c, F.expr(e)).alias(c) for c, e in none.items())).unionByName(clean)


def report(found: DataFrame) -> DataFrame:
    """The counts and the verdict of each document, from ``contamination``."""
    hit = F.expr("aggregate(spans, 0L, (acc, s) -> acc + s.end - s.start)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), h AS (
  SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), c AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
