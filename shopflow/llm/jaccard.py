"""N-gram Jaccard join by rare-first prefix filtering.

Method. A document's set holds the hashes of its distinct k-word shingles; two
documents link when 100 * intersection >= percent * union. Sets are ordered
rare first, by counts of all shingles of all documents. If two sets link, their
prefixes (n - ceil(t n) + 1 rarest shingles) share one, so only documents that
share a prefix shingle are compared, and of those only pairs that pass

* the length filter (the smaller has at least t of the larger),
* the positional filter (what can follow the shared shingle is enough), and
* a suffix filter (what follows the first shared shingle, partitioned by fixed
  pivots in the space of hashes, allows the overlap part by part);

each pair left is verified once, on the whole sets. Documents with one set are
one class, and classes are joined, not copies.

Dense groups. Of thousands of near copies every two may link. Documents that
share a band of two minhashes are first compared with one document of the band,
the most typical one (whose shingles are the most frequent on average); that
links a dense group in a number of comparisons that grows with its size. The
prefix join then only looks at pairs from different components found so far. No
pair of texts that could add to a component is left out, so components are exact.

Counts are kept in a table of fixed size (``CELLS``), which only orders
shingles: any order gives the same result. Set and shingle hashes have 64 bits.

Scale. Texts are read by maps (counts, sets, and again for the sets that are to
be verified) and never shuffled; only hashes move, each key pre-aggregated or in
joins that Spark can split. Nothing of the size of the corpus reaches the driver.

Edge cases. Null, empty and wordless texts have n_shingles 0 and are components
of their own; with fewer than k words the whole sequence is one shingle.
Repeated rows each give a row; rows of one doc_id and different texts are
different documents. Columns other than doc_id and text are ignored.
"""

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bitmap, is_set, materialize, with_key, without
from .textbytes import NONSPACE, U, Words, chunks, grams, inside_rows, mix, utf8

K, PERCENT, CELLS, PIECES, BANDS, ROWS, BUCKETS = 4, 85, 1 << 22, 64, 4, 2, 64
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | U(1)


def _sets(batch_column, k: int):
    """(row, sorted distinct shingle hashes) of each row of an Arrow column."""
    buf, offs = utf8(batch_column)
    for first, _, b, o in chunks(buf, offs):
        words = Words(b, o, NONSPACE)
        h = grams(words.hash, k)
        for r in range(len(o) - 1):
            a, z = words.of[r], words.of[r + 1]
            if z - a >= k:
                yield first + r, np.unique(h[a : z - k + 1])
            elif z > a:
                yield first + r, grams(words.hash[a:z], int(z - a)) ^ U(z - a)
            else:
                yield first + r, np.zeros(0, np.uint64)


def _count(batches, k: int):
    total, held, size = np.zeros(CELLS, np.uint8), [], 0

    def add():
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        total[cells] = np.minimum(total[cells] + np.minimum(n, 255).astype(np.uint16), 255).astype(np.uint8)
        held.clear()

    for batch in batches:
        buf, offs = utf8(batch.column(0))
        for _, _, b, o in chunks(buf, offs):
            words = Words(b, o, NONSPACE)
            h = grams(words.hash, k)
            held.append((h[inside_rows(words.of, k, len(h))] & U(CELLS - 1)).astype(np.uint32))
            size += len(held[-1])
            if size > 1 << 20:
                add()
                size = 0
    if held:
        add()
    parts = total.reshape(PIECES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["piece", "counts"])


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8).astype(np.uint64)
            total[piece] = total[piece] + x if piece in total else x
    for piece, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(np.minimum(x, 65535).astype(np.uint16).tobytes(), 1)], pa.binary())], ["piece", "counts"])


def shingle_counts(documents: DataFrame, k: int) -> np.ndarray:
    """How often shingles of all documents fall in each of ``CELLS`` cells; 8 MB, whatever the input."""
    parts = documents.select(F.col("text").cast("string")).mapInArrow(partial(_count, k=k), "piece int, counts binary")
    rows = parts.repartition("piece").mapInArrow(_add_up, "piece int, counts binary").collect()
    out = np.zeros((PIECES, CELLS // PIECES), np.uint16)
    for r in rows:
        out[r["piece"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint16)
    return out.ravel()


def required(n, percent: int):
    """The least intersection that sets of n and more shingles need with any set they link to."""
    return (percent * n + 99) // 100


_DESCRIBED = "id long, n int, typical double, bands array<long>, buckets binary, prefix array<long>"


def _describe(batches, k: int, percent: int, counts):
    cells = counts.value
    for batch in batches:
        out = {c: [] for c in ("id", "n", "typical", "bands", "buckets", "prefix")}
        for _, h in _sets(batch.column(1), k):
            n = len(h)
            out["n"].append(n)
            if not n:
                out["id"].append(0)
                out["typical"].append(0.0)
                out["bands"].append([])
                out["buckets"].append(b"")
                out["prefix"].append([])
                continue
            seen = cells[(h & U(CELLS - 1)).astype(np.int64)]
            ranked = np.sort(seen.astype(np.uint64) << U(48) | h >> U(16))
            low = np.array([(h * s).min() for s in _SEEDS], np.uint64).reshape(BANDS, ROWS)
            out["id"].append(xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63)
            out["typical"].append(float(np.log2(1.0 + seen).mean()))
            out["bands"].append(mix(low[:, 0] + mix(low[:, 1] + np.arange(BANDS, dtype=np.uint64))).view(np.int64).tolist())
            out["buckets"].append(np.bincount((h >> U(58)).astype(np.int64), minlength=BUCKETS).astype("<u4").tobytes())
            out["prefix"].append(ranked[: n - required(n, percent) + 1].view(np.int64))
        types = [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["doc_id", *out])


def _emit_sets(batches, k: int, wanted):
    bits, done = np.frombuffer(wanted.value, np.uint8), set()
    for batch in batches:
        ids, sets = [], []
        for _, h in _sets(batch.column(0), k):
            if len(h):
                i = xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63
                at = i & 8 * len(bits) - 1
                if bits[at >> 3] >> (at & 7) & 1 and i not in done:
                    done.add(i)
                    ids.append(i)
                    sets.append(h.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])


def _overlaps(batches, percent: int):
    """The pairs of (a, b, set, set) that link."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([p, q]))
            inter = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * inter >= percent * (len(p) + len(q) - inter))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets link."""
    pairs = materialize(pairs.select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = documents.sparkSession.sparkContext.broadcast(bitmap(ids))
    sets = documents.select(F.col("text").cast("string")).mapInArrow(partial(_emit_sets, k=k, wanted=wanted), "id long, shingles binary")
    sets = materialize(sets.dropDuplicates(["id"]), "sets")  # each set once, as a table, so that Spark can split the joins' hot sets
    left = sets.withColumnsRenamed({"id": "a", "shingles": "x"})
    right = sets.withColumnsRenamed({"id": "b", "shingles": "y"})
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(partial(_overlaps, percent=percent), "a long, b long"), "links")


def _wanted(batches, wanted):
    bits = np.frombuffer(wanted.value, np.uint8)
    for batch in batches:
        yield batch.filter(pa.array(is_set(bits, batch.column(0).to_numpy())))


def _after(buckets, prefixes, at: np.ndarray) -> np.ndarray:
    """Per row, the bucketed counts of a set without its rarest shingles up to place ``at``."""
    out = np.frombuffer(b"".join(buckets.to_pylist()), "<u4").reshape(-1, BUCKETS).astype(np.int64)
    for row, (prefix, last) in enumerate(zip(prefixes, at.tolist(), strict=True)):
        gone = prefix.values.to_numpy()[: last + 1].view(np.uint64)
        np.subtract.at(out[row], (gone >> U(42) & U(BUCKETS - 1)).astype(np.int64), 1)  # the six bits that choose a bucket
    return out


def _suffix(batches, percent: int):
    """Of (a, b, n_a, n_b, at_a, at_b, buckets and prefix of both) the pairs whose suffixes allow the overlap."""
    for batch in batches:
        n_a, n_b, at_a, at_b = (batch.column(i).to_numpy().astype(np.int64) for i in range(2, 6))
        most = 1 + np.minimum(_after(batch.column(6), batch.column(7), at_a), _after(batch.column(8), batch.column(9), at_b)).sum(axis=1)
        yield batch.select([0, 1]).filter(pa.array((100 + percent) * most >= percent * (n_a + n_b)))


def typical_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Each class with the most typical class of its bands: one pair at most for each, the smaller set first."""
    rows = classes.select("id", "n", "typical", F.explode("bands").alias("band"))
    best = rows.groupBy("band").agg(F.max(F.struct("typical", "id", "n")).alias("best"), F.count("*").alias("size")).filter("size > 1")
    near = (F.least("n", "best.n") * 100 >= F.greatest("n", "best.n") * percent) & (F.col("id") != F.col("best.id"))
    chosen = rows.join(best, "band").filter(near).groupBy("id", "n").agg(F.max("best").alias("best"))
    one, other = F.struct("n", "id"), F.struct("best.n", "best.id")
    return chosen.select(F.least(one, other)["id"].alias("a"), F.greatest(one, other)["id"].alias("b")).distinct()


def prefix_pairs(classes: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """Pairs of classes, of different components if ``roots`` are given, that share a prefix shingle and pass the length and positional filters, with the places of the first.

    All that two sets share comes at or after the first shingle they share, in
    both orders, so what is left from there bounds the intersection. Later
    matches only have a lower bound: a pair is found if its first match passes.
    """
    rows = classes.select("id", "n", "prefix")
    rows = rows.withColumn("root", F.col("id")) if roots is None else rows.join(roots, F.col("id") == F.col("node"), "left")
    postings = rows.select("id", F.coalesce("root", "id").alias("root"), "n", F.posexplode("prefix").alias("at", "shingle"))
    # most prefix shingles occur in one component only and end here
    mixed = postings.groupBy("shingle").agg(F.min("root").alias("first"), F.max("root").alias("last")).filter("first != last").select("shingle")
    postings = materialize(postings.join(mixed, "shingle"), "postings")
    x, y = (postings.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "root", "n", "at"))) for s in ("a", "b"))
    both = F.col("n_a") + F.col("n_b")
    needed = F.ceil(both * percent / (100 + percent))
    ok = (
        (F.col("root_a") != F.col("root_b")) & (F.struct("n_a", "id_a") < F.struct("n_b", "id_b")) & (F.col("n_a") * 100 >= F.col("n_b") * percent)
        & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= needed)
    )
    matches = x.join(y, (x["shingle"] == y["shingle"]) & ok)
    return matches.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b").agg(F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))


def describe(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id of each row with what is known of its set."""
    counts = documents.sparkSession.sparkContext.broadcast(shingle_counts(documents, k))
    kind = documents.schema["doc_id"].dataType.simpleString()
    described = documents.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_describe, k=k, percent=percent, counts=counts), f"doc_id {kind}, {_DESCRIBED}")
    return materialize(described, "described")


def _classes(described: DataFrame, *columns: str) -> DataFrame:
    """Each set once."""
    return described.filter("n > 0").select("id", *columns).dropDuplicates(["id"])


def suffix_filter(described: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``prefix_pairs`` whose suffixes, after the first shared shingle, allow the overlap.

    Nothing before the first shared shingle is shared, so 1 plus what the parts of both suffixes can share bounds the intersection.
    """
    pairs = materialize(pairs, "candidates")
    wanted = described.sparkSession.sparkContext.broadcast(bitmap(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))))
    found = described.filter("n > 0").select("id", "buckets", "prefix").mapInArrow(partial(_wanted, wanted=wanted), "id long, buckets binary, prefix array<long>")
    known = materialize(found.dropDuplicates(["id"]), "suffixes")
    x, y = (known.withColumnsRenamed({"id": c, "buckets": f"buckets_{c}", "prefix": f"prefix_{c}"}) for c in "ab")
    sized = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "at_a", "at_b", "buckets_a", "prefix_a", "buckets_b", "prefix_b")
    return sized.mapInArrow(partial(_suffix, percent=percent), "a long, b long")


def jaccard_components(documents: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the component) for each row."""
    described = describe(documents, k, percent)
    typical = materialize(typical_pairs(_classes(described, "n", "typical", "bands"), percent), "typical-pairs")
    links = verify(typical, documents, k, percent)
    roots = materialize(components(links), "roots")
    # a pair that has been compared once and did not link is not compared again
    pairs = prefix_pairs(_classes(described, "n", "prefix"), roots, percent).join(typical, ["a", "b"], "left_anti")
    more = verify(suffix_filter(described, pairs, percent), documents, k, percent)
    roots = materialize(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
    rows = described.select("doc_id", "n", "id").join(roots, F.col("id") == F.col("node"), "left")
    rows = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "id")).alias("root"))
    least = materialize(rows.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")  # a table, so that Spark can split the join's large components
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_join(documents: DataFrame, k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, n_shingles, id (of the row's set; null without words); and a, b, the ids of every two different sets that link.

    All links, each once, of prefix filtering alone: of a dense group there are as many as its sets have pairs.
    """
    described = describe(documents, k, percent)
    links = verify(suffix_filter(described, prefix_pairs(_classes(described, "n", "prefix"), None, percent), percent), documents, k, percent)
    return described.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("id")).alias("id")), links


def one_of_each(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """One row of each component: that of the least doc_id (null after others), of its rows that of the least text hash, once.

    Rows are told apart by doc_id and text. Rows without words are near nothing and stay.
    """
    rows = with_key(documents)
    found = materialize(jaccard_components(rows.select(F.col("_row_key").alias("doc_id"), "text"), k, percent), "found").withColumnRenamed("doc_id", "_row_key")
    repeated = found.filter("n_shingles > 0").groupBy("_row_key").agg(F.count("*").alias("n")).filter("n > 1")
    return without(rows, found.filter("_row_key != component_id"), repeated, "_row_key").drop("_row_key")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 4 THEN concat(len(w), ' ', array_to_string(w, ' ')) ELSE array_to_string(w[i : i + 3], ' ') END AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), sets AS (
  SELECT r, n, min(r) OVER (PARTITION BY digest) AS c FROM (SELECT r, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM s GROUP BY r)
), one AS (
  SELECT s.r, s.g, sets.n FROM s JOIN sets ON sets.r = s.r AND sets.c = s.r
), links AS (
  SELECT a.r AS a, b.r AS b FROM one a JOIN one b ON a.g = b.g AND a.r <> b.r
  GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT r AS a, r AS b FROM sets WHERE c = r UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (
  SELECT reach.a AS c, min(d.doc_id) AS component_id FROM reach JOIN sets ON sets.c = reach.b JOIN d ON d.r = sets.r GROUP BY reach.a
)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN sets ON sets.r = d.r LEFT JOIN least ON least.c = sets.c
"""
