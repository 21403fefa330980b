"""Removal of repeated byte strings by a distributed, sparse suffix sort.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else in the corpus, judged on the input.

Method. Sorting every suffix would move many times the corpus. Only anchors are
sorted: the minima of a hash of ``lead`` bytes in each window of ``length``
bytes. Any two equal strings of ``length`` bytes hold an anchor at the same
place, so it suffices to look at suffixes that begin at anchors, with the bytes
before them.

1. Anchors are range-partitioned by the hash of their leading bytes with sampled
   splitters, sorted, and compared with their neighbours, across partition
   boundaries too; those whose lead occurs once are dropped.
2. The others get their context, ``length`` bytes on and ``length - lead`` back.
   Suffixes are range-partitioned by their leading bytes with sampled splitters,
   so that no lead is cut by a boundary. Suffixes of a lead are sorted by multikey
   quicksort, and so are the bytes before them, backwards; neighbours in both
   orders are compared byte by byte, which gives the longest covered span around
   each anchor.
3. Leads with over ``hot`` anchors don't fit one place: each string around their
   anchors is hashed, once per place, and the hashes are sorted in ranges and
   compared with their neighbours as in step 1, with the same result.
4. Spans are united per text, and texts are cut.

Texts with copies are covered as a whole, if they have ``length`` bytes, and one
copy takes part in the rest. Texts, and strings at hot leads, are compared by
64-bit hashes; all other strings byte by byte.

Scale. What is shuffled is a hash per anchor (about 1 % of the bytes), and the
context of anchors whose lead repeats. Texts are shuffled only where an anchor of
theirs repeats, by a bitmap of bounded size. No key gathers an unbounded group.

Edge cases. Null text is empty; texts under ``length`` bytes keep all. Runs of one
byte have an anchor at every byte; equal contexts of a text are compared once.
Repeated rows each give a row; other columns are ignored.
"""

import hashlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bitmap, is_set, materialize, merged_runs
from .textbytes import _POWERS, _TABLE, U, chunks, mix, sliding_min, utf8

LENGTH, LEAD, HOT = 200, 48, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors_of(buf: np.ndarray, offs: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, hash of the lead) of the anchors of a chunk."""
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _POWERS.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=total[1:])
    n = len(buf) - lead + 1
    h = mix((total[lead:] - total[:n]) * down[:n])
    w = length - lead + 1
    low = sliding_min(h, w)
    whole = np.zeros(len(low) + 1, np.int32)
    a, z = offs[:-1], offs[1:] - length + 1
    np.add.at(whole, a[z > a], 1)
    np.add.at(whole, z[z > a], -1)
    low = np.where(np.cumsum(whole)[:-1] > 0, low, U(0))
    top = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(~sliding_min(~top, w) == h)
    row = np.searchsorted(offs, at, "right") - 1
    return row, at - offs[row], h[at].view(np.int64)


def _anchors(batches, length: int, lead: int):
    done: set[int] = set()
    for batch in batches:
        ids = batch.column(0).to_numpy()
        new = np.array([i not in done and not done.add(i) for i in ids.tolist()], bool)
        batch, ids = batch.filter(pa.array(new)), ids[new]
        buf, offs = utf8(batch.column(1))
        for first, _, b, o in chunks(buf, offs):
            row, at, h = anchors_of(b, o, length, lead)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[first + row]), pa.array(at.astype(np.int32))], ["lead", "id", "at"])


def _repeated(batches):
    """Of sorted anchors (lead, id, at): state 2, the lead repeats here; 1, it may go on in a neighbouring partition; 0, a marker of an edge."""
    part, held, first, last, any_ = TaskContext.get().partitionId(), None, None, None, False

    def emit(lead, ids, at, twice, open_):
        keep = twice | open_
        return pa.RecordBatch.from_arrays([pa.array(lead[keep]), pa.array(ids[keep]), pa.array(at[keep]), pa.array(np.where(twice[keep], 2, 1).astype(np.int32))], ["lead", "id", "at", "state"])

    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(3)]
        if not len(cols[0]):
            continue
        before = np.zeros(len(cols[0]), bool)
        if held is not None:  # the last anchor so far, and whether it has a neighbour of its lead
            cols = [np.concatenate([h, c]) for h, c in zip(held[0], cols, strict=True)]
            before = np.concatenate([held[1], before])
        lead, ids, at = cols
        new = np.ones(len(lead), bool)
        new[1:] = (lead[1:] != lead[:-1]) | (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])
        lead, ids, at, before = lead[new], ids[new], at[new], before[new]
        same = lead[1:] == lead[:-1]
        before[1:] |= same
        before[:-1] |= same
        first = lead[0] if first is None else first
        last, any_ = lead[-1], True
        held = [x[-1:] for x in (lead, ids, at)], before[-1:]
        yield emit(lead[:-1], ids[:-1], at[:-1], before[:-1], lead[:-1] == first)
    if any_:
        (lead, ids, at), before = held
        yield emit(lead, ids, at, before, np.ones(1, bool))
        edge = np.unique(np.array([first, last], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(edge), pa.array(np.full(len(edge), part, np.int64)), pa.array(np.zeros(len(edge), np.int32)), pa.array(np.zeros(len(edge), np.int32))], ["lead", "id", "at", "state"])


def repeated_places(found: DataFrame) -> DataFrame:
    """lead, id, at of the places (lead, id, at) whose lead is at another place too: sorted ranges, neighbours compared, across boundaries too.

    Ranges go by all three columns, so that a lead with any number of places is cut into many ranges.
    """
    ranged = found.repartitionByRange("lead", "id", "at").sortWithinPartitions("lead", "id", "at")
    seen = materialize(ranged.mapInArrow(_repeated, "lead long, id long, at int, state int"), "repeated")
    across = seen.filter("state = 0").groupBy("lead").agg(F.count_distinct("id").alias("parts")).filter("parts > 1").select("lead")
    inside = seen.filter("state = 2").select("lead", "id", "at")
    return inside.unionByName(seen.filter("state = 1").join(across, "lead").select("lead", "id", "at"))


def repeated_anchors(texts: DataFrame, length: int, lead: int) -> DataFrame:
    """lead, id, at of the anchors whose lead occurs at another place."""
    return repeated_places(materialize(texts.mapInArrow(partial(_anchors, length=length, lead=lead), "lead long, id long, at int"), "anchors"))


def _pick(batches, wanted):
    """Each wanted text once per task."""
    bits, done = np.frombuffer(wanted.value, np.uint8), set()
    for batch in batches:
        ids = batch.column(0).to_numpy()
        want = is_set(bits, ids)
        for i in np.flatnonzero(want).tolist():
            key = int(ids[i])
            want[i] = key not in done
            done.add(key)
        yield batch.filter(pa.array(want))


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (one per id) joined with their texts; a bitmap of bounded size keeps most other texts from being shuffled."""
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap(rows))
    return texts.mapInArrow(partial(_pick, wanted=wanted), "id long, text string").dropDuplicates(["id"]).join(rows, "id")


_CONTEXT = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("at", pa.int32()), ("before", pa.binary()), ("suffix", pa.binary()), ("print", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _rows(kind: int, n: int, **columns):
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _CONTEXT], schema=_CONTEXT)


def _strings(key: int, raw: bytes, hot: array, length: int, back: int):
    """Hash and place of every string around the hot anchors of a text, each place once."""
    buf = np.frombuffer(raw, np.uint8)
    at, last = np.array(hot, np.int64), len(buf) - length
    edge = np.zeros(last + 2, np.int32)
    first, end = np.maximum(at - back, 0), np.minimum(at, last) + 1
    np.add.at(edge, first[first < end], 1)
    np.add.at(edge, end[first < end], -1)
    start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    up, down = _POWERS.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=total[1:])
    for i in range(0, len(start), 1 << 17):
        s = start[i : i + (1 << 17)]
        h = mix((total[s + length] - total[s]) * down[s])
        yield _rows(1, len(s), id=np.full(len(s), key, np.int64), print=h.view(np.int64), start=s.astype(np.int32), end=(s + length).astype(np.int32))


def _contexts(batches, length: int, lead: int):
    """kind 0: an anchor's context; 1: the hash of a string at a hot anchor; 2: a span that the text alone shows to repeat."""
    back = length - lead

    def near_rows(rows):
        return _rows(0, len(rows), **dict(zip(("id", "at", "before", "suffix"), zip(*rows, strict=True), strict=True)))

    for batch in batches:
        near, size = [], 0
        for key, text, anchors in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("anchors").to_pylist(), strict=True):
            raw, seen, again, hot = text.as_py().encode(), {}, array("i"), array("i")
            for is_hot, at in ((x["hot"], at) for x in anchors for at in range(x["first"], x["first"] + x["n"])):
                before, suffix = raw[max(0, at - back) : at], raw[at : at + length]
                if len(before) == back and len(suffix) == length:
                    one = seen.setdefault((before, suffix), at)
                    if one != at:  # the same context again: all its strings repeat
                        again.append(one)
                        again.append(at)
                        continue
                if is_hot:
                    hot.append(at)
                else:
                    near.append((key, at, before, suffix))
                    size += len(before) + len(suffix)
                    if size > 1 << 22:
                        yield near_rows(near)
                        near, size = [], 0
            if hot:
                yield from _strings(key, raw, hot, length, back)
            if again:
                at = np.unique(np.frombuffer(again, np.int32))
                apart = np.flatnonzero(at[1:] - at[:-1] > length + back)
                first, last = at[np.r_[0, apart + 1]], at[np.r_[apart, len(at) - 1]]
                yield _rows(2, len(first), id=np.full(len(first), key, np.int64), start=first - back, end=last + length)
        if near:
            yield near_rows(near)


def _fixed(column, width: int, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column as rows of ``width`` bytes, aligned left or right, and their lengths."""
    n = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    out = np.zeros((len(n), width), np.uint8)
    at = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n) + (np.repeat(width - n, n) if right else 0)
    out[np.repeat(np.arange(len(n)), n), at] = data
    return out, n


def multikey_order(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of rows of bytes by (group, bytes); groups are numbered in ascending order.

    Multikey quicksort, breadth first, with eight bytes as a key: runs of rows that are tied so far are partitioned by
    their next key, and only parts of equal keys go on to the key after it.
    """
    n, width = rows.shape
    keys = np.zeros((n, -(-width // 8) * 8), np.uint8)
    keys[:, :width] = rows
    keys = keys.view(">u8")
    order = np.arange(n)
    new = np.r_[True, group[1:] != group[:-1]]  # where a run of ties begins
    for k in range(keys.shape[1]):
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(tied):
            break
        run, key = np.cumsum(new)[tied], keys[order[tied], k].astype(np.uint64)
        by = np.lexsort((key, run))
        order[tied], key = order[tied][by], key[by]
        new[tied[1:]] |= key[1:] != key[:-1]
    return order


def _shared(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the row before it; -1 for the first of a group."""
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.r_[-1, np.where(group[1:] == group[:-1], n, -1)]


def _classes(rows: np.ndarray, group: np.ndarray, need: np.ndarray) -> np.ndarray:
    """[i, row]: a number that rows of a group share if their first need[i] bytes are equal."""
    order = multikey_order(rows, group)
    out = np.empty((len(need), len(rows)), np.int64)
    out[:, order] = np.cumsum(_shared(rows[order], group[order])[None, :] < need[:, None], axis=1)
    return out


def spans_of_groups(reversed_before: np.ndarray, n_before: np.ndarray, suffix: np.ndarray, n_suffix: np.ndarray, group: np.ndarray, length: int, lead: int):
    """Whether a string around an anchor is around another one of its group too, and the most and fewest bytes before the anchor of such strings.

    Suffixes and reversed preceding bytes are sorted, and neighbours compared byte by byte. A string with o bytes before
    the anchor repeats if another context has the same last o bytes before and the same first ``length`` - o from there on.
    """
    n, before = len(group), np.arange(length - lead + 1)
    valid = (before[:, None] <= n_before) & (length - before[:, None] <= n_suffix)
    key = _classes(suffix, group, length - before) * (n + 1) + _classes(reversed_before, group, before)
    key = np.where(valid, key, -1 - np.arange(n))
    order = np.argsort(key, axis=1)
    ranked = np.take_along_axis(key, order, axis=1)
    twin = np.zeros(key.shape, bool)
    twin[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
    twin[:, :-1] |= twin[:, 1:].copy()
    hit = np.zeros(key.shape, bool)
    np.put_along_axis(hit, order, twin, axis=1)
    return hit.any(axis=0), length - lead - hit[::-1].argmax(axis=0), hit.argmax(axis=0)


def _compare(batches, length: int, lead: int):
    """Spans of contexts ordered by their lead; groups share it and may go on in the next batch."""
    back, held = length - lead, None
    step = 2048

    def spans(table):
        if not len(table):
            return
        suffix, n_suffix = _fixed(table["suffix"], length, False)
        before, n_before = _fixed(table["before"], back, True)
        key = np.ascontiguousarray(suffix[:, :lead]).view(f"V{lead}").ravel()
        group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        ids, at = table["id"].to_numpy(), table["at"].to_numpy()
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        a = 0
        while a < len(group):  # whole groups, about ``step`` contexts at a time
            later = first[first >= min(a + step, len(group))]
            z = int(later[0]) if len(later) else len(group)
            found, most, least = spans_of_groups(before[a:z, ::-1], n_before[a:z], suffix[a:z], n_suffix[a:z], group[a:z], length, lead)
            place = at[a:z][found].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:z][found]), pa.array((place - most[found]).astype(np.int32)), pa.array((place - least[found] + length).astype(np.int32))], ["id", "start", "end"])
            a = z

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        leads = pc.binary_slice(table["suffix"].combine_chunks(), 0, lead).to_pylist()
        cut = len(leads)
        while cut and leads[cut - 1] == leads[-1]:
            cut -= 1
        yield from spans(table.slice(0, cut).combine_chunks())
        held = table.slice(cut)
    if held is not None:
        yield from spans(held.combine_chunks())


def _cut(batches):
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            t, end, removed, runs, kept = text.as_py().encode(), 0, 0, 0, []
            stop = -1
            for a, z in sorted((s["start"], s["end"]) for s in spans):
                if a > stop:
                    runs += 1
                    kept.append(t[max(end, 0) : a])
                    removed += z - a
                elif z > stop:
                    removed += z - stop
                stop = max(stop, z)
                end = stop
            kept.append(t[end:])
            rows.append((removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["id", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(texts: DataFrame, length: int = LENGTH, lead: int = LEAD, hot: int = HOT) -> DataFrame:
    """id, start, end: spans of bytes of the texts (id, text) that are covered by repeated strings; they may overlap."""
    anchors = materialize(repeated_anchors(texts, length, lead), "dense")
    busy = anchors.groupBy("lead").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("lead", F.lit(True).alias("hot"))
    busy = materialize(busy, "hot-leads")  # so that Spark knows its size, and can split the join's hot leads if it does not broadcast it
    marked = anchors.join(busy, "lead", "left").select("id", "at", F.coalesce("hot", F.lit(False)).alias("hot"))
    # anchors side by side are one run: a text of one byte has an anchor at every place
    place = F.row_number().over(Window.partitionBy("id", "hot").orderBy("at"))
    runs = marked.withColumn("run", F.col("at") - place).groupBy("id", "hot", "run").agg(F.min("at").alias("first"), F.count("*").cast("int").alias("n"))
    by_text = materialize(runs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "n", "hot"))).alias("anchors")), "anchors-by-text")
    schema = "kind int, id long, at int, before binary, suffix binary, print long, start int, end int"
    found = materialize(with_texts(by_text, texts).select("id", "text", "anchors").mapInArrow(partial(_contexts, length=length, lead=lead), schema), "contexts", compression="zstd")
    contexts = found.filter("kind = 0").select("id", "at", "before", "suffix")
    ranged = contexts.repartitionByRange(F.substring("suffix", 1, lead)).sortWithinPartitions(F.substring("suffix", 1, lead))
    spans = ranged.mapInArrow(partial(_compare, length=length, lead=lead), "id long, start int, end int")
    strings = repeated_places(found.filter("kind = 1").select(F.col("print").alias("lead"), "id", F.col("start").alias("at")))
    hot_spans = strings.select("id", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return spans.unionByName(hot_spans).unionByName(found.filter("kind = 2").select("id", "start", "end"))


def remove_repeated(documents: DataFrame, length: int = LENGTH, lead: int = LEAD, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).withColumn("id", F.xxhash64("text"))
    texts = rows.filter(F.octet_length("text") >= length).select("id", "text")
    about = materialize(rows.select("doc_id", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")), "about")
    copies = about.filter(F.col("n_bytes") >= length).groupBy("id").agg(F.count("*").alias("copies")).filter("copies > 1")
    runs = merged_runs(repeated_spans(texts, length, lead, hot).join(copies, "id", "left_anti"), "id").groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = materialize(runs.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    cut = materialize(with_texts(spans, texts).select("id", "text", "spans").mapInArrow(_cut, "id long, n_removed long, n_spans long, kept_sha256 string"), "cut")
    out = about.join(copies, "id", "left").join(cut, "id", "left")
    whole = F.col("copies").isNotNull()
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, EMPTY).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT r, 1024 * k + j AS i, md5(substr(cell, CAST(2 * j + 1 AS BIGINT), 400)) AS g
  FROM (SELECT r, k, cell, unnest(range(0, len(cell) // 2 - 199)) AS j
        FROM (SELECT r, k, substr(h, CAST(2048 * k + 1 AS BIGINT), 2446) AS cell FROM (SELECT r, h, unnest(range(0, (len(h) // 2 - 200) // 1024 + 1)) AS k FROM d WHERE len(h) >= 400)))
), hit AS (
  SELECT r, i, i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 AS apart FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING count(*) > 1)
), runs AS (
  SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT r, i, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM hit) GROUP BY r, run
), cut AS (
  SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs
), kept AS (
  SELECT cut.r, sum(z - a) AS n_removed, count(*) AS n_spans, concat(string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a), substr(any_value(h), CAST(2 * max(z) + 1 AS BIGINT))) AS h
  FROM cut JOIN d ON d.r = cut.r GROUP BY cut.r
)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
