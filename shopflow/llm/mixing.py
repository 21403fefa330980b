"""Mixing sources to target weights.

Method. The words of each source, its documents in a fixed pseudorandom order,
are packed end to end into blocks of ``block`` words. A source's share of the
mix is a number of slots, and its j-th slot takes the block that a pseudorandom
permutation of the source's block indices names, a new permutation for each
pass over the source; the last slot takes part of a block, so that a source
gives its target to the word. Output shards of ``shard_slots`` slots draw how
many of their slots each source fills. Blocks meet their slots by index: the
inverse of a permutation names the slots of a block where the block is, so the
join moves nothing. Texts are cut into the pieces that the blocks of slots
hold, and pieces are put together in their slots and written as shards: the
words of each slot in order, by piece.

A plain multinomial draw per shard would miss a small source's target by many
per cent, so the draw is the multinomial one conditioned on every source's
total: slots are dealt to shards by one pseudorandom permutation of all slot
numbers, which gives each shard multivariate hypergeometric counts. Every draw
is a function of the seed and of indices, so reruns and retried tasks agree.

Scale. Texts are shuffled twice: as rows to the part of their source's order
that holds them, and as compressed bundles of pieces to their shards; a shard
is ``shard_slots`` blocks at most. A part is a range of hashes of about
``PART_WORDS`` words, whatever the size of a source, and is read as a stream
behind a row that says where it begins, so neither a hot source nor many rows
of one document gather in memory. Prefix sums run over runs of parts, inside runs, and over sources.

Edge cases. Null or empty text has size 0 and is never taken. Rows with one
doc_id in one source count as one document. Null is a source of its own,
ordered last; a null doc_id is a document. With no words at all every target is
0. Columns other than doc_id, source and text are ignored.
"""

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .textbytes import NONSPACE, U, Words, chunks, mix, utf8

BLOCK, SHARD_SLOTS, SEED, WEIGHTS, MOST_PASSES, PART_WORDS = 64, 4096, 17, (5, 2, 1), 3, 1 << 18
#: Bytes of pieces that a task holds before it sends bundles on.
HELD_BYTES = 24 << 20
#: Parts of a source whose words are summed up together, as a power of two.
RUN_BITS = 12
WORD = "[^\\x20\\x09-\\x0D]+"


def _halves(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    return half, (U(1) << half) - U(1)


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4, inverse: bool = False) -> np.ndarray:
    """Position of each index in a pseudorandom permutation of range(n) chosen by key, or with ``inverse`` the index at each
    position: a Feistel network, walked until it falls inside."""
    half, mask = _halves(n)
    out, size = index.astype(np.uint64), n.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(rounds, 0, -1) if inverse else range(1, rounds + 1):
            turn = lambda v: mix(v ^ mix(k + U(r))) & m  # noqa: B023, E731
            left, right = (right ^ turn(left), left) if inverse else (right, left ^ turn(right))
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _key(rank, of_pass, seed: int) -> np.ndarray:
    """The key of a source's permutation in a pass."""
    rank, of_pass = np.broadcast_arrays(np.asarray(rank), np.asarray(of_pass))
    return mix(rank.astype(np.uint64) * U(1 << 20) + of_pass.astype(np.uint64) + mix(np.full(rank.shape, seed, np.uint64)))


def document_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, place of each row: its words, and its place in the order of its source."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    return documents.select("doc_id", "source", size.alias("size"), _place().alias("place"))


def _place() -> Column:
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, rank, source_size, target. One row per source.

    Filling up to the caps has a closed form: in order of cap per weight, a source is capped while its cap is at
    most what it would get of what the capped ones before it leave.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    sources = sources.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    rest = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(Window.partitionBy()), F.lit(0.0))
    share = rest * F.col("w") / F.sum(F.when(~F.col("capped"), F.col("w"))).over(Window.partitionBy())
    return sources.select("source", "rank", F.col("source_size").cast("long").alias("source_size"), F.when(F.col("capped"), F.col("cap")).otherwise(share).alias("target"))


def _planned(batches, block: int, seed: int):
    """Of each source how it is passed over: whole passes, then the first ``last`` slots of one that gives ``rest`` words."""
    for t in batches:
        size, want = t["source_size"].to_numpy(), np.floor(t["target"].to_numpy() + 0.5).astype(np.int64)
        blocks, whole = -(-size // block), want // size
        rest, short = want - whole * size, -size % block
        # where in the last pass the source's short block comes
        at = permuted(blocks - 1, blocks, _key(t["rank"].to_numpy(), whole, seed), inverse=True)
        last = -(-rest // block)
        last = np.where(last <= at, last, -(-(rest + short) // block))
        yield t.assign(blocks=blocks, whole=whole, rest=rest, short_at=at, last=last, slots=whole * blocks + last)


_SOURCE = "source string, rank long, source_size long, target double, blocks long, whole long, rest long, short_at long, last long, slots long"


def slot_plan(targets: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The sources that the mix takes words of, with the number of their slots, those of the sources before, and of all."""
    used = targets.filter("target >= 0.5").select("source", "rank", "source_size", "target")
    used = used.mapInPandas(partial(_planned, block=block, seed=seed), _SOURCE)
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return used.withColumn("slots_before", F.coalesce(F.sum("slots").over(before), F.lit(0)).cast("long")).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()).cast("long"))


_PLAN = ("rank", "source_size", "blocks", "whole", "rest", "short_at", "last", "slots_before", "all_slots")


def slots_of(block: np.ndarray, plan: dict[str, np.ndarray], size: int, seed: int) -> tuple[np.ndarray, ...]:
    """(entry, number among all slots, words) of the slots that take each block of its source: ``plan`` has a value for each block."""
    out = []
    for turn in range(int(plan["whole"].max(initial=-1)) + 2):
        of = np.flatnonzero((turn < plan["whole"]) | ((turn == plan["whole"]) & (plan["last"] > 0)))
        p = {k: v[of] for k, v in plan.items()}
        j = permuted(block[of], p["blocks"], _key(p["rank"], np.full(len(of), turn), seed), inverse=True)
        words = np.minimum((block[of] + 1) * size, p["source_size"]) - block[of] * size
        # the slots before this one of the last pass hold whole blocks, but for the short one
        before = j * size - np.where(j > p["short_at"], -p["source_size"] % size, 0)
        words = np.where(turn < p["whole"], words, np.clip(p["rest"] - before, 0, words))
        good = words > 0
        out.append((of[good], (p["slots_before"] + turn * p["blocks"] + j)[good], words[good]))
    return tuple(np.concatenate([x[i] for x in out] or [np.zeros(0, np.int64)]) for i in range(3))


_BUNDLE = "shard long, place array<int>, rank array<long>, block array<long>, at array<int>, doc_id array<{kind}>, first_word array<long>, size array<int>, texts binary"


class _Bundles:
    """Pieces held by shard, sent on as one row each."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.held, self.bytes = kind, {}, 0

    def add(self, shard: int, piece: tuple, text: bytes) -> None:
        own = self.held.setdefault(shard, ([], []))
        own[0].append(piece)
        own[1].append(text)
        self.bytes += len(text) + 100

    def send(self):
        zstd = pa.Codec("zstd", 3)
        held, self.held, self.bytes = sorted(self.held.items()), {}, 0
        for i in range(0, len(held), 256):
            part = held[i : i + 256]
            columns = list(zip(*([list(c) for c in zip(*pieces, strict=True)] for _, (pieces, _) in part), strict=True))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), self.kind, pa.int64())
            arrays = [pa.array([s for s, _ in part], pa.int64()), *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds, strict=True))]
            arrays += [pa.array([[len(t) for t in texts] for _, (_, texts) in part], pa.list_(pa.int32()))]
            arrays += [pa.array([zstd.compress(b"".join(texts), asbytes=True) for _, (_, texts) in part], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["shard", "place", "rank", "block", "at", "doc_id", "first_word", "size", "texts"])


def _cut(batches, block: int, shard_slots: int, seed: int):
    """Bundles of pieces of ordered rows; a row with a plan says of which source, and from which word of it on, the rows after it are."""
    held, plan, start = None, None, 0
    for batch in batches:
        held = held or _Bundles(batch.schema.field("doc_id").type)
        plans, ids = batch.column("plan").to_pylist(), batch.column("doc_id")
        buf, offs = utf8(batch.column("text"))
        for i, j, b, o in chunks(buf, offs):
            words = Words(b, o, NONSPACE, hashed=False)
            n, rows = np.diff(words.of), []
            for r in range(j - i):
                if plans[i + r] is not None:
                    plan = plans[i + r]
                    start = plan["base"]
                elif n[r] and plan is not None:
                    rows.append((r, start, *(plan[c] for c in _PLAN)))
                    start += int(n[r])
            if not rows:
                continue
            table = np.array(rows, np.int64)
            row, begin, size = table[:, 0], table[:, 1], n[table[:, 0]]
            first = begin // block
            many = (begin + size - 1) // block - first + 1
            of = np.repeat(np.arange(len(row)), many)
            blocks = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[of]
            entry, slot, wanted = slots_of(blocks, {c: table[of, 2 + k] for k, c in enumerate(_PLAN)}, block, seed)
            of, blocks = of[entry], blocks[entry]
            from_, to = np.maximum(begin[of], blocks * block), np.minimum(begin[of] + size[of], blocks * block + wanted)
            good = to > from_
            of, blocks, slot, from_, to = of[good], blocks[good], slot[good], from_[good], to[good]
            place = permuted(slot, table[of, 2 + _PLAN.index("all_slots")], mix(np.full(len(of), seed + 1, np.uint64)))
            a = words.of[row[of]] + from_ - begin[of]
            raw, whole = b.tobytes(), ids[i:j].to_pylist()
            for r, s, k, rank, x, at, w, p, q in zip(row[of].tolist(), (place // shard_slots).tolist(), (place % shard_slots).tolist(), table[of, 2].tolist(), blocks.tolist(), (from_ - blocks * block).tolist(), (from_ - begin[of]).tolist(), words.start[a].tolist(), words.end[a + to - from_ - 1].tolist(), strict=True):
                held.add(s, (k, rank, x, at, whole[r], w), b" ".join(raw[p:q].split()))
            if held.bytes > HELD_BYTES:
                yield from held.send()
    if held is not None:
        yield from held.send()


def _assembled(bundles: pa.Table) -> pa.Table:
    """One shard's slots in order, each with its pieces in order."""
    bundles = bundles.combine_chunks()
    flat = lambda c: pc_flat(bundles.column(c))
    place, at, sizes = flat("place"), flat("at"), flat("size")
    total = [sum(x) for x in bundles.column("size").to_pylist()]
    zstd = pa.Codec("zstd")
    data = b"".join(zstd.decompress(t, n, asbytes=True) for t, n in zip(bundles.column("texts").to_pylist(), total, strict=True))
    texts = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes.to_numpy())]).astype(np.int32)), pa.py_buffer(data))
    order = np.lexsort((at.to_numpy(), place.to_numpy()))
    take = pa.array(order)
    words = np.array([t.count(b" ") + 1 for t in texts.cast(pa.binary()).take(take).to_pylist()], np.int64)
    pieces = pa.StructArray.from_arrays([at.take(take), flat("doc_id").take(take), flat("first_word").take(take), pa.array(words), texts.take(take)], ["at", "doc_id", "first_word", "words", "text"])
    ordered = place.to_numpy()[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    one = pa.array(order[first])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ordered)), pa.int32()), pieces)
    shard = pa.array(np.full(len(first), bundles.column("shard")[0].as_py(), np.int64))
    return pa.table([shard, pa.array(ordered[first].astype(np.int64)), flat("rank").take(one), flat("block").take(one), lists], ["shard", "place", "rank", "block", "pieces"])


def pc_flat(column: pa.ChunkedArray) -> pa.Array:
    parts = [c.flatten() for c in column.chunks]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def words_before(parts: DataFrame, bits: int = RUN_BITS) -> DataFrame:
    """source, part, base: the words of the parts of a source before each one, from rows (source, part, n).

    Sums run over runs of ``2 ** bits`` parts and then inside each run, so no source is one window of all its parts.
    """
    run = F.shiftright("part", bits).alias("run")
    ahead = lambda by, *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    runs = parts.groupBy("source", run).agg(F.sum("n").alias("n")).select(F.col("source").alias("_of"), F.col("run").alias("_run"), ahead("run", "source").alias("_start"))
    inside = parts.withColumn("run", run).select("source", "part", "run", ahead("part", "source", "run").alias("_inside"))
    both = inside.join(runs, F.col("source").eqNullSafe(F.col("_of")) & (F.col("run") == F.col("_run")))
    return both.select("source", "part", (F.col("_start") + F.col("_inside")).alias("base"))


def mix_sources(documents: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_PASSES, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, part_words: int = PART_WORDS) -> tuple[DataFrame, DataFrame]:
    """(mix, documents): the stored mix as rows of shard, place, rank, block, pieces; and doc_id, source, size, source_size, target, rank."""
    documents = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sizes = materialize(document_sizes(documents), "sizes")
    targets = materialize(source_targets(sizes, weights, most), "targets")
    of = targets.withColumnRenamed("source", "of")
    by_doc = sizes.groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    ranked = by_doc.join(of, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", "rank")
    # parts are ranges of places, of about part_words words over all sources
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    bits = max(1, (words // part_words).bit_length())
    part = F.shiftrightunsigned("place", 64 - bits)
    parts = words_before(sizes.groupBy("source", part.alias("part")).agg(F.sum("size").alias("n")))
    planned = slot_plan(targets, block, seed).withColumnRenamed("source", "of")
    plan = F.struct("base", *_PLAN).alias("plan")
    heads = parts.join(planned, F.col("source").eqNullSafe(F.col("of"))).select("source", "part", F.lit(None).cast("long").alias("place"), F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("string").alias("text"), plan)
    rows = documents.filter("text IS NOT NULL").withColumn("place", _place()).select("source", part.alias("part"), "place", "doc_id", "text", F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"))
    # a plan has no place and comes before the rows of its part
    ordered = heads.unionByName(rows).repartition("source", "part").sortWithinPartitions("source", "part", F.col("place").asc_nulls_first(), "doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    bundles = ordered.select("doc_id", "text", "plan").mapInArrow(partial(_cut, block=block, shard_slots=shard_slots, seed=seed), _BUNDLE.format(kind=kind))
    piece = f"struct<at: int, doc_id: {kind}, first_word: long, words: long, text: string>"
    mixed = bundles.groupBy("shard").applyInArrow(_assembled, f"shard long, place long, rank long, block long, pieces array<{piece}>")
    return materialize(mixed, "shards", compression="zstd"), ranked


def taken(mixed: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per document the words that the stored mix holds, repeats counted."""
    stored = mixed.select("rank", F.explode("pieces").alias("x")).select("rank", "x.doc_id", "x.text")
    used: Column = F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")).alias("taken")
    by_doc = stored.groupBy("rank", "doc_id").agg(used).withColumnsRenamed({"rank": "r", "doc_id": "d"})
    out = ranked.join(by_doc, (F.col("rank") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
