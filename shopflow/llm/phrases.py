"""Fingerprints of documents by the phrases of a Lempel-Ziv parse.

The UTF-8 bytes of a text are parsed from the left into phrases, each the
longest one known so far and one byte more. The set of phrases is hashed, by
content, into 128 bins; the least hash of each bin, cut to 16 bits, is the
fingerprint, 512 hex digits. The share of equal places of two fingerprints
estimates the Jaccard likeness of the two sets of phrases: texts that would compress
well together are alike. Bins that no phrase falls into copy another one's value,
each in an order of its own, so short texts compare alike too.

``fingerprints`` also takes each document's neighbour in descending order of
ids, and an edited text whose last third is replaced by the beginning of the neighbour.
Both texts have the first two thirds in common, which are parsed once.

Scale. Texts are shuffled once, into ranges of ids whose bounds come from a pass over ids and
hashes. The first row of a range goes to the range before it too, where it is the
neighbour of the last row; ranges are read as streams of one text after another. The bounds, one
for each range, are all that the driver sees. A dictionary starts anew after
``DICTIONARY`` phrases, as in compressors; its phrases stay in the fingerprint,
so memory has a bound besides the text itself.

Edge cases. Null is an empty text, which has no phrases and an empty fingerprint: it is like another empty text (1) and
unlike all else (0). Ids are whole numbers; null ids come last, equal ids are ordered by a hash of
the text, and rows that are equal follow each other. The last row's neighbour is the first row; a
single row is its own. Other columns are ignored.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import U, mix

BINS, DICTIONARY, STEP = 128, 1 << 20, 1 << 16
_NONE = np.uint64(2**64 - 1)
#: Where each bin looks for a value if it has none.
_LOOK = np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS) + U(BINS)), axis=1)


def _hashed(keys: dict, known: np.ndarray) -> np.ndarray:
    """Hashes of the root and all phrases: of those in ``known``, and of those that ``keys`` adds, by content.

    A key is the number of the phrase that it extends, and the byte. Whatever has the phrase before it hashed is next, so the work is at most the bytes read.
    """
    key = np.fromiter(keys, np.int64, len(keys))
    parent, byte, first = key >> 8, (key & 255).astype(np.uint64), len(known)
    out = np.concatenate([known, np.zeros(len(key), np.uint64)])
    done = np.zeros(len(out), bool)
    done[:first] = True
    todo = np.arange(len(key))
    while len(todo):
        ready = done[parent[todo]]
        now, todo = todo[ready], todo[~ready]
        out[first + now] = mix(out[parent[now]] * U(0x9E3779B97F4A7C15) + byte[now] + U(1))
        done[first + now] = True
    return out


_ROOT = np.ones(1, np.uint64)


def _least(hashes: np.ndarray, so_far: np.ndarray) -> np.ndarray:
    out = so_far.copy()
    np.minimum.at(out, (hashes >> U(57)).astype(np.int64), hashes & U((1 << 57) - 1))
    return out


class Parse:
    """A parse from the left. ``fork`` gives one that goes on from here and leaves this one as it is."""

    def __init__(self, known: dict | None = None, hashes: np.ndarray = _ROOT, least: np.ndarray | None = None, at: int = 0, offset: int = 0):
        self.known, self.new, self.hashes, self.at, self.offset = known or {}, {}, hashes, at, offset
        self.least = np.full(BINS, _NONE) if least is None else least

    def read(self, data: bytes) -> "Parse":
        start = 0
        while start < len(data):
            part = data[start : start + STEP - self.offset % STEP]
            if self.known:
                self._over(part)
            else:
                self._alone(part)
            start += len(part)
            self.offset += len(part)
            if self.offset % STEP == 0 and len(self.known) + len(self.new) >= DICTIONARY:
                self.least = self.lowest()
                self.known, self.new, self.hashes, self.at = {}, {}, _ROOT, 0
        return self

    def _alone(self, data: bytes) -> None:
        new, at = self.new, self.at
        get, k = new.get, len(new) + 1
        for byte in data:
            key = at << 8 | byte
            found = get(key)
            if found is None:
                new[key] = k
                k += 1
                at = 0
            else:
                at = found
        self.at = at

    def _over(self, data: bytes) -> None:
        known, new, at = self.known.get, self.new, self.at
        get, k = new.get, len(self.known) + len(new) + 1
        for byte in data:
            key = at << 8 | byte
            found = known(key)
            if found is None:
                found = get(key)
            if found is None:
                new[key] = k
                k += 1
                at = 0
            else:
                at = found
        self.at = at

    def lowest(self) -> np.ndarray:
        """The least hash of each bin so far."""
        return _least(_hashed(self.new, self.hashes)[len(self.hashes) :], self.least)

    def settle(self) -> "Parse":
        """Hashes what is known; ``fork`` needs that. Only for a parse that is no fork."""
        self.hashes = _hashed(self.new, self.hashes)
        self.least = _least(self.hashes[1:], self.least)
        self.known, self.new = self.new, {}
        return self

    def fork(self) -> "Parse":
        return Parse(self.known, self.hashes, self.least, self.at, self.offset)

    def print(self) -> np.ndarray | None:
        """The fingerprint as 16-bit numbers, None without phrases."""
        least = self.lowest()
        full = least != _NONE
        if not full.any():
            return None
        if not full.all():
            least = np.where(full, least, least[_LOOK[np.arange(BINS), full[_LOOK].argmax(axis=1)]])
        return (mix(least) & U(0xFFFF)).astype(np.uint16)


def shown(fingerprint: np.ndarray | None) -> str:
    return "" if fingerprint is None else fingerprint.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


class _Document:
    def __init__(self, text: str):
        self.text, self.cut = text, len(text) - len(text) // 3
        self.start = Parse().read(text[: self.cut].encode()).settle()
        self.print = self.start.fork().read(text[self.cut :].encode()).print()

    def edited(self, following: str) -> tuple[str, np.ndarray | None]:
        """The text with its last third replaced, and its fingerprint."""
        end = following[: len(self.text) - self.cut]
        if end == self.text[self.cut :]:
            return self.text, self.print
        return self.text[: self.cut] + end, self.start.fork().read(end.encode()).print()


_FIELDS = (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches):
    """Each row of an ordered range with the one after it; the last row of a range is its guest, and only that."""
    held, done = None, False
    for batch in batches:
        rows = []
        for doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest")), strict=True):
            if done:
                continue  # a guest that occurs more than once
            own = held[1] if held is not None and held[1].text == text else _Document(text)
            if held is not None:
                edited, print_ = held[1].edited(text)
                rows.append((held[0], len(held[1].text), hashlib.sha256(edited.encode()).hexdigest(), shown(held[1].print), shown(print_), likeness(held[1].print, print_), likeness(held[1].print, own.print)))
            held, done = (doc_id, own), guest
        if rows:
            kinds = (("doc_id", pa.int64()), *_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _sortable(nameless: np.ndarray, down: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys as bytes that sort like (nameless, down, h)."""
    out = np.empty((len(h), 17), np.uint8)
    out[:, 0] = nameless
    for at, x in ((1, down), (9, h)):
        out[:, at : at + 8] = (np.asarray(x, np.int64).view(np.uint64) ^ U(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def _keys(doc_id: Column, text: Column) -> dict[str, Column]:
    """Columns whose ascending order is descending ids, null last, and then a hash of the text."""
    return {"nameless": doc_id.isNull(), "down": F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("long")), "h": F.xxhash64(text)}


def in_ranges(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text, guest in ranges of descending ids, each in order in a partition of its own, and behind it as a guest the row that comes next.

    There are as many ranges as shuffle partitions, unless ``parts`` says how many.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumns(_keys(F.col("doc_id"), F.col("text")))
    names = ("nameless", "down", "h")
    # a number of ranges of their own: by the bytes of keys alone they would be few
    parts = parts or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.select(*names).repartitionByRange(parts, *names)
    firsts = sorted(tuple(r[0]) for r in ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*names)).alias("first")).select("first").collect())
    bounds = _sortable(*(np.array([f[i] for f in firsts], t) for i, t in enumerate((bool, np.int64, np.int64)))) if firsts else None

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def place(nameless: pd.Series, down: pd.Series, h: pd.Series) -> pd.Series:
        own = _sortable(nameless.to_numpy(bool), down.to_numpy(), h.to_numpy())
        at = np.searchsorted(bounds, own, "right") - 1
        first = bounds[at] == own
        return pd.Series([[a, (a - 1) % len(bounds)] if f else [a] for a, f in zip(at.tolist(), first.tolist(), strict=True)])

    dealt = keyed.select("*", F.posexplode(place(*names)).alias("copy", "range")).withColumn("guest", F.col("copy") == 1)
    return dealt.repartitionById(max(1, len(firsts)), F.col("range")).sortWithinPartitions("range", "guest", *names).select("doc_id", "text", "guest")


def fingerprints(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    return in_ranges(documents, parts).mapInArrow(_compared, _OUT)
