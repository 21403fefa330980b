"""Vectorised work on the UTF-8 bytes of a column of texts.

Texts are taken from Arrow batches without a copy and handled in chunks of
about ``CHUNK`` bytes, so memory per task is bounded by the chunk or by the
longest single text.
"""

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_ODD_INV = pow(_ODD, -1, 1 << 64)
U = np.uint64

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after folding A-Z: 0-9, a-z and every byte beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NONSPACE = np.ones(256, bool)
NONSPACE[9:14] = NONSPACE[32] = False

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            self.up, self.down = _powers(n, _ODD), _powers(n, _ODD_INV)
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string()) if pa.types.is_null(column.type) else column
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(buf: np.ndarray, offs: np.ndarray, size: int = CHUNK):
    """(first row, row after the last, bytes, offsets) of runs of whole rows of about ``size`` bytes."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        yield row, end, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class Words:
    """Words of a chunk: byte ``start`` and ``end``, 64-bit ``hash``, and ``of``: the word offset of each row."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray, hashed: bool = True):
        self.folded = FOLD[buf]
        inside = is_word[self.folded]
        first, last = inside.copy(), inside.copy()
        if len(buf):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = offs[:-1][offs[:-1] < offs[1:]]
            first[edge] = inside[edge]
            edge = offs[1:][offs[:-1] < offs[1:]] - 1
            last[edge] = inside[edge]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offs)
        if hashed:
            up, down = _POWERS.upto(len(buf) + 1)
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_TABLE[self.folded] * up[: len(buf)], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def text(self, i: int) -> str:
        return self.folded[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (rows are not told apart here)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= U(_ODD)
        out += words[j : j + n]
    return mix(out)


def inside_rows(of: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n gram positions hold k words of one row; ``of``: word offset of each row."""
    ok = np.zeros(max(n, 0) + 1, np.int32)
    a, b = of[:-1], of[1:] - k + 1
    keep = b > a
    np.add.at(ok, a[keep], 1)
    np.add.at(ok, b[keep], -1)
    return np.cumsum(ok)[:-1].astype(bool)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - size :]) if size < w else out
