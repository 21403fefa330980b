"""FLAC media columns: lossless 8-bit mono streams, coded and decoded in batches of frames.

Encoding cuts a payload into blocks of 576 samples (byte - 128). Each block
takes the fixed linear predictor of order 0 to 4 with the least residual, and
Rice codes it, with one parameter or one for each eighth; only blocks that would
grow are stored verbatim, and equal samples as a constant. The stream has its MD5 in STREAMINFO and a seek point for every frame.

Decoding reads the seek table and works on all frames at once, one sample of
each per step: Rice codes with partitions and escapes, fixed and LPC
predictors, constant and verbatim blocks. Header CRC-8, frame CRC-16 and the MD5
are verified; damage raises ValueError. ``read_flac`` gives the PCM as blocks
with their sample offsets, ``read_samples`` seeks into a stream.

``stored_features`` writes the streams as a table, reads the table back and
computes features from the decoded blocks.

Scale. Maps over rows without any shuffle. At most ``FRAMES`` frames are worked
on at once, so memory does not follow the length of a text beyond the text itself.

Edge cases. Null and empty payloads become one block of padding (bytes 255).
Repeated rows each give a row with equal values. Other columns are ignored.
"""

import hashlib
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textbytes import chunks, utf8

BLOCK, RATE, FRAMES = 576, 8000, 4096
#: Partition orders that a frame is tried with: one Rice parameter for all of it, or one for each eighth.
PARTITIONS = (0, 3)


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


class _Crc:
    """CRCs of many runs of bytes at once: a CRC is the XOR of what each byte adds at its distance from the end."""

    def __init__(self, poly: int, bits: int):
        self.first, self.bits = _table(poly, bits), bits
        self.far = self.first[None, :].astype(np.uint16)

    def of(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        while len(self.far) < length.max(initial=1):
            t = self.far[-1].astype(np.int64)
            self.far = np.vstack([self.far, ((t << 8 & ((1 << self.bits) - 1)) ^ self.first[t >> (self.bits - 8)]).astype(np.uint16)[None]])
        ends = np.cumsum(length)
        distance = np.repeat(ends, length) - 1 - np.arange(ends[-1] if len(ends) else 0)
        at = np.repeat(start + length, length) - 1 - distance
        parts = self.far.ravel()[(distance << 8) + data[at]]
        return np.bitwise_xor.reduceat(parts, ends - length) if len(ends) else parts


CRC8, CRC16 = _Crc(0x07, 8), _Crc(0x8005, 16)


def _utf8_number(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    for size in range(2, 8):
        if n < 1 << (5 * size + 1):
            head = (0xFF00 >> size & 0xFF) | (n >> 6 * (size - 1))
            return bytes([head] + [0x80 | (n >> 6 * i & 63) for i in range(size - 2, -1, -1)])
    raise ValueError("too many frames")


def _parameters(u: np.ndarray, order: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The Rice parameter of each of ``parts`` partitions of the codes of frames, and what the frames' residuals cost in bits."""
    each = u.shape[1] // parts
    by_part = u.reshape(len(u), parts, each)
    count = np.full((len(u), parts), each)
    count[:, 0] -= order
    k = np.maximum(np.frexp(by_part.sum(axis=2) / np.maximum(count, 1))[1] - 1, 0)
    tried = [(by_part >> x[:, :, None]).sum(axis=2) + count * (x + 1) for x in (k, np.maximum(k - 1, 0))]
    return np.where(tried[1] < tried[0], np.maximum(k - 1, 0), k).astype(np.int32), np.minimum(*tried).sum(axis=1) + 4 * parts + 6


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames of x (frames x 576, int32 samples from -128 to 127), and the length of each."""
    n, size = x.shape
    res = [x]
    for _ in range(4):
        res.append(np.diff(res[-1], axis=1))
    order = np.argmin([np.abs(r).sum(axis=1) + 64 * i for i, r in enumerate(res)], axis=0)
    u = np.zeros((n, size), np.int32)
    for o, r in enumerate(res):
        rows = np.flatnonzero(order == o)
        u[rows, o:] = (r[rows] << 1) ^ (r[rows] >> 31)
    ways = [_parameters(u, order, 1 << p) for p in PARTITIONS]
    way = np.argmin([c for _, c in ways], axis=0)
    cost = np.min([c for _, c in ways], axis=0) + 8 * order
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (cost >= 8 * size)
    heads = [bytes([0xFF, 0xF8, 0x24, 0x02]) + _utf8_number(int(i)) for i in numbers]
    head = np.array([len(h) + 1 for h in heads], np.int64)
    body = np.where(constant, 8, np.where(verbatim, 8 * size, cost)) + 8
    length = head + (body + 7) // 8 + 2
    start = np.cumsum(length) - length
    bits = np.zeros(int(length.sum()) * 8, np.uint8)

    def put(at, value, width):
        for j in range(width):
            bits[at + j] = value >> (width - 1 - j) & 1

    at = (start + head) * 8
    put(at, np.where(constant, 0, np.where(verbatim, 2, (8 + order) << 1)), 8)
    put(at[constant] + 8, x[constant, 0] & 255, 8)
    if verbatim.any():
        put(at[verbatim][:, None] + 8 + 8 * np.arange(size), x[verbatim] & 255, 8)
    for w, p in enumerate(PARTITIONS):
        rows = np.flatnonzero(~constant & ~verbatim & (way == w))
        if not len(rows):
            continue
        own, first = at[rows] + 8, order[rows]
        for j in range(4):
            some = first > j
            put(own[some] + 8 * j, x[rows[some], j] & 255, 8)
        put(own + 8 * first, np.full(len(rows), p), 6)  # coding method 0 and the partition order
        each = size >> p
        k = np.repeat(ways[w][0][rows], each, axis=1)
        coded = np.arange(size) >= first[:, None]
        begins = (np.arange(size) == first[:, None]) | (np.arange(size) % each == 0) & coded
        q = u[rows] >> k
        ends = np.cumsum(np.where(coded, q + 1 + k, 0) + 4 * begins, axis=1, dtype=np.int32)
        low = (own + 8 * first + 6)[:, None] + ends - k  # where the low bits of a code are, after its stop bit
        put((low - 1 - q - 4)[begins], k[begins], 4)
        bits[low[coded] - 1] = 1
        for width in np.unique(ways[w][0][rows]).tolist():
            if width:
                these = coded & (k == width)
                put(low[these], u[rows][these], width)
    data = np.packbits(bits)
    for s, h in zip(start.tolist(), heads, strict=True):
        data[s : s + len(h)] = np.frombuffer(h, np.uint8)
    data[start + head - 1] = CRC8.of(data, start, head - 1)
    crc = CRC16.of(data, start, length - 2)
    data[start + length - 2], data[start + length - 1] = crc >> 8, crc & 255
    return data, length


def encode(payload: bytes, size: int = BLOCK) -> bytes:
    return encode_many([payload], size)[0]


def encode_many(payloads: list[bytes], size: int = BLOCK) -> list[bytes]:
    """FLAC streams of payloads whose length is a positive multiple of the block size."""
    if any(not p or len(p) % size for p in payloads):
        raise ValueError(f"a payload must be a positive multiple of {size} bytes")
    counts = np.array([len(p) // size for p in payloads], np.int64)
    every = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, size)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    parts = [encode_frames(every[i : i + FRAMES].astype(np.int32) - 128, number[i : i + FRAMES]) for i in range(0, len(every), FRAMES)]
    data, length = b"".join(p[0].tobytes() for p in parts), np.concatenate([p[1] for p in parts])
    out, frame, at = [], 0, 0
    for p, n in zip(payloads, counts.tolist(), strict=True):
        own = length[frame : frame + n]
        total = int(own.sum())
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        info = size.to_bytes(2, "big") * 2 + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | n * size).to_bytes(8, "big") + md5
        seek = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        seek["sample"], seek["offset"], seek["n"] = np.arange(n) * size, np.cumsum(own) - own, size
        # a metadata block holds under 2**24 bytes; longer tables get every second point, and so on
        step = -(-seek.nbytes // ((1 << 24) - 18))
        seek = np.ascontiguousarray(seek[::step])
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + seek.nbytes.to_bytes(3, "big") + seek.tobytes() + data[at : at + total])
        frame, at = frame + n, at + total
    return out


class _Bits:
    """Bit readers over one buffer, one per frame."""

    def __init__(self, data: np.ndarray):
        self.words = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))

    def window(self, pos: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, at the top of 64."""
        return self.words[np.minimum(pos >> 3, len(self.words) - 1)].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, n, signed: bool = False) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n, np.uint64), pos.shape)
        v = (self.window(pos) >> np.uint64(1) >> (np.uint64(63) - n)).astype(np.int64)
        if signed:
            v -= (v >> np.maximum(n.astype(np.int64) - 1, 0) & 1) << n.astype(np.int64)
        return v

    def unary(self, pos: np.ndarray) -> np.ndarray:
        q, open_ = np.zeros(len(pos), np.int64), np.arange(len(pos))
        while len(open_):
            top = (self.window(pos[open_] + q[open_]) >> np.uint64(32)).astype(np.float64)
            zeros = 32 - np.frexp(top)[1].astype(np.int64)
            q[open_] += np.minimum(zeros, 32)
            if (pos[open_] + q[open_] > 8 * len(self.words) + 64).any():
                raise ValueError("a Rice code runs over the end")
            open_ = open_[zeros >= 32]
        return q


def _residuals(bits: _Bits, pos: np.ndarray, order: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(size x frames) residuals, 0 before a frame's order, and where they end."""
    method, parts = bits.take(pos, 2), bits.take(pos + 2, 4)
    if (method > 1).any() or (size & ((1 << parts) - 1)).any():
        raise ValueError("unknown residual coding")
    out = np.zeros((size, len(pos)), np.int64)
    pos, each, width = pos + 6, size >> parts, 4 + method
    k, raw = np.zeros(len(pos), np.int64), np.full(len(pos), -1)
    for i in range(int(order.min()), size):
        if i < int(order.max()) and (i < order).any():  # only some frames have begun
            rows = np.flatnonzero(order <= i)
            new = rows[(i == order[rows]) | (i % each[rows] == 0)]
            k[new] = bits.take(pos[new], width[new])
            pos[new] += width[new]
            escaped = k[new] == (1 << width[new]) - 1
            raw[new] = np.where(escaped, bits.take(pos[new], 5), -1)
            pos[new] += 5 * escaped
            plain = rows[raw[rows] < 0]
            q = bits.unary(pos[plain])
            out[i, plain] = q << k[plain] | bits.take(pos[plain] + q + 1, k[plain])
            pos[plain] += q + 1 + k[plain]
            rest = rows[raw[rows] >= 0]
            signed = bits.take(pos[rest], raw[rest], signed=True)
            out[i, rest] = np.where(signed < 0, -2 * signed - 1, 2 * signed)
            pos[rest] += raw[rest]
            plain, some_raw, uk = False, True, k.astype(np.uint64)
            continue
        new = np.flatnonzero((i == order) | (i % each == 0))
        if len(new):
            k[new] = bits.take(pos[new], width[new])
            pos[new] += width[new]
            escaped = k[new] == (1 << width[new]) - 1
            raw[new] = np.where(escaped, bits.take(pos[new], 5), -1)
            pos[new] += 5 * escaped
        if len(new) or i == int(order.max()):
            plain, some_raw, uk = not (k >= 31).any(), (raw >= 0).any(), k.astype(np.uint64)
        if plain and not some_raw:
            w = bits.window(pos)
            top = (w >> np.uint64(32)).astype(np.float64)
            q = 32 - np.frexp(top)[1].astype(np.int64)
            if int(q.max()) + int(k.max()) < 32:
                r = (w << (q + 1).astype(np.uint64) >> np.uint64(1) >> (np.uint64(63) - uk)).astype(np.int64)
                out[i] = q << k | r
                pos += q + 1 + k
                continue
        coded = raw < 0
        q = np.zeros(len(pos), np.int64)
        q[coded] = bits.unary(pos[coded])
        r = bits.take(pos + q + 1, k)
        signed = bits.take(pos, np.maximum(raw, 0), signed=True)
        out[i] = np.where(coded, q << k | r, np.where(signed < 0, -2 * signed - 1, 2 * signed))
        pos = pos + np.where(coded, q + 1 + k, raw)
    return (out >> 1) ^ -(out & 1), pos


def _frames(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Samples, frame number and length of the frames that begin at the given bytes. data ends in 64 spare bytes."""
    byte = lambda p: data[np.minimum(p, len(data) - 8)].astype(np.int64)
    if ((byte(at) << 8 | byte(at + 1)) != 0xFFF8).any() or (byte(at + 3) & 1).any():
        raise ValueError("no frame here, or one of a stream of variable blocks")
    code, rate, channel, depth = byte(at + 2) >> 4, byte(at + 2) & 15, byte(at + 3) >> 4, byte(at + 3) >> 1 & 7
    if channel.any() or ((depth != 0) & (depth != 1)).any():
        raise ValueError("only mono streams of 8 bits are read")
    lead = byte(at + 4)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(more == 0, lead, lead & (0x3F >> more))
    for j in range(1, 7):
        number = np.where(j <= more, number << 6 | (byte(at + 4 + j) & 63), number)
    p = at + 5 + more
    size = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8], [192, 576 << np.clip(code - 2, 0, 3), byte(p) + 1, (byte(p) << 8 | byte(p + 1)) + 1, 256 << np.clip(code - 8, 0, 7)], 0)
    p = p + np.select([code == 6, code == 7, rate == 12, rate >= 13], [1, 2, 0, 0], 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    if (size == 0).any() or (CRC8.of(data, at, p - at) != byte(p)).any():
        raise ValueError("a frame header fails its checksum")
    head, pos = byte(p + 1), (p + 2) * 8
    kind, bits, end = head >> 1 & 63, _Bits(data), np.zeros(len(at), np.int64)
    if (head & 0x81).any():
        raise ValueError("wasted bits are not read")
    samples: list = [None] * len(at)
    group = np.where((kind >= 8) & (kind <= 12), 8, kind)  # fixed predictors of all orders together
    for t, n in {*zip(group.tolist(), size.tolist(), strict=True)}:
        rows = np.flatnonzero((group == t) & (size == n))
        own = pos[rows]
        if t == 0:
            x = np.repeat(bits.take(own, 8, True)[:, None], n, axis=1)
            own = own + 8
        elif t == 1:
            x = data[(own >> 3)[:, None] + np.arange(n)].astype(np.int8).astype(np.int64)
            own = own + 8 * n
        elif t == 8:
            order = kind[rows] - 8
            warm = np.stack([bits.take(own + 8 * j, 8, True) for j in range(4)], axis=1)
            e, own = _residuals(bits, own + 8 * order, order, n)
            x = np.empty((len(rows), n), np.int64)
            for o in np.unique(order).tolist():
                these = np.flatnonzero(order == o)
                y = e[o:, these]
                for level in range(o - 1, -1, -1):
                    first = np.diff(warm[these, : level + 1], n=level, axis=1)[:, -1]
                    y = np.cumsum(np.vstack([first[None], y]), axis=0)
                x[these] = y.T
        elif t >= 32:
            order = t - 31
            warm = np.stack([bits.take(own + 8 * j, 8, True) for j in range(order)], axis=1)
            own = own + 8 * order
            precision, shift = bits.take(own, 4) + 1, bits.take(own + 4, 5, True)
            own = own + 9
            taps = np.stack([bits.take(own + precision * j, precision, True) for j in range(order)], axis=1)
            e, own = _residuals(bits, own + precision * order, np.full(len(rows), order), n)
            x = e.T.copy()
            x[:, :order] = warm
            for i in range(order, n):
                x[:, i] += (taps * x[:, i - order : i][:, ::-1]).sum(axis=1) >> shift
        else:
            raise ValueError("unknown subframe")
        end[rows] = (own + 7) >> 3
        x = x.astype(np.int16)
        for i, r in enumerate(rows.tolist()):
            samples[r] = x[i]
    if (CRC16.of(data, at, end - at) != (byte(end) << 8 | byte(end + 1))).any():
        raise ValueError("a frame fails its checksum")
    return samples, number, end + 2 - at


def _header(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Samples in all, their MD5, the seek points, and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, seek = 4, False, None, b"", np.zeros((0, 2), np.int64)
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = np.frombuffer(body[: n - n % 18], [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
            points = points[points["sample"] != 2**64 - 1]
            seek = np.stack([points["sample"].astype(np.int64), points["offset"].astype(np.int64)], axis=1)
        at += 4 + n
        if at > len(stream):
            raise ValueError("truncated metadata")
    if total is None:
        raise ValueError("no STREAMINFO")
    return total, md5, seek, at


def decode_many(streams: list[bytes], verify: bool = True) -> list[list[tuple[int, bytes]]]:
    """For each stream its blocks (first sample, PCM as unsigned bytes), in order."""
    data = np.frombuffer(b"".join(streams) + bytes(64), np.uint8)
    heads, base, todo = [_header(s) for s in streams], 0, []
    for i, ((total, _, seek, at), s) in enumerate(zip(heads, streams, strict=True)):
        points = seek[np.argsort(seek[:, 0])].tolist() if len(seek) else [[0, 0]]
        if points[0][0]:
            points.insert(0, [0, 0])
        todo += [(i, a, base + at + off, b) for (a, off), b in zip(points, [p[0] for p in points[1:]] + [total], strict=True) if a < b]
        base += len(s)
    blocks: list[list] = [[] for _ in streams]
    while todo:  # runs of frames between seek points go on together, a frame of each at a time
        now, todo = todo[:FRAMES], todo[FRAMES:]
        samples, _, length = _frames(data, np.array([x[2] for x in now], np.int64))
        for (i, sample, at, until), x, n in zip(now, samples, length.tolist(), strict=True):
            blocks[i].append((sample, (x + 128).astype(np.uint8).tobytes()))
            if sample + len(x) < until:
                todo.append((i, sample + len(x), at + n, until))
    for own, (total, md5, _, _) in zip(blocks, heads, strict=True):
        own.sort()
        pcm = b"".join(x for _, x in own)
        if len(pcm) != total or verify and any(md5) and hashlib.md5((np.frombuffer(pcm, np.uint8) ^ 128).tobytes()).digest() != md5:
            raise ValueError("the samples fail the stream's MD5")
    return blocks


def read_samples(stream: bytes, first: int, n: int) -> bytes:
    """PCM of samples [first, first + n): decodes from the nearest seek point only."""
    total, _, seek, at = _header(stream)
    before = seek[seek[:, 0] <= first]
    sample, off = before[np.argmax(before[:, 0])].tolist() if len(before) else (0, 0)
    data, pos, out, begun, until = np.frombuffer(stream + bytes(64), np.uint8), at + off, b"", sample, min(first + n, total)
    while sample < until:
        (x,), _, (length,) = _frames(data, np.array([pos], np.int64))
        out, sample, pos = out + (x + 128).astype(np.uint8).tobytes(), sample + len(x), pos + int(length)
    return out[first - begun : max(until, first) - begun]


def padded(text: bytes, size: int = BLOCK) -> bytes:
    """The text and bytes 255 up to a positive multiple of ``size``."""
    return text + b"\xff" * ((-len(text)) % size if text else size)


def _groups(batches, size: int):
    for batch in batches:
        buf, offs = utf8(batch.column(1))
        for i, j, b, o in chunks(buf, offs, FRAMES * size):
            yield batch.column(0)[i:j], [b[o[k] : o[k + 1]].tobytes() for k in range(j - i)]


def _encode(batches, size: int):
    for ids, texts in _groups(batches, size):
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(encode_many([padded(t, size) for t in texts], size), pa.binary())], ["doc_id", "n_bytes", "media"])


def to_flac(documents: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes (of the text without padding), media."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_encode, size=size), f"doc_id {kind}, n_bytes long, media binary")


def _decode(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            rows = [(d, s, pcm) for d, own in zip(part.column(0).to_pylist(), decode_many(part.column(1).to_pylist()), strict=True) for s, pcm in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "first_sample", "pcm"])


def read_flac(media: DataFrame) -> DataFrame:
    """doc_id, first_sample, pcm: the verified PCM blocks of each stream."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(_decode, f"doc_id {kind}, first_sample long, pcm binary")


def feature(pcm: bytes) -> str:
    """Whole-number features of a signal: energy, changes of sign, peak and total variation."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int32) - 128
    return f"energy={int((x * x).sum(dtype=np.int64))};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};peak={int(np.abs(x).max(initial=0))};variation={int(np.abs(np.diff(x)).sum(dtype=np.int64))}"


def _features(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        _, offs = utf8(batch.column("media"))
        for i, j, _, _ in chunks(np.zeros(offs[-1], np.uint8), offs, FRAMES * BLOCK):
            part = batch.slice(i, j - i)
            media = part.column("media").to_pylist()
            read = []
            for blocks in decode_many(media):
                pcm = bytearray(sum(len(x) for _, x in blocks))
                for first, x in blocks:
                    pcm[first : first + len(x)] = x
                read.append(bytes(pcm))
            sha = lambda all_: pa.array([hashlib.sha256(x).hexdigest() for x in all_], pa.string())
            count = lambda all_: pa.array([len(x) for x in all_], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), count(read), sha(read), pa.array([zlib.crc32(x[-32:]) for x in read], pa.int64()), count(media), sha(media), pa.array([feature(x) for x in read], pa.string())], names)


def stored_features(documents: DataFrame, size: int = BLOCK) -> DataFrame:
    """Each text stored as a FLAC stream in a table, and what is read back from the stored bytes."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    media = materialize(to_flac(documents, size), "flac", compression="zstd")
    return media.mapInArrow(_features, out)
