"""Chat formatting, WARC packages, FLAC, mixing: round trips and exact counts."""

import collections
import hashlib
import math
import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopflow.llm import chat, flac, mixing, warc
from .conftest import prose

MESSAGES = "conv_id long, turn long, role string, text string, n_turns long, media string"


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "&lt; &amp;lt; </turn><turn>user\nx"), (1, 0, "user", None), (2, 0, None, "a\nb"), (2, 0, "user\n<", "tie"), (2, 0, "user\n<", "tie"), (3, None, "assistant", "😀é"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], MESSAGES).withColumn("parts", chat.text_parts(F.col("text")))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        assert [(t.role, t.text) for t in got[c].turns] == [x[2:] for x in sorted(turns)]
    digest = {r.conv_id: r for r in chat.digest(chat.read_back(chat.format_chats(df))).collect()}
    assert digest[3].loss_chars == 2 and digest[3].loss_sha256 == hashlib.sha256("😀é".encode()).hexdigest()
    assert digest[1].loss_chars == len(rows[0][3]) and digest[2].loss_chars == 0


def test_chat_parts(spark):
    part = lambda kind, **x: (kind, x.get("text"), x.get("uri"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    rows = [
        (1, 0, "user", [part("text", text="see "), part("image", uri="a.png", width=56, height=57), None, part("text", text=" and <b>"), part("audio", uri="b.wav", seconds=1.01)]),
        (1, 1, "assistant", None), (1, 2, "user", [part("document", uri="c.pdf", pages=2), part("image", uri="d.png")]),
    ]
    got = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert got.formatted == "<turn>user\nsee <image 1> and &lt;b><audio 2></turn><turn>assistant\n</turn><turn>user\n<document 3><image 4></turn>"
    assert [(a.turn, a.number, a.type, a.uri, a.tokens) for a in got.attachments] == [(0, 1, "image", "a.png", 6), (0, 2, "audio", "b.wav", 26), (2, 3, "document", "c.pdf", 1024), (2, 4, "image", "d.png", 0)]
    assert got.attachment_tokens == 1056
    assert chat.format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).count() == 0


def test_placeholders_and_loss_spans_are_read_back(spark):
    part = lambda kind, text=None: (kind, text, None, None, None, None, None)
    rows = [(1, 0, "user", [part("image"), part("text", "<image 1> &lt;"), part("a>b <c"), part(None, "é😀"), part("text", "")]), (1, 1, "assistant", [part("text", "x < y &amp; z"), part("image"), part("text", "ok")]), (1, 2, "assistant", []), (1, 3, "tool", [part("text", "t" * 3000)]), (1, 4, "assistant", [part("text", "é" * 2500)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = chat.read_back(chat.format_chats(df))
    r = got.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("turns"))).first()
    assert [(p.type, p.text, p.number) for p in r.turns[0].parts] == [("image", None, 1), ("text", "<image 1> &lt;", None), ("a>b <c", None, 2), ("text", "é😀", None)]
    assert [(p.type, p.text, p.number) for p in r.turns[1].parts] == [("text", "x < y &amp; z", None), ("image", None, 3), ("text", "ok", None)] and r.turns[2].parts == []
    undo = lambda x: x.replace("&lt;", "<").replace("&amp;", "&")
    spans = [undo(r.formatted[t.loss_start : t.loss_start + t.loss_length]) for t in r.turns]
    assert spans == ["", "x < y &amp; z<image 3>ok", "", "", "é" * 2500] and r.loss == "".join(spans)
    assert all(r.formatted[t.loss_start - 1] == "\n" for t in r.turns)


def test_chat_uses_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    plan = chat.digest(chat.read_back(chat.format_chats(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_zip_members_with_and_without_zip64():
    for wide in (True, False):
        data = warc.zip_stored([(b"a", b"123"), (b"b/c", b"")], wide)
        assert warc.directory(lambda at, n: data[at : at + n], len(data)) and data[slice(*(lambda x: (x[0], sum(x)))(warc.directory(lambda at, n: data[at : at + n], len(data))[b"a"]))] == b"123"
        import io
        import zipfile

        z = zipfile.ZipFile(io.BytesIO(data))
        assert z.testzip() is None and z.read("a") == b"123"
        with pytest.raises((ValueError, struct.error)):
            warc.directory(lambda at, n, d=data[:-30]: d[at : at + n], len(data) - 30)


def test_warc_round_trip(spark):
    big = "é" * 600
    pages = [(1, "http://a", big), (2, None, big), (3, "u\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", big + "!"), (7, "u", big + "!"), (None, "u", big)]
    df = spark.createDataFrame([(*p, "d", "n") for p in pages], "page_id long, url string, html string, digest string, keep string")
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.write_and_read(df).collect())
    want = collections.Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        keep = max(p[0] for p in pages if p[0] is not None and (p[2] or "") == (html or "")) if i is not None else None
        revisit = len(data) >= 1000 and i is not None and i < keep
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None] += 1
    assert got == want
    bodies = {r.page_id: bytes(r.payload).decode() for r in warc.read_packages(warc.package(df, archive_bytes=2000)).collect() if r.record_type == "response"}
    assert bodies["2"] == big and bodies["5"] == "" and bodies["3"] == "small"
    assert warc.write_and_read(df.limit(0)).count() == 0


def test_damaged_warc_is_refused():
    data = warc.record(1, "u", b"x" * 10, None)
    assert warc.parse(data)["payload"] == b"x" * 10
    with pytest.raises(ValueError):
        warc.parse(data[:-10])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=3000), st.integers(0, 255).map(lambda b: bytes([b]) * 700)), min_size=1, max_size=4))
def test_flac_round_trip(payloads):
    payloads = [flac.padded(p) for p in payloads]
    media = flac.encode_many(payloads)
    assert [b"".join(x for _, x in own) for own in flac.decode_many(media)] == payloads
    for p, m in zip(payloads, media, strict=True):
        assert [s for s, _ in flac.decode_many([m])[0]] == list(range(0, len(p), 576))
        assert flac.read_samples(m, 100, 900) == p[100:1000]


class Bits:
    def __init__(self):
        self.out = []

    def put(self, value, n):
        self.out += [value >> (n - 1 - i) & 1 for i in range(n)]

    def rice(self, e, k):
        u = 2 * e if e >= 0 else -2 * e - 1
        self.out += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)


def crc(data, poly, bits):
    c = 0
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
    return c


def test_flac_reads_lpc_partitions_and_escapes():
    """A frame written bit by bit: LPC of order 2, four partitions, one of them escaped; no seek table."""
    r = np.random.default_rng(3)
    x = np.clip(np.cumsum(r.integers(-4, 5, 192)), -128, 127).tolist()
    taps, shift = [7, -3], 2
    residual = [x[i] - ((taps[0] * x[i - 1] + taps[1] * x[i - 2]) >> shift) for i in range(2, 192)]
    b = Bits()
    head = bytes([0xFF, 0xF8, 0x14, 0x02, 0])
    for v in (*head, crc(head, 7, 8)):
        b.put(v, 8)
    b.put((32 + 1) << 1, 8)
    for v in x[:2]:
        b.put(v & 255, 8)
    b.put(5 - 1, 4)
    b.put(shift, 5)
    for t in taps:
        b.put(t & 31, 5)
    b.put(0, 2)
    b.put(2, 4)
    at = 0
    for part in range(4):
        n = 48 - 2 * (part == 0)
        if part == 1:
            b.put(15, 4)
            b.put(12, 5)
            for e in residual[at : at + n]:
                b.put(e & 4095, 12)
        else:
            b.put(part, 4)
            for e in residual[at : at + n]:
                b.rice(e, part)
        at += n
    b.put(0, -len(b.out) % 8)
    frame = np.packbits(b.out).tobytes()
    frame += crc(frame, 0x8005, 16).to_bytes(2, "big")
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 192).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame
    assert flac.decode_many([stream])[0][0][1] == bytes(v + 128 for v in x)
    for at in (-1, -40, len(stream) - len(frame) + 3):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode_many([bytes(bad)])


def decoded_bit_by_bit(stream: bytes) -> tuple[bytes, collections.Counter]:
    """PCM of a stream of frames of 576 samples, and its subframes by kind; written from the format, a bit at a time."""
    at, last = 4, False
    while not last:
        last, at = stream[at] >> 7, at + 4 + int.from_bytes(stream[at + 1 : at + 4], "big")
    out, kinds, number = bytearray(), collections.Counter(), 0
    while at < len(stream):
        bits = "".join(f"{x:08b}" for x in stream[at : at + 700])
        p = 8 * (5 + (0 if number < 128 else 1 if number < 2048 else 2) + 1)

        def take(n):
            nonlocal p
            p += n
            return int(bits[p - n : p] or "0", 2)

        signed = lambda n: (v := take(n)) - ((v >> (n - 1)) << n)  # noqa: B023, E731
        kind = take(8) >> 1
        kinds[kind] += 1
        if kind == 0:
            x = [signed(8)] * 576
        elif kind == 1:
            x = [signed(8) for _ in range(576)]
        else:
            order = kind - 8
            x, (method, parts) = [signed(8) for _ in range(order)], (take(2), take(4))
            assert method == 0 and kind <= 12
            for part in range(1 << parts):
                k = take(4)
                for _ in range((576 >> parts) - (order if part == 0 else 0)):
                    end = bits.index("1", p)
                    q, p = end - p, end + 1
                    u = q << k | (take(k) if k else 0)
                    e = u >> 1 if u % 2 == 0 else -(u + 1) // 2
                    x.append(e + sum((-1) ** (j + 1) * math.comb(order, j) * x[-j] for j in range(1, order + 1)))
        out += bytes(v + 128 for v in x)
        end = at + (p + 7) // 8
        assert crc(stream[at:end], 0x8005, 16) == int.from_bytes(stream[end : end + 2], "big")
        at, number = end + 2, number + 1
    return bytes(out), kinds


def test_flac_frames_are_rice_coded():
    """Every frame of prose is predicted and Rice coded, streams are smaller than payloads, and another decoder reads them."""
    r = np.random.default_rng(5)
    steps = np.clip(np.cumsum(r.integers(-2, 3, 576 * 4)), -128, 127)
    smooth = np.round(100 * np.sin(np.arange(576 * 4) / 90))
    half = np.where(np.arange(576 * 4) % 576 < 288, 3, r.integers(-60, 60, 576 * 4))
    payloads = [flac.padded(prose(3, 2_000).encode())] + [bytes((x + 128).astype(np.uint8)) for x in (steps, smooth, half)] + [bytes(r.integers(0, 256, 576, np.uint8)), b"x" * 576]
    kinds = collections.Counter()
    for payload, stream in zip(payloads, flac.encode_many(payloads), strict=True):
        pcm, found = decoded_bit_by_bit(stream)
        assert pcm == payload
        kinds += found
        if payload is payloads[0]:
            assert found[1] == 0 and len(stream) < len(payload) and sum(found.values()) > 15
    assert kinds[0] == 1 and kinds[1] == 1 and len([k for k in kinds if k >= 8]) >= 3


def test_flac_columns(documents, corpus, no_documents):
    got = collections.Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in flac.stored_features(documents).collect())
    assert got == collections.Counter((c[0], len((c[1] or "").encode()), hashlib.sha256(flac.padded((c[1] or "").encode())).hexdigest()) for c in corpus)
    blocks = flac.read_flac(flac.to_flac(documents.filter("doc_id = 49"))).orderBy("first_sample").collect()
    assert b"".join(bytes(r.pcm) for r in blocks) == flac.padded(next(c[1] for c in corpus if c[0] == 49).encode())
    assert flac.stored_features(no_documents).count() == 0


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, left = {}, dict(sizes)
    while left:
        rest = sum(sizes.values()) - sum(capped.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = most * sizes[s]
            del left[s]
    return capped


def test_mixing(documents, corpus):
    mixed, ranked = mixing.mix_sources(documents, block=16)
    rows = mixing.taken(mixed, ranked).collect()
    size, source = collections.Counter(), collections.Counter()
    for c in corpus:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", c[1] or ""))
        size[c[0], c[3]] += n
        source[c[3]] += n
    want = targets_by_hand(dict(source))
    assert {(r.doc_id, r.source): r["size"] for r in rows} == dict(size)
    taken = collections.Counter()
    for r in rows:
        assert r.taken <= 3 * r["size"] and math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == source[r.source]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5
    again = mixing.taken(*mixing.mix_sources(documents.repartition(2), block=16)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    places = mixed.select("shard", "place", "rank").distinct()
    assert places.count() == places.select("shard", "place").distinct().count()


@pytest.mark.parametrize("bits", [0, 1, 3, 12])
def test_words_before_a_part_in_two_levels(spark, bits):
    r = np.random.default_rng(bits)
    rows = [(s, int(p), int(r.integers(0, 9))) for s in ("a", None, "b") for p in r.choice(64, 20, replace=False)]
    got = {(x.source, x.part): x.base for x in mixing.words_before(spark.createDataFrame(rows, "source string, part long, n long"), bits).collect()}
    assert got == {(s, p): sum(n for t, q, n in rows if t == s and q < p) for s, p, _ in rows}


def test_mixing_of_nothing(spark, no_documents):
    assert mixing.taken(*mixing.mix_sources(no_documents)).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.taken(*mixing.mix_sources(silent)).collect()] == [(0.0, 0), (0.0, 0)]


def test_mix_holds_the_words_of_its_documents(documents, corpus):
    mixed, _ = mixing.mix_sources(documents, block=16)
    words = collections.defaultdict(list)
    for c in sorted(corpus, key=lambda c: (c[1] or "").encode()):
        words[c[0], c[3]] += re.findall(r"[^\x20\x09-\x0D]+", c[1] or "")
    names = sorted({c[3] for c in corpus}, key=lambda s: (s is None, s))
    stored, seen = mixed.collect(), collections.defaultdict(set)
    short = collections.Counter()
    for r in stored:
        assert [p.at for p in r.pieces] == [sum(q.words for q in r.pieces[:i]) for i in range(len(r.pieces))]
        for p in r.pieces:
            w = words[p.doc_id, names[r["rank"]]]
            assert p.text.split(" ") == w[p.first_word : p.first_word + p.words] and p.words > 0
            seen[r["rank"], r.block].add((p.doc_id, p.first_word, p.words))
        if sum(p.words for p in r.pieces) != 16:
            short[r["rank"], r.block] += 1
    # short are the last block of a source, and one slot of it where its target ends inside a block
    for rank in {rank for rank, _ in short}:
        last = max(b for k, b in seen if k == rank)
        assert sum(n for (k, b), n in short.items() if k == rank and b != last) <= 1
    # a block holds the same wherever it is whole
    for k, x in seen.items():
        longest = max((r for r in stored if (r["rank"], r.block) == k), key=lambda r: sum(p.words for p in r.pieces))
        assert {(p.doc_id, p.first_word) for p in longest.pieces} == {y[:2] for y in x}


@given(st.integers(1, 5000), st.integers(0, 2**32))
@settings(max_examples=30, deadline=None)
def test_permutations(n, key):
    sizes, keys = np.full(n, n), np.full(n, key, np.uint64)
    got = mixing.permuted(np.arange(n), sizes, keys)
    assert sorted(got.tolist()) == list(range(n))
    assert mixing.permuted(got, sizes, keys, inverse=True).tolist() == list(range(n))
