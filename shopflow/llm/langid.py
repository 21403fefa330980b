"""Language identification with interpolated Kneser-Ney character models.

Method. Letters are lower-cased, runs of anything else become one space, and
the character 4-grams of all training texts are counted per language. Lower
orders use continuation counts (in how many different left contexts a gram was
seen), and absolute discounts are estimated from counts of counts. The model is
a table of every string's hash with its share and back-off weight per language.
A text goes to the language of the lowest cross-entropy per character; ``score``
is the posterior of that language at a temperature fitted on training texts
held out of the counts, and texts under the threshold that reaches
``precision`` on them have ``accepted`` false.

Scale. Tasks count grams in arrays and send their distinct grams; Spark sums
and discounts them. Every gram is kept and none goes to the driver: texts are
dealt to chunks of about ``CHUNK`` characters as compressed bundles of their
letters, the distinct strings of a chunk are joined to the model by hash, and
each chunk is scored from a sorted hash array of the rows that it needs, so a
task's memory depends on a chunk and not on the model. Temperature and
threshold are fitted on at most ``calibration_rows`` texts, those of the least
hashes, and on no more than one in twenty.

Edge cases. Spaces stand before each text, so a score does not depend on the
texts beside it. A null text, or one without a letter, is ``und`` with score 0. Rows
with a null language are not learned from. Without any training text every
text is ``und``. Rows repeat as they come; other columns are ignored.
"""

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textbytes import U, mix

ORDER, CALIBRATION_ROWS, PRECISION = 4, 2_000, 0.99
SLICE, CHUNK = 1 << 20, 16 << 20
#: Cells of a table of strings; where it would be larger, their hashes are sorted.
CELLS = 1 << 22
#: A model row: what a string has in one language.
ENTRY = np.dtype([("lang", "<u2"), ("share", "<f4"), ("back", "<f4")])


@lru_cache
def folded() -> np.ndarray:
    """Code point -> lower-cased letter, or a space for what isn't a letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, each between two spaces, the offset of each text, and its number of letters."""
    one = (" " + " ".join(t or "" for t in texts)).encode("utf-32-le", "surrogatepass") + b" \0\0\0"
    raw = folded()[np.frombuffer(one, np.uint32)]
    starts = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    space = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[starts] = True  # each text begins with a space of its own
    n = np.cumsum(keep)
    seen = np.concatenate([[0], np.cumsum(~space)])
    return raw[keep], n[starts] - 1, seen[starts[1:]] - seen[starts[:-1]]


def _slices(texts: list, most: int = SLICE):
    row, n = 0, len(texts)
    while row < n:
        end, size = row, 0
        while end < n and (end == row or size < most):
            size += len(texts[end] or "")
            end += 1
        yield row, end
        row = end


def _numbered(of: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Numbers under ``n`` made dense, in their order, and how many there are."""
    seen = np.zeros(n, bool)
    seen[of] = True
    rank = np.cumsum(seen)
    return rank.take(of) - 1, int(rank[-1])


def _distinct(x: np.ndarray, at: np.ndarray, order: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct strings of ``order`` characters that begin at ``at``, the place of each string among them).

    Strings are numbers in base of the characters that occur, made dense by a table when they get large; only if even that table
    would be too large for the slice are hashes sorted.
    """
    if not len(at):
        return np.zeros((0, order), x.dtype), at
    cells = min(cells, max(1 << 16, 8 * len(at)))
    code, n_codes = _numbered(x, int(x.max()) + 1)
    of, n = code[at], n_codes
    for k in range(1, order):
        if n * n_codes > cells:
            of, n = _numbered(of, n)
        if n * n_codes > cells:
            windows = np.lib.stride_tricks.sliding_window_view(x, order)[at]
            _, first, of = np.unique(_hash(windows), return_index=True, return_inverse=True)
            return windows[first], of
        of *= n_codes
        of += code[at + k]
        n *= n_codes
    of, n = _numbered(of, n)
    some = np.empty(n, np.int64)
    some[of] = at
    return x[some[:, None] + np.arange(order)], of


def _count(batches, order: int):
    """lang, gram, n: what this task's rows hold."""
    held: dict = {}

    def merged(parts):
        h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        codes = np.concatenate([p[1] for p in parts])
        h, first, at = np.unique(h, return_index=True, return_inverse=True)
        return [(h, codes[first], np.bincount(at, n).astype(np.int64))]

    for batch in batches:
        for lang, rows in batch.to_pandas().groupby("lang")["text"]:
            rows = rows.tolist()
            for i, j in _slices(rows):
                x, starts, _ = letters(rows[i:j])
                if len(x) < order:
                    continue
                inside = np.ones(len(x) - order + 1, bool)
                for k in range(1, order):  # grams that would run into the next text
                    at = starts[1:] - k
                    inside[at[(at >= 0) & (at < len(inside))]] = False
                grams, of = _distinct(x, np.flatnonzero(inside), order)
                parts = held.setdefault(lang, [])
                parts.append((_hash(grams), grams, np.bincount(of, minlength=len(grams))))
                if len(parts) > 12:
                    held[lang] = merged(parts)
    for lang, parts in held.items():
        ((_, codes, n),) = merged(parts)
        for i in range(0, len(n), 50_000):
            part = codes[i : i + 50_000]
            joined = part.astype("<u4").tobytes().decode("utf-32-le", "replace")
            grams = [joined[k * order : (k + 1) * order] for k in range(len(part))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(grams, pa.string()), pa.array(n[i : i + 50_000])], ["lang", "gram", "n"])


def gram_counts(training: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n over all training rows (text, lang)."""
    rows = training.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_count, order=order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """k, lang, gram, share, back: of each gram of k characters max(n - D, 0) over its context's total, and the weight of the next lower order after that context."""
    level, out = counts, None
    for k in range(order, 0, -1):
        few = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        discount = few.select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d"))
        context = F.substring("gram", 1, k - 1).alias("context")
        totals = level.groupBy("lang", context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(F.broadcast(discount), "lang")
        rows = level.select("lang", "gram", "n", context).join(totals, ["lang", "context"])
        rows = rows.select(F.lit(k).alias("k"), "lang", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("share"), (F.col("d") * F.col("kinds") / F.col("total")).alias("back"))
        out = rows if out is None else out.unionByName(rows)
        level = level.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("n"))
    return out


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(codes.shape[:-1], np.uint64)
    for j in range(codes.shape[-1]):
        h = h * U(0x9E3779B97F4A7C15) + codes[..., j].astype(np.uint64) + U(1)
    return mix(h)


class SortedHashes:
    """A sorted array of hashes with a directory of their leading bits."""

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        self.first = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << U(64 - self.bits)).astype(np.int32)
        self.padded = np.append(self.keys, U(2**64 - 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the sorted array, -1 where it is not."""
        at = self.first[(h >> U(64 - self.bits)).astype(np.int64)]
        open_ = np.flatnonzero(self.padded[at] < h)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.padded[at[open_]] < h[open_]]
        return np.where((self.padded[at] == h) & (at < len(self.keys)), at, -1)


def _posterior(means: np.ndarray, n_letters: np.ndarray, beta: float) -> np.ndarray:
    z = (means - means.max(axis=1, keepdims=True)) * beta * np.sqrt(np.maximum(n_letters, 1))[:, None]
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _bundle(batches, most: int = CHUNK):
    """chunk, ids, sizes, n_letters, texts: the letters of a task's texts, one compressed row for each chunk."""
    held, size = {}, 0

    def send():
        zstd = pa.Codec("zstd", 3)
        for chunk, parts in sorted(held.items()):
            ids, sizes, n, texts = zip(*parts, strict=True)
            texts = b"".join(texts)
            arrays = [pa.array([chunk], pa.int64()), pa.array([sum(ids, [])], pa.list_(kind)), pa.array([np.concatenate(sizes)], pa.list_(pa.int32())), pa.array([np.concatenate(n)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(texts)], pa.int32()), pa.array([zstd.compress(texts, asbytes=True)], pa.binary())], ["chunk", "ids", "sizes", "n_letters", "n_bytes", "texts"])

    for batch in batches:
        kind = batch.schema.field(1).type
        chunks = batch.column(0).to_numpy()
        for chunk in np.unique(chunks).tolist():
            rows = batch.take(pa.array(np.flatnonzero(chunks == chunk)))
            ids, texts = rows.column(1).to_pylist(), rows.column(2).to_pylist()
            for i, j in _slices(texts):
                x, starts, n = letters(texts[i:j])
                folded_ = x[: starts[-1]].astype("<u4").tobytes().decode("utf-32-le", "replace").encode()
                held.setdefault(chunk, []).append((ids[i:j], np.diff(starts).astype(np.int32), n.astype(np.int32), folded_))
                size += len(folded_)
        if size > most:
            yield from send()
            held, size = {}, 0
    yield from send()


_BUNDLE = "chunk long, ids array<{kind}>, sizes array<int>, n_letters array<int>, n_bytes int, texts binary"


def _texts(bundles: pa.Table, order: int, most: int = SLICE):
    """(ids, distinct windows, the place of each window among them, starts, n_letters) of a chunk's texts: each character after the
    order - 1 before it, spaces before a text. Small bundles are taken together: the more tasks, the smaller each one's part of a chunk.
    """
    zstd, lead = pa.Codec("zstd"), order - 1

    def slices(held: list):
        ids, sizes, letters_, raw = zip(*held, strict=True)
        ids, raw, n = sum(ids, []), "".join(raw), np.concatenate(letters_)
        ends, i = np.cumsum(np.concatenate(sizes)), 0
        while i < len(ends):
            begin = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, begin + most, "right")))
            x = np.frombuffer(raw[begin : int(ends[j - 1])].encode("utf-32-le"), np.uint32)
            starts = np.concatenate([[0], ends[i:j] - begin])
            at = np.arange(len(x)) + lead * np.repeat(np.arange(j - i), np.diff(starts))
            padded = np.full(len(x) + lead * (j - i), 32, x.dtype)
            padded[at + lead] = x
            yield ids[i:j], *_distinct(padded, at, order), starts, n[i:j]
            i = j

    held, size = [], 0
    for row in bundles.select(["ids", "sizes", "n_letters", "n_bytes", "texts"]).to_pylist():
        raw = zstd.decompress(row["texts"], row["n_bytes"], asbytes=True).decode()
        held.append((row["ids"], np.array(row["sizes"], np.int64), np.array(row["n_letters"], np.int64), raw))
        size += len(raw)
        if size >= most:
            yield from slices(held)
            held, size = [], 0
    if held:
        yield from slices(held)


def _wanted(key: tuple, bundles: pa.Table, order: int) -> pa.Table:
    """chunk, h: every string whose share or weight the texts of a chunk need."""
    parts, held, kept = [np.zeros((0, order), np.uint32)], 0, 0

    def merged():
        codes = np.concatenate(parts)
        return codes[np.unique(_hash(codes), return_index=True)[1]]

    for _, w, _, _, _ in _texts(bundles, order):
        parts.append(w)
        held += len(w)
        if held > 2 * kept + SLICE:
            parts = [merged()]
            held = kept = len(parts[0])
    codes = merged()
    parts = [np.unique(_hash(codes[:, order - k : end])) for k in range(1, order + 1) for end in (order, order - 1)]
    found = np.unique(np.concatenate(parts)).view(np.int64)
    return pa.table({"chunk": pa.array(np.full(len(found), key[0].as_py(), np.int64)), "h": pa.array(found)})


def _means(bundles: pa.Table, rows: pa.Table, order: int, n_langs: int, n_chars: int, key: str) -> pa.Table:
    """The keys of a chunk's texts, the mean log probability per character in every language, and the letters."""
    hashes = rows.column("h").to_numpy().view(np.uint64)
    find = SortedHashes(hashes)
    held = rows.column("entries").to_pylist()
    entries = np.frombuffer(b"".join(held), ENTRY)
    at = np.empty(len(hashes), np.int64)
    at[find.order] = np.arange(len(hashes))
    at = np.repeat(at, [len(e) // ENTRY.itemsize for e in held])
    # the last row is that of a string no language has
    share, back = np.zeros((len(hashes) + 1, n_langs), np.float32), np.ones((len(hashes) + 1, n_langs), np.float32)
    share[at, entries["lang"]], back[at, entries["lang"]] = entries["share"], entries["back"]
    ids, means, n_letters = [], [np.zeros((0, n_langs))], [np.zeros(0, np.int64)]
    for own, w, of, starts, n in _texts(bundles, order, max(1, SLICE // max(1, n_langs // 8))):
        p = np.full((len(w), n_langs), 1 / (n_chars + 1))
        for k in range(1, order + 1):
            p = share[find.find(_hash(w[:, order - k :]))] + back[find.find(_hash(w[:, order - k : order - 1]))] * p
        total = np.stack([np.add.reduceat(column[of], starts[:-1]) for column in np.log(p).T.copy()], axis=1)
        ids += own
        means.append(total / np.diff(starts)[:, None])
        n_letters.append(n)
    means, n_letters = np.concatenate(means), np.concatenate(n_letters)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(means) + 1) * n_langs, pa.int32()), pa.array(means.ravel()))
    return pa.table([pa.array(ids, bundles.schema.field("ids").type.value_type), lists, pa.array(n_letters, pa.int64())], [key, "means", "n_letters"])


def _packed(batches, langs: list):
    """h, entries: a string's hash, and what it has in each of its languages."""
    column = {x: i for i, x in enumerate(langs)}
    for batch in batches:
        grams, own = batch.column("gram").to_pylist(), batch.column("own")
        h, sizes = np.zeros(len(grams), np.uint64), np.array([len(g) for g in grams], np.int64)
        for k in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == k)
            codes = np.frombuffer("".join(grams[i] for i in of.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(of), k)
            h[of] = _hash(codes)
        flat, ends = own.flatten(), own.offsets.to_numpy() - own.offsets[0].as_py()
        entries = np.zeros(len(flat), ENTRY)
        entries["lang"] = [column[x] for x in flat.field("lang").to_pylist()]
        entries["share"], entries["back"] = flat.field("share").to_numpy(), flat.field("back").to_numpy()
        raw = pa.BinaryArray.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer((ends * ENTRY.itemsize).astype(np.int32)), pa.py_buffer(entries.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), raw], ["h", "entries"])


class ModelTable:
    """All rows of a model as a table (h, entries), with the names of its languages and the number of its characters."""

    def __init__(self, training: DataFrame, order: int = ORDER):
        counts = materialize(gram_counts(training, order), "gram-counts", compression="zstd")
        rows = materialize(kneser_ney(counts, order), "kneser-ney", compression="zstd")
        about = rows.filter("k = 1").agg(F.collect_set("lang").alias("langs"), F.count_distinct("gram").alias("chars")).first()
        self.order, self.langs, self.n_chars = order, sorted(about["langs"]), about["chars"]
        grams = rows.select("lang", "gram", F.col("share").cast("float").alias("share"), F.lit(None).cast("float").alias("back"))
        contexts = rows.select("lang", F.expr("substring(gram, 1, k - 1)").alias("gram"), F.col("back").cast("float").alias("back")).distinct()
        contexts = contexts.select("lang", "gram", F.lit(None).cast("float").alias("share"), "back")
        every = grams.unionByName(contexts).groupBy("lang", "gram").agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("back"), F.lit(1.0)).alias("back"))
        own = every.groupBy("gram").agg(F.collect_list(F.struct("lang", "share", "back")).alias("own"))  # one entry a language
        self.rows = materialize(own.mapInArrow(partial(_packed, langs=self.langs), "h long, entries binary"), "language-model", compression="zstd")

    def means(self, documents: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
        """key, means (per language), n_letters of documents (key, text)."""
        docs = documents.select(key, F.col("text").cast("string").alias("text"))
        size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        order, n_langs, n_chars = self.order, len(self.langs), self.n_chars
        chunk = max(1, chunk // max(1, n_langs // 16))
        kind = documents.schema[key].dataType.simpleString()
        n_chunks = size // chunk + 1
        docs = docs.select(F.pmod(F.xxhash64(key, "text", F.monotonically_increasing_id()), F.lit(n_chunks)).alias("chunk"), key, "text")
        bundles = docs.mapInArrow(_bundle, _BUNDLE.format(kind=kind))
        # a fixed number of parts is left as it is: put together by bytes, chunks would wait for each other in about as many tasks as there are cores
        parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bundles = bundles.repartition(max(parts, min(4 * n_chunks, 4 * parts)), "chunk") if n_chunks > 1 else bundles.repartition("chunk")
        wanted = bundles.groupBy("chunk").applyInArrow(lambda key, rows: _wanted(key, rows, order), "chunk long, h long")
        # the model grows with the training texts and must not be taken for small
        rows = wanted.join(self.rows.hint("merge"), "h").select("chunk", "h", "entries")
        score = lambda bundles, rows: _means(bundles, rows, order, n_langs, n_chars, key)
        return bundles.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(score, f"{key} {kind}, means array<double>, n_letters long")


def _stack(means: pa.Array, n_langs: int) -> np.ndarray:
    return means.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_langs)


def _predict(batches, langs: list, beta: float, threshold: float):
    for batch in batches:
        n = batch.column(2).to_numpy()
        p = _posterior(_stack(batch.column(1), len(langs)), n, beta)
        found = [langs[b] if k else "und" for b, k in zip(p.argmax(axis=1).tolist(), n.tolist(), strict=True)]
        scores = np.where(n > 0, p.max(axis=1), 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores), pa.array((scores >= threshold) & (n > 0))], ["doc_id", "lang_pred", "score", "accepted"])


def split(training: DataFrame, rows: int = CALIBRATION_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows to count, rows to calibrate on): of the rows with a language and a text those of the least hashes, at most ``rows`` and one in twenty."""
    keys = [c for c in ("doc_id", "text") if c in training.columns]
    usable = training.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("_at", F.xxhash64(*keys))
    some = min(rows, usable.count() // 20)
    if not some:
        return usable, None
    last = usable.select("_at").orderBy("_at").limit(some).agg(F.max("_at")).first()[0]
    sample = usable.filter(F.col("_at") <= last).orderBy("_at").limit(some)
    return usable.filter(F.col("_at") > last), sample.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def calibrate(model: ModelTable, sample: DataFrame | None, precision: float = PRECISION) -> tuple[float, float]:
    """(temperature, least score) fitted on labelled texts that the model has not counted."""
    if not model.langs or sample is None:
        return 1.0, 0.0
    scored = model.means(sample, "lang").toArrow().combine_chunks()
    if not scored.num_rows:
        return 1.0, 0.0
    means = np.concatenate([_stack(c, len(model.langs)) for c in scored.column("means").chunks])
    n = scored.column("n_letters").to_numpy()
    own = scored.column("lang").to_pandas().map({x: i for i, x in enumerate(model.langs)}).fillna(-1).to_numpy(np.int64)
    use = (n > 0) & (own >= 0)
    means, n, own = means[use], n[use], own[use]
    if not len(own):
        return 1.0, 0.0
    loss = {b: -np.log(np.maximum(_posterior(means, n, b)[np.arange(len(own)), own], 1e-9)).mean() for b in 2.0 ** np.arange(-4, 5)}
    beta = min(loss, key=loss.get)
    p = _posterior(means, n, beta)
    order = np.lexsort((own, -p.max(axis=1)))
    right = np.cumsum((p.argmax(axis=1) == own)[order]) / np.arange(1, len(own) + 1)
    good = np.flatnonzero(right >= precision)
    return float(beta), float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0


def identify(documents: DataFrame, training: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang_pred, score, accepted."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    counted, sample = split(training)
    model = ModelTable(counted, order)
    if not model.langs:
        return documents.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    beta, threshold = calibrate(model, sample)
    predict = partial(_predict, langs=model.langs, beta=beta, threshold=threshold)
    return model.means(documents, "doc_id").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
