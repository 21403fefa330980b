"""Toxicity by a weighted finite-state grammar over clauses.

Method. A clause is a run of words up to ``.``, ``!``, ``?``, ``;`` or a line
end. Words become symbols: insult stems, threat verbs, target words, negation,
reporting verbs, anything else. Five weighted transducers read the symbols of a
clause: the insult and threat ones weigh what is said, the target one raises an
attack that names somebody within a few words before or after it, the negation
and reported-speech ones lower what follows a negation or a reporting verb. A
threat needs its target after it, or an object pronoun before it, as German and
the Romance languages put it. The machines are composed into one, and a clause
scores the weight of its best path. A document's score is a logistic function of
its best clause, the sum of its clauses and whether anything matched.

The arcs of each transducer share a weight. The weights are fitted to the
labelled rows by a logistic regression on how often each fires along the best
path of a document's best clause, drawn towards ``ARCS`` where rows say little; a
transducer keeps its sign.

Insult stems and their weights are learned from labels: the beginnings of words
(``STEMS`` bytes) and whole words whose share of toxic documents is high, on at
most ``sample_rows`` labelled rows; the logistic function is fitted on the same
rows. A short list of words is known from the start.

Scale. One pass over the labelled rows and one map over all documents, without a
shuffle of texts. Only things that the sample bounds reach the driver: counts of
stems that passed ``least`` of its documents, and features of its rows.

Edge cases. Null and empty texts match nothing and get the score of documents
without a match. Without labels, or with labels of one class, the known words,
``ARCS`` and a fixed logistic function are used. Labels are taken per row; rows with a
null label or id are not learned from. Other columns are ignored.
"""

from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import ALNUM, U, Words, chunks, mix, utf8

SAMPLE_ROWS, LEAST, PRECISION, THRESHOLD = 20_000, 5, 0.7, 0.3
STEMS = (0, 5, 6, 7, 8, 9, 10)  # bytes; 0 is the whole word

# Words of the grammar, lower-cased.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown fool imbecile dumb jerk bastard".split()
THREATS = (
    "kill hurt destroy beat smash shoot stab crush töten töte umbringen schlagen schlage zerstören zerstöre erschießen erschieße "
    "tuer tue tuerai frapper frappe frapperai détruire détruirai matar mato mataré golpear golpearé destruir destruiré"
).split()
TARGETS = "you your u they them he him she her du ihr er sie tu toi il elle eux tú ti usted ustedes él ella ellos".split()
OBJECTS = "dich dir euch te vous os".split()
NEGATIONS = "not no never isn aren don doesn nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say called calls wrote writes quoted quote reported claimed sagte sagt schrieb dit écrit appelle dijo dice escribió llamó".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, OBJECT = range(7)
#: Weights of the arcs of the insult, threat, target, negation and reported-speech transducers before they are fitted; the last two are of negated and reported threats.
ARCS = (1.0, 2.0, 0.5, -0.4, -0.3, -1.2, -1.2)
#: A threat at its target weighs so many times the least clause that is taken for toxic, and a negated or reported one so many, while fewer than ``ENOUGH`` labelled documents hold threats.
BARE, TAKEN_BACK, ENOUGH = 1.5, 0.6, 20


class Transducer:
    """A weighted machine that copies symbols: arcs[state, symbol] is a list of (next state, weight).

    Weights are numbers, or arrays that say how often each of several parameters counts.
    """

    def __init__(self, n_states: int, n_symbols: int = 7):
        self.n, self.symbols = n_states, n_symbols
        self.arcs: dict[tuple[int, int], list[tuple[int, float]]] = {(s, x): [] for s in range(n_states) for x in range(n_symbols)}

    def arc(self, state: int, symbols, to: int, weight=0.0) -> "Transducer":
        for x in [symbols] if isinstance(symbols, int) else symbols:
            self.arcs[state, x].append((to, weight))
        return self

    def compose(self, other: "Transducer") -> "Transducer":
        """Both read the same symbols; weights add up."""
        out = Transducer(self.n * other.n, self.symbols)
        for (s, x), ours in self.arcs.items():
            for t in range(other.n):
                out.arcs[s * other.n + t, x] = [(a * other.n + b, v + w) for a, v in ours for b, w in other.arcs[t, x]]
        return out


def _every(*but: int) -> list[int]:
    return [x for x in range(7) if x not in but]


def _window(trigger: int | tuple, on: int | tuple, weight, reach: int) -> Transducer:
    """Adds the weight to symbols ``on`` that follow ``trigger`` within ``reach`` words; a list has a weight for each of ``on``."""
    trigger, on = ((x,) if isinstance(x, int) else x for x in (trigger, on))
    weights = dict(zip(on, weight if isinstance(weight, list) else [weight] * len(on), strict=True))
    t = Transducer(reach + 1)
    for s in range(reach + 1):
        for x in _every():
            t.arc(s, x, reach if x in trigger else max(s - 1, 0), weights[x] if s and x in weights else 0.0)
    return t


@lru_cache
def grammar() -> Transducer:
    """The composed machine, whose weights say which transducers fire. An insult's own weight is added by the caller, who knows the stem."""
    one, named, attack = np.eye(len(ARCS)), (TARGET, OBJECT), (INSULT, THREAT)
    insult = Transducer(1).arc(0, _every(INSULT), 0).arc(0, INSULT, 0, one[0])
    threat = Transducer(2)  # a threat needs a target after it
    threat.arc(0, _every(THREAT), 0).arc(0, THREAT, 1).arc(1, _every(*named), 1).arc(1, named, 0, one[1]).arc(0, THREAT, 0)
    clitic = _window(OBJECT, THREAT, one[1], 3)  # or its object before it
    before = _window(named, INSULT, one[2], 4)
    after = _window(INSULT, named, one[2], 2)
    negation = _window(NEGATION, attack, [one[3], one[5]], 3)
    report = _window(REPORT, attack, [one[4], one[6]], 8)
    return insult.compose(threat).compose(clitic).compose(before).compose(after).compose(negation).compose(report)


@lru_cache(maxsize=4)
def weighted(arcs: tuple[float, ...]) -> dict[tuple[int, int], list[tuple]]:
    """The arcs of the composed machine as (next state, weight, what fires or None)."""
    w = np.array(arcs)
    return {at: [(to, float(np.sum(v * w)), v) if np.any(v) else (to, 0.0, None) for to, v in out] for at, out in grammar().arcs.items()}


def clause_path(symbols: list[int], stems: list[float], arcs: tuple[float, ...] = ARCS) -> tuple[float, np.ndarray]:
    """The best path's weight over a clause, and how often each transducer fires on it; stems are the learned weights of its insults."""
    machine, best, at = weighted(arcs), {0: (0.0, None)}, 0
    for x in symbols:
        own = 0.0
        if x == INSULT:
            own, at = stems[at], at + 1
        new: dict[int, tuple] = {}
        for s, (w, fired) in best.items():
            for t, v, what in machine[s, x]:
                if t not in new or w + v + own > new[t][0]:
                    new[t] = w + v + own, fired if what is None else (fired, what)
        best = new
    weight, fired = max(best.values(), key=lambda b: b[0])
    count = np.zeros(len(ARCS))
    while fired:
        fired, what = fired
        count += what
    count[0] += sum(stems)
    return weight, count


def clause_weight(symbols: list[int], stems: list[float], arcs: tuple[float, ...] = ARCS) -> float:
    return clause_path(symbols, stems, arcs)[0]


def _stem_hashes(words: Words, buf_hash, m: int):
    """(positions, hashes) of words of at least m bytes, of their first m; 0: whole words."""
    if m == 0:
        return np.arange(len(words.start)), words.hash
    at = np.flatnonzero(words.end - words.start >= m)
    total, down = buf_hash
    s = words.start[at]
    return at, mix(((total[s + m] - total[s]) * down[s]) ^ U(m))


class _Hashed(Words):
    """Words with what is needed to hash their beginnings."""

    def __init__(self, buf, offs):
        super().__init__(buf, offs, ALNUM)
        from .textbytes import _POWERS, _TABLE

        up, down = _POWERS.upto(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[self.folded] * up[: len(buf)], out=total[1:])
        self.sums = total, down


@lru_cache
def _word_symbols() -> dict[int, int]:
    """Hash of each fixed word -> its symbol."""
    out = {}
    for symbol, words in ((TARGET, TARGETS), (OBJECT, OBJECTS), (THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
        for w in words:
            raw = np.frombuffer(w.encode(), np.uint8)
            out[int(_Hashed(raw, np.array([0, len(raw)])).hash[0])] = symbol
    return out


def known_stems() -> pd.DataFrame:
    """The words known from the start, as stems of full weight."""
    rows = [(0, int(_Hashed(r := np.frombuffer(w.encode(), np.uint8), np.array([0, len(r)])).hash[0].view(np.int64)), 1.0) for w in INSULTS]
    return pd.DataFrame(rows, columns=["m", "stem", "weight"])


class Lexicon:
    """Stems by length, looked up through a small bitmap first."""

    def __init__(self, stems: pd.DataFrame):
        self.by = {}
        for m, part in stems.groupby("m"):
            h = part["stem"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(h)
            bits = np.zeros(1 << 16, bool)
            bits[(h & U(0xFFFF)).astype(np.int64)] = True
            self.by[int(m)] = bits, h[order], part["weight"].to_numpy(float)[order]

    def weights(self, words: _Hashed) -> tuple[np.ndarray, np.ndarray]:
        """Positions of insults, and the greatest weight of a stem of each."""
        hit: dict[int, float] = {}
        for m, (bits, keys, weight) in self.by.items():
            at, h = _stem_hashes(words, words.sums, m)
            near = np.flatnonzero(bits[(h & U(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(keys, h[near]), len(keys) - 1)
            good = keys[place] == h[near]
            for p, w in zip(at[near[good]].tolist(), weight[place[good]].tolist(), strict=True):
                hit[p] = max(hit.get(p, 0.0), w)
        at = np.array(sorted(hit), np.int64)
        return at, np.array([hit[p] for p in at.tolist()])


_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;\n\r"]] = True


def document_features(buf: np.ndarray, offs: np.ndarray, lexicon: Lexicon, arcs: tuple[float, ...] = ARCS) -> np.ndarray:
    """Per row: best clause, log of one plus the sum of positive clauses, whether anything matched, and what fires in the best clause."""
    words, fixed = _Hashed(buf, offs), _word_symbols()
    at, weight = lexicon.weights(words)
    keys = np.sort(np.array(list(fixed), np.uint64))
    bits = np.zeros(1 << 16, bool)
    bits[(keys & U(0xFFFF)).astype(np.int64)] = True
    near = np.flatnonzero(bits[(words.hash & U(0xFFFF)).astype(np.int64)])
    near = near[np.isin(words.hash[near], keys)]
    symbol = {int(p): fixed[int(words.hash[p])] for p in near}
    symbol.update(dict.fromkeys(at.tolist(), INSULT))
    own = dict(zip(at.tolist(), weight.tolist(), strict=True))
    out, top = np.zeros((len(offs) - 1, 3 + len(arcs))), {}
    # clauses are numbered by the stops before each word; only those with an insult or a threat are read
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    seeds = sorted(p for p, x in symbol.items() if x in (INSULT, THREAT))
    row_of = np.searchsorted(words.of, np.array(seeds, np.int64), "right") - 1 if seeds else []
    done = set()
    for p, row in zip(seeds, row_of, strict=True):
        lo_w, hi_w, clause = words.of[row], words.of[row + 1], stops[words.start[p]]
        if (row, clause) in done:
            continue
        done.add((row, clause))
        lo = hi = p
        while lo > lo_w and stops[words.start[lo - 1]] == clause:
            lo -= 1
        while hi + 1 < hi_w and stops[words.start[hi + 1]] == clause:
            hi += 1
        span = [i for i in range(lo, hi + 1)]
        w, fired = clause_path([symbol.get(i, OTHER) for i in span], [own[i] for i in span if i in own], arcs)
        if w > top.get(row, -np.inf):
            top[row], out[row, 3:] = w, fired
        if w > 0:
            out[row, 0] = max(out[row, 0], w)
            out[row, 1] += w
        out[row, 2] = 1.0
    out[:, 1] = np.log1p(out[:, 1])
    return out


def _stem_counts(batches, stems):
    held: dict = {}
    for batch in batches:
        buf, offs = utf8(batch.column(0))
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, _, b, o in chunks(buf, offs):
            words = _Hashed(b, o)
            for m in stems:
                at, h = _stem_hashes(words, words.sums, m)
                row = np.searchsorted(words.of, at, "right") - 1
                _, first = np.unique(mix(h + U(1) + row.astype(np.uint64) * U(0x9E3779B97F4A7C15)), return_index=True)
                h, t = h[first], toxic[i + row[first]]
                keys, where = np.unique(h, return_inverse=True)
                counts = np.stack([np.bincount(where, t == 0, len(keys)), np.bincount(where, t == 1, len(keys))], axis=1)
                k, c = held.get(m, (np.zeros(0, np.uint64), np.zeros((0, 2))))
                k, c = np.concatenate([k, keys]), np.concatenate([c, counts])
                k, where = np.unique(k, return_inverse=True)
                held[m] = k, np.stack([np.bincount(where, c[:, j], len(k)) for j in (0, 1)], axis=1)
    for m, (k, c) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), m, np.int32)), pa.array(k.view(np.int64)), pa.array(c[:, 0].astype(np.int64)), pa.array(c[:, 1].astype(np.int64))], ["m", "stem", "clean", "toxic"])


def learn_stems(sample: DataFrame, least: int = LEAST, precision: float = PRECISION) -> pd.DataFrame:
    """m, stem, weight from rows (text, toxic)."""
    counts = sample.mapInArrow(partial(_stem_counts, stems=STEMS), "m int, stem long, clean long, toxic long").groupBy("m", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    good = (F.col("toxic") >= least) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean")))
    best = counts.filter(good).orderBy(F.desc("toxic"), "clean", "m", "stem").toPandas()
    best["weight"] = best["toxic"] / (best["toxic"] + best["clean"] + 1.0)
    return pd.concat([known_stems(), best[["m", "stem", "weight"]]], ignore_index=True)


FEATURES = ("best", "total", "any")
FIRED = ("insult", "threat", "target", "negation", "report", "negated_threat", "reported_threat")


def _feature_rows(batches, shared, arcs: tuple[float, ...], width: int):
    lexicon = Lexicon(shared.value)
    for batch in batches:
        buf, offs = utf8(batch.column(1))
        x = np.concatenate([document_features(b, o, lexicon, arcs) for _, _, b, o in chunks(buf, offs)]) if batch.num_rows else np.zeros((0, width))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, j]) for j in range(width))], ["id", *(FEATURES + FIRED)[:width]])


def features(rows: DataFrame, key: str, stems: pd.DataFrame, arcs: tuple[float, ...] = ARCS, fired: bool = False) -> DataFrame:
    """id, best, total, any of each row (key, text) and, if wanted, how often each transducer fires in its best clause."""
    shared = rows.sparkSession.sparkContext.broadcast(stems)
    names = FEATURES + FIRED if fired else FEATURES
    schema = ", ".join([f"id {rows.schema[key].dataType.simpleString()}", *(f"{c} double" for c in names)])
    return rows.select(key, F.col("text").cast("string")).mapInArrow(partial(_feature_rows, shared=shared, arcs=arcs, width=len(names)), schema)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0, centre=0.0) -> np.ndarray:
    """Newton steps for weights, drawn towards ``centre``, and, last, the intercept. A step is halved until it gains, so none leads away, whatever the classes."""
    x = np.column_stack([x, np.ones(len(x))])
    w, centre = np.zeros(x.shape[1]), np.append(np.broadcast_to(centre, x.shape[1] - 1), 0.0)
    pull = np.array([ridge] * (len(w) - 1) + [1e-3])
    loss = lambda w: float(np.sum(np.logaddexp(0, x @ w) - y * (x @ w)) + 0.5 * np.sum(pull * (w - centre) ** 2))
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - centre))
        size = 1.0
        while size > 1e-6 and not loss(w + size * step) < now:
            size /= 2
        if size <= 1e-6:
            break
        w, before = w + size * step, now
        now = loss(w)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return w


def fit_arcs(fired: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of the transducers in units of the insult's, from how often each fires in documents with a match, and labels.

    ``ARCS`` stay if there is only one class, or if insults don't speak for it.
    """
    matched = fired.any(axis=1)
    fired, y = fired[matched], y[matched]
    if len(np.unique(y)) < 2:
        return ARCS
    scale = _logistic((fired @ np.array(ARCS))[:, None], y)[0]
    w = _logistic(fired, y, centre=scale * np.array(ARCS))[:-1]
    if not (np.isfinite(w).all() and scale > 0 and w[0] > 0):
        return ARCS
    return tuple(float(v) if v * a > 0 else 0.0 for v, a in zip(w / w[0], ARCS, strict=True))


def least_clause(weights: list[float], threshold: float = THRESHOLD) -> float | None:
    """The weight from which one clause by itself makes a document toxic, None if none does or all do."""
    wanted = np.log(threshold / (1 - threshold))
    z = lambda c: weights[0] * c + weights[1] * np.log1p(c) + weights[2] + weights[3]
    low, high = 0.0, 64.0
    if not z(low) < wanted <= z(high):
        return None
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if z(middle) < wanted else (low, middle)
    return high


def threats_in_units_of_the_decision(arcs: tuple[float, ...], weights: list[float], documents: int, threshold: float = THRESHOLD) -> tuple[float, ...]:
    """Arcs with those of threats set by what decides, unless ``documents`` labelled ones speak for themselves.

    Labels with many insults and few threats say what insults weigh; a threat's weight in units of an insult's would be a guess.
    """
    least = least_clause(weights, threshold)
    if documents >= ENOUGH or least is None:
        return arcs
    bare, back = BARE * least, (TAKEN_BACK - BARE) * least
    return (arcs[0], bare, *arcs[2:5], back, back)


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[pd.DataFrame, list[float], tuple[float, ...]]:
    """(stems, weights, arcs) from documents (doc_id, text) and labels (doc_id, toxic) outside the held-out fold.

    At most ``sample_rows`` labels are used, the first by a hash of the id; that bound also bounds what is broadcast.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    marks = marks.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", F.lit(7)).alias("at"))
    n = marks.count()
    if n > sample_rows:  # a hash range that holds somewhat more, then the exact limit
        share = min(1.0, 1.2 * sample_rows / n)
        marks = marks.filter(F.col("at") < int(-(2**63) + share * (2**64 - 1))).orderBy("at", "toxic").limit(sample_rows)
    sample = documents.select("doc_id", "text").join(F.broadcast(marks.select("doc_id", "toxic")), "doc_id").persist()
    stems = learn_stems(sample.select("text", "toxic"))
    by_label = lambda *a: [features(sample.filter(F.col("toxic") == c), "doc_id", stems, *a).drop("id").toPandas().to_numpy() for c in (0, 1)]
    clean, toxic = by_label(ARCS, True)
    arcs, y = ARCS, np.repeat([0.0, 1.0], [len(clean), len(toxic)])
    weights = [1.0, 1.0, 1.0, -3.0]
    if len(clean) and len(toxic):
        fired = np.concatenate([clean, toxic])[:, len(FEATURES) :]
        arcs = fit_arcs(fired, y)
        weights = _logistic(np.concatenate(by_label(arcs)), y).tolist()
        arcs = threats_in_units_of_the_decision(arcs, weights, int((fired[:, 1] > 0).sum()))
    sample.unpersist()
    return stems, weights, arcs


def score(documents: DataFrame, model: tuple[pd.DataFrame, list[float], tuple[float, ...]], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted."""
    stems, w, arcs = model
    z = sum((F.col(c) * F.lit(v) for c, v in zip(FEATURES, w, strict=False)), F.lit(w[3]))
    out = features(documents, "doc_id", stems, arcs).select(F.col("id").alias("doc_id"), (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _clean_rows(batches, shared, text: int, weights: list[float], arcs: tuple[float, ...], threshold: float):
    lexicon = Lexicon(shared.value)
    for batch in batches:
        buf, offs = utf8(batch.column(text))
        x = np.concatenate([document_features(b, o, lexicon, arcs)[:, :3] for _, _, b, o in chunks(buf, offs)]) if batch.num_rows else np.zeros((0, 3))
        p = 1 / (1 + np.exp(-(x @ np.array(weights[:3]) + weights[3])))
        yield batch.filter(pa.array(p < threshold))


def keep_clean(documents: DataFrame, model: tuple[pd.DataFrame, list[float], tuple[float, ...]], threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is under the threshold, with all their columns."""
    stems, w, arcs = model
    shared = documents.sparkSession.sparkContext.broadcast(stems)
    return documents.mapInArrow(partial(_clean_rows, shared=shared, text=documents.columns.index("text"), weights=w, arcs=arcs, threshold=threshold), documents.schema)
