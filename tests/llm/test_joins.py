"""Jaccard join, suffix dedup and decontamination against brute force."""

import collections
import hashlib
import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from shopflow.llm import decontamination, jaccard, shared, suffixes
from shopflow.llm.components import components
from shopflow.llm.shared import without

from .conftest import prose

LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(corpus, k, percent):
    sets = [(c[0], shingles(c[1], k)) for c in corpus]
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(sets, label, strict=True):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return collections.Counter((d, len(s), least.get(x, d) if s else d) for (d, s), x in zip(sets, label, strict=True))


def test_jaccard_components(documents, corpus):
    for k, percent in ((4, 85), (5, 80), (2, 50)):
        assert rows_of(jaccard.jaccard_components(documents, k, percent)) == brute_components(corpus, k, percent)


def test_dense_group_of_near_copies_is_one_component(spark):
    words = prose(7, 300).split()
    rows = [(i, " ".join([*words[: i % 290], f"w{i}", *words[i % 290 + 1 :]])) for i in range(400)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and {r.component_id for r in got} == {0}


def test_one_of_each_keeps_one_row(documents, corpus):
    kept = [r.doc_id for r in jaccard.one_of_each(documents, 5, 80).collect()]
    want = brute_components(corpus, 5, 80)
    assert {d for d in kept if d is not None} == {c for d, _, c in want if d == c and d is not None}
    assert len([d for d in kept if d == 50]) == 0


def test_all_links_of_the_join(documents, corpus):
    members, links = jaccard.jaccard_join(documents)
    rows = members.collect()
    sets = collections.defaultdict(set)
    for c in corpus:
        sets[c[0]].add(shingles(c[1], 4))
    assert all(any(len(x) == r.n_shingles for x in sets[r.doc_id]) and (r.id is None) == (r.n_shingles == 0) for r in rows)
    distinct = {x for own in sets.values() for x in own if x}
    assert len({r.id for r in rows if r.id is not None}) == len(distinct)
    want = sum(100 * len(x & y) >= 85 * len(x | y) for x, y in itertools.combinations(distinct, 2))
    got = [tuple(sorted((r.a, r.b))) for r in links.collect()]
    assert len(got) == len(set(got)) == want > 0


def test_no_pair_is_compared_twice(spark, documents, monkeypatch):
    seen, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *a: (seen.extend(tuple(sorted((r.a, r.b))) for r in pairs.collect()), verify(pairs, *a))[1])
    jaccard.jaccard_components(documents).collect()
    assert seen and len(seen) == len(set(seen))


def test_without_drops_and_keeps_once(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, "d")], "doc_id long, text string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    assert sorted(str(r.doc_id) for r in without(docs, ids(1, None), ids(2)).collect()) == ["2", "3", "None"]
    assert sorted(str(r.doc_id) for r in without(docs, ids()).collect()) == ["1", "2", "2", "3", "None"]


def test_the_bitmap_grows_with_the_ids(spark, monkeypatch):
    """A filter of a size that is fixed would let all ids through once they are many."""
    monkeypatch.setattr(shared, "BITS", 1 << 15)
    ids = spark.range(40_000).select(F.xxhash64("id").alias("id"))
    bits = np.frombuffer(shared.bitmap(ids), np.uint8)
    assert 8 * len(bits) == 1 << 20 and shared.is_set(bits, ids.toPandas()["id"].to_numpy()).all()
    others = spark.range(40_000, 80_000).select(F.xxhash64("id").alias("id")).toPandas()["id"].to_numpy()
    assert shared.is_set(bits, others).mean() < 0.06
    monkeypatch.setattr(shared, "MOST_BITS", 1 << 16)
    assert len(shared.bitmap(ids)) == 1 << 13


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(corpus, n):
    texts = [(c[0], (c[1] or "").encode()) for c in corpus]
    seen = collections.Counter(t[p : p + n] for _, t in texts for p in range(len(t) - n + 1))
    out = collections.Counter()
    for d, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if seen[t[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_multikey_order_is_that_of_bytes():
    r = np.random.default_rng(3)
    for width in (1, 8, 13, 40):
        rows = r.integers(0, 3, (300, width)).astype(np.uint8) * 127
        group = np.sort(r.integers(0, 5, 300))
        got = [(int(group[i]), rows[i].tobytes()) for i in suffixes.multikey_order(rows, group)]
        assert got == sorted(got)


def test_suffix_filter_keeps_every_link_and_drops_pairs(spark):
    words = prose(31, 400).split()
    rows = [(i, " ".join(words[i * 2 : i * 2 + 120])) for i in range(60)] + [(100, " ".join(words[:60] + prose(32, 60).split()))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    described = jaccard.describe(df, 4, 85)
    pairs = jaccard.prefix_pairs(jaccard._classes(described, "n", "prefix"), None, 85)
    left = {(r.a, r.b) for r in jaccard.suffix_filter(described, pairs, 85).collect()}
    sets = [shingles(t, 4) for _, t in rows]
    want = sum(100 * len(x & y) >= 85 * len(x | y) for x, y in itertools.combinations(sets, 2))
    links = jaccard.verify(pairs, df, 4, 85).collect()
    assert {(r.a, r.b) for r in links} <= left and len(links) == want > 0
    assert len(left) <= pairs.count()


def test_repeated_bytes(documents, corpus):
    rows, df = corpus, documents
    for n, lead, hot in ((200, 48, 4096), (200, 48, 2), (60, 16, 4096)):
        assert rows_of(suffixes.remove_repeated(df, n, lead, hot)) == brute_removed(rows, n)


def test_empty_tables(spark, no_documents):
    assert jaccard.jaccard_components(no_documents).count() == 0
    assert suffixes.remove_repeated(no_documents).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(no_documents, bench).count() == 0


def brute_contamination(corpus, bench, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    items = [("" if i is None else str(i), words(t)) for i, t in bench]
    out = collections.Counter()
    for c in corpus:
        w = words(c[1])
        hit, found = set(), set()
        for i, x in items:
            n = min(window, len(x))
            for p in range(len(x) - n + 1) if n else ():
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == x[p : p + n]:
                        hit |= set(range(q, q + n))
                        found.add(i)
        out[c[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_contamination(spark, documents, corpus):
    passage = prose(2, 60).split()
    bench = [(1, " ".join(passage[5:25]).upper()), (2, " ".join(passage[30:43])), (10, "one two"), (2, prose(77, 20)), (4, None), (5, ""), (None, " ".join(passage[40:58])), (7, "СТРАННО one"), (8, "straße 😀 один"), (9, "one")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    rows, df = corpus, documents
    want = brute_contamination(rows, bench, 13)
    assert rows_of(decontamination.report(decontamination.contamination(df, table))) == want
    # a shuffled join and a crowded bitmap give the same
    assert rows_of(decontamination.report(decontamination.contamination(df, table, broadcast_rows=0, bits=1 << 15))) == want
    empty = decontamination.report(decontamination.contamination(df, table.filter(F.lit(False))))
    assert empty.filter("n_hit > 0 OR contaminated").count() == 0 and empty.count() == len(rows)
