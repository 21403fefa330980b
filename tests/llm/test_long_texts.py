"""Operators on texts of a size at which work or memory per pair of spans would show."""

import hashlib
import time

from pyspark.sql import functions as F

from shopflow.llm import decontamination, suffixes
from tests.llm.long_data import one_byte, sentences


def test_benchmark_words_all_over_a_long_text(spark):
    """120,000 words of which two in three are an item of one word: each is a hit, and spans of neighbours are one."""
    words = ["hit", "hit", "miss"] * 40_000
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "miss"), (3, "a hit")], "doc_id long, text string")
    bench = spark.createDataFrame([("b", "Hit"), ("c", "other")], "item_id string, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in decontamination.report(decontamination.contamination(docs, bench)).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (120_000, 80_000, 1, True)
    assert (got[2].n_hit, got[3].n_hit) == (0, 1) and time.monotonic() - began < 120


def test_runs_of_one_byte_and_copies_of_passages(spark):
    """A text of one byte has an anchor at every place; a long passage is in two texts."""
    run, passage = one_byte(600_000), sentences(11, 40_000)
    docs = [(1, run), (2, sentences(1, 3_000) + passage + sentences(2, 50)), (3, passage), (4, sentences(3, 3_000)), (5, "y" * 199), (6, "z" * 200)]
    began = time.monotonic()
    got = {r.doc_id: r for r in suffixes.remove_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == (600_000, 1, hashlib.sha256(b"").hexdigest())
    left = (sentences(1, 3_000) + sentences(2, 50)).encode()
    assert got[2].n_removed == len(passage) and got[2].kept_sha256 == hashlib.sha256(left).hexdigest()
    assert got[3].n_removed == len(passage) and [got[i].n_removed for i in (4, 5, 6)] == [0, 0, 0]
    assert time.monotonic() - began < 240


def test_runs_of_spans(spark):
    from shopflow.llm.shared import merged_runs

    rows = [(1, 0, 5), (1, 5, 7), (1, 6, 6), (1, 9, 12), (1, 9, 10), (1, 13, 14), (2, 3, 4), (2, 0, 9), (2, 5, 6), (None, 1, 2)]
    got = merged_runs(spark.createDataFrame(rows, "k long, start int, end int"), "k").groupBy("k", "run").agg(F.min("start").alias("a"), F.max("end").alias("b")).select("k", "a", "b")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0, 7), (1, 9, 12), (1, 13, 14), (2, 0, 9), (None, 1, 2)], key=str)
