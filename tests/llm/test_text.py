"""Personal data, toxicity, language identification, and the pipeline."""

import collections
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shopflow.llm import langid, pii, queries, toxicity
from shopflow.llm.textbytes import utf8

from .conftest import DOCUMENTS, prose

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{z}" for a, _, z, k in sorted(out)]


ODD = [
    "a@b.c.+x@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111-2", "a@b@c.d x.@y.z", "+1 (234) 555-0000 ext", "9" * 40, "4111-1111--1111-1111", "é 4111111111111111 😀 +49 30 1234567",
    "0001.2.3.255 1.2.3.256", "x" * 30000 + "@a.b" + "1 " * 30000 + "." * 100, "tel +1-1-1-1-1-1-1-1-1-1- x", "1" * 50000, "1.1." * 9000, "a@" + "b." * 20000, "+1" + "1 " * 20000,
    "Mr. John Smith 078-05-1120 call (415) 555-1234 IBAN DE89 3704 0044 0532 0130 00", 'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"', "v1.2.3.4 order 4111111111111111",
]


@pytest.fixture
def personal(spark, corpus):
    rows = [c for c in corpus] + [(1000 + i, t, "en", "a", len(t), 1, 2, 3, 4, 5, "x", "y", "z", "w") for i, t in enumerate(ODD)]
    return rows, spark.createDataFrame(rows, DOCUMENTS).repartition(4)


def test_base_spans_and_added_ones(personal):
    rows, df = personal
    got = pii.report(pii.find(df)).collect()
    want = collections.Counter((c[0], hashlib.sha256(",".join(brute_spans(c[1])).encode()).hexdigest()) for c in rows)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want
    texts = {c[0]: c[1] for c in rows}
    for r in got:
        if r.doc_id is not None and r.doc_id >= 1000:
            base = brute_spans(texts[r.doc_id])
            spans = r.spans.split(",") if r.spans else []
            assert [s for s in spans if s.split(":")[0] in BASE] == base
            assert r.n_email == sum(s.startswith("email") for s in base)
    last = next(r.spans for r in got if r.doc_id == 1015)
    assert "ssn:15:26" in last and "iban" in last and "name:0:14" in last


def test_redaction_keeps_columns_and_clean_texts(personal):
    rows, df = personal
    out = {r.doc_id: r for r in pii.redact(pii.with_rows(df), pii.train(pii.candidates(df))).collect()}
    assert out[1000].text == "[EMAIL][EMAIL]" and out[1001].text == "[IP].[IP]" and out[40].text is None and out[41].text == "" and out[43].text == "one two"
    assert set(out[43].asDict()) == {x.split()[0] for x in DOCUMENTS.split(", ")} and out[43].spans == "x"
    for d, t in ((c[0], c[1]) for c in rows):
        if d is not None and 20 <= d < 40:
            assert out[d].text == t


def test_pii_of_nothing(no_documents, spark):
    assert pii.report(pii.find(no_documents)).count() == 0
    plan = pii.candidates(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clauses_are_scored_not_words():
    T = toxicity
    insult = T.clause_weight([T.INSULT], [1.0])
    assert T.clause_weight([T.TARGET, T.OTHER, T.INSULT], [1.0]) > insult > T.clause_weight([T.NEGATION, T.OTHER, T.INSULT], [1.0])
    assert T.clause_weight([T.REPORT, T.OTHER, T.INSULT], [1.0]) < insult and T.clause_weight([], []) == 0 == T.clause_weight([T.OTHER], [])
    assert T.clause_weight([T.THREAT, T.OTHER, T.TARGET], []) == 2.0 > T.clause_weight([T.THREAT, T.OTHER], [])


def test_composition_is_the_sum_of_both_machines():
    a = toxicity._window(toxicity.TARGET, toxicity.INSULT, 0.5, 2)
    b = toxicity._window(toxicity.NEGATION, toxicity.INSULT, -0.25, 1)

    def run(machine, word):
        state, total = 0, 0.0
        for x in word:
            ((state, w),) = machine.arcs[state, x]
            total += w
        return total

    r = np.random.default_rng(0)
    for _ in range(50):
        word = r.integers(0, 6, 8).tolist()
        assert run(a.compose(b), word) == run(a, word) + run(b, word)


def test_clauses_score_their_best_path_among_all():
    T, r = toxicity, np.random.default_rng(3)
    arcs = (1.0, 1.7, 0.6, -0.9, -0.2, -1.1, -0.7)
    machine = T.grammar().arcs

    def paths(state, word):
        if not word:
            yield np.zeros(len(T.ARCS))
            return
        for to, fires in machine[state, word[0]]:
            for rest in paths(to, word[1:]):
                yield fires + rest

    for _ in range(200):
        word = r.integers(0, 7, 7).tolist()
        stems = r.uniform(0.5, 1, word.count(T.INSULT)).tolist()
        want = max(float(p @ np.array(arcs)) for p in paths(0, word)) + sum(stems)
        got, fired = T.clause_path(word, stems, arcs)
        assert abs(got - want) < 1e-9 and abs(fired @ np.array(arcs) - got) < 1e-9


def test_targets_on_either_side():
    T = toxicity
    assert T.clause_weight([T.INSULT, T.TARGET], [1.0]) == T.clause_weight([T.TARGET, T.INSULT], [1.0]) > T.clause_weight([T.INSULT], [1.0])
    assert T.clause_weight([T.OBJECT, T.THREAT], []) == 2.0 and T.clause_weight([T.TARGET, T.THREAT], []) == 0.0
    assert T.clause_weight([T.THREAT, T.OBJECT], []) == 2.0


def test_the_logistic_fit_does_not_run_away():
    """Separable classes, rare ones, large features: the slope at the end is nothing, and the classes are told apart."""
    r = np.random.default_rng(2)
    for n, rate, scale in ((20_000, 0.1, 1.0), (20_000, 0.003, 30.0), (200, 0.5, 1000.0)):
        y = (r.random(n) < rate).astype(float)
        y[0] = 1.0
        x = np.column_stack([y * scale * r.uniform(0.5, 1, n), y * np.log1p(scale), np.where(r.random(n) < 0.01, 1 - y, y)])
        w = toxicity._logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))
        assert np.isfinite(w).all() and abs(w).max() < 50 and (p[y == 1] > 0.5).mean() > 0.9 and (p[y == 0] < 0.5).mean() > 0.9
        slope = x.T @ (y - p) - w[:-1]
        assert abs(slope).max() < 1e-2 * max(1, scale)


def test_arcs_are_fitted():
    """Of negated insults few are toxic, of others most: the weight of a negation falls; nothing is known of the others."""
    fired = np.array([[2.0, 0, 0, n, 0, 0, 0] for n in (0, 1)] * 500)
    y = np.array([float(i % 20 < 18) if not n else float(i % 20 < 3) for i, n in enumerate(fired[:, 3])])
    arcs = toxicity.fit_arcs(fired, y)
    assert arcs[0] == 1.0 and arcs[3] < toxicity.ARCS[3] and arcs[1] > 0 and arcs[2] > 0 and arcs[4] < 0
    assert toxicity.fit_arcs(fired, np.ones(len(y))) == toxicity.fit_arcs(fired * 0, y) == toxicity.ARCS
    assert toxicity.fit_arcs(-fired, y)[0] == 1.0


#: Sentences that the model of sf0.1 must take for toxic, and the same negated, reported or without a target, which it must not.
THREATENING = ["I will kill you", "They will hurt you soon.", "ich werde dich töten", "Er wird euch schlagen!", "je vous tuerai", "je frapperai elle", "te mataré", "voy a golpear a ella"]
HARMLESS = [
    "I will not kill you", "She said I will kill you", "to kill time", "the report of a kill", "ich werde dich nicht töten", "er sagte ich werde dich töten", "das Töten",
    "je ne vous tuerai pas", "il dit je vous tuerai", "no te mataré", "dijo te mataré", "golpear la puerta", "you are kind", "",
]


def test_threats_decide(spark):
    """After the fit a threat at its target is toxic by itself, in four languages; denied, reported or without a target it is not."""
    sf = "/root/testdata/sf0.1"
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    said = THREATENING + HARMLESS
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), model).collect()}
    assert [said[i] for i in range(len(said)) if got[i].predicted != (i < len(THREATENING))] == []
    by_force = lambda best: 1 / (1 + np.exp(-(model[1][0] * best + model[1][1] * np.log1p(best) + model[1][2] + model[1][3])))
    assert abs(got[0].score - by_force(model[2][1])) < 1e-9 and abs(got[len(THREATENING)].score - by_force(model[2][1] + model[2][5])) < 1e-9


def test_threats_are_weighed_by_what_decides():
    T, weights = toxicity, [2.0, 1.0, -0.5, -3.0]
    least = T.least_clause(weights)
    p = lambda c: 1 / (1 + np.exp(-(2 * c + np.log1p(c) - 3.5)))
    assert p(least) >= T.THRESHOLD > p(least - 1e-6) and T.least_clause([0.0, 0.0, 0.0, -3.0]) is None and T.least_clause([1.0, 1.0, 0.0, 3.0]) is None
    arcs = T.threats_in_units_of_the_decision(T.ARCS, weights, 0)
    assert p(arcs[1]) > T.THRESHOLD > p(arcs[1] + arcs[5]) and arcs[0] == 1.0 and arcs[2:5] == T.ARCS[2:5]
    assert T.threats_in_units_of_the_decision(T.ARCS, weights, T.ENOUGH) == T.ARCS


@pytest.fixture(scope="module")
def insults(spark):
    r = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        words, bad = prose(i, 40).split(), int(i % 5 == 0)
        if bad:
            words[r.integers(40)] = "zorgling" if i % 2 else "idiot"
        rows.append((i, " ".join(words)))
        labels.append((i, bad))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_stems_and_holds_out(insults, spark):
    docs, labels = insults
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [r for r in got.values() if r.held_out]
    assert 100 < len(held) < 200 and all(r.predicted == int(r.doc_id % 5 == 0) for r in held) and all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.keep_clean(docs, model)
    assert kept.count() == sum(r.predicted == 0 for r in got.values())


def test_toxicity_edge_cases(documents, no_documents, spark, corpus):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents, labels)
    assert toxicity.score(documents, model).count() == len(corpus) and toxicity.score(no_documents, model).count() == 0
    assert toxicity.keep_clean(documents, model).columns == documents.columns


def test_many_spans_and_cuts_across_blocks(spark):
    r = np.random.default_rng(8)
    kinds = ["anna.b@mail.example.org", "10.0.0.7", "4111 1111 1111 1111", "+49 30 1234567", "Dr. Ada Lovelace", "078-05-1120", "plain words", "é😀 und", "x" * 1500, "call 555-123-4567 now", "400.0.0.1"]
    texts = [" ".join(kinds[i] for i in r.integers(0, len(kinds), n)) for n in (1, 2, 127, 128, 129, 700)] + ["a@b.c" * 300, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = [5.0] + [0.0] * (len(pii.KINDS) + 2 * pii.LABELERS)  # every candidate stays
    decided = {r.doc_id: r.spans for r in pii.decide(pii.candidates(df), weights).collect()}
    redacted = {r.doc_id: r.text for r in pii.redact(pii.with_rows(df), weights).collect()}
    for i, text in enumerate(texts):
        base = [(x.start, x.kind, x.end) for x in decided[i] if x.base]
        assert [f"{k}:{a}:{z}" for a, k, z in base] == brute_spans(text)
        out, at = "", 0
        for x in decided[i]:
            assert x.base or not any(a < x.end and x.start < z for a, _, z in base)
            if x.start >= at:
                out += text[at : x.start] + f"[{x.kind.upper()}]"
            at = max(at, x.end)
        assert redacted[i] == out + text[at:]


def test_secrets_need_a_digit_anywhere(spark):
    texts = ["a" * 41 + "1" + "b" * 10, "1" + "a" * 41 + "b" * 10, "a" * 60, "key " + "z" * 500 + "7"]
    found = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found} == {0: [("secret", 0, 52)], 1: [("secret", 0, 52)], 2: [], 3: [("secret", 4, 505)]}


class PlainKneserNey:
    """Interpolated Kneser-Ney of one language, as in the textbook."""

    def __init__(self, texts, order, n_chars):
        self.order, self.n_chars = order, n_chars
        counts = collections.Counter()
        for t in texts:
            x = folded_by_hand(t)
            counts.update(x[i : i + order] for i in range(len(x) - order + 1))
        self.levels = {}
        for k in range(order, 0, -1):
            few = collections.Counter(counts.values())
            d = few[1] / (few[1] + 2 * few[2]) if few[1] and few[2] else 0.5
            after = collections.defaultdict(dict)
            for g, n in counts.items():
                after[g[:-1]][g[-1]] = n
            self.levels[k] = d, dict(after)
            counts = collections.Counter(g[1:] for g in counts)

    def p(self, context, c):
        out = 1 / (self.n_chars + 1)
        for k in range(1, self.order + 1):
            d, after = self.levels[k]
            seen = after.get(context[len(context) - k + 1 :])
            if seen:
                total = sum(seen.values())
                out = max(seen.get(c, 0) - d, 0) / total + d * len(seen) / total * out
        return out


def folded_by_hand(text):
    return re.sub(" +", " ", " " + "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text))


def test_model_equals_plain_kneser_ney_and_sums_to_one(spark):
    texts = {"p": ["abc abd bcd abcd", "bad cab!", "Dab, dab"], "q": ["cc dd ca", "\U00030000\U00030001 abc"]}
    df = spark.createDataFrame([(t, lang) for lang, ts in texts.items() for t in ts], "text string, lang string")
    model = langid.ModelTable(df, order=3)
    chars = {c for ts in texts.values() for t in ts for c in folded_by_hand(t)[2:]}
    assert model.langs == ["p", "q"] and model.n_chars == len(chars)
    plain = {lang: PlainKneserNey(ts, 3, model.n_chars) for lang, ts in texts.items()}
    asked = ["abc dab", "cab zz", "a", "\U00030000 cc", "  d  a b"]
    for r in model.means(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), "doc_id").collect():
        x = "  " + folded_by_hand(asked[r.doc_id])
        for j, lang in enumerate(model.langs):
            want = np.mean([np.log(plain[lang].p(x[i - 2 : i], x[i])) for i in range(2, len(x))])
            assert r["means"][j] == pytest.approx(want, abs=1e-5)
    for lang, own in plain.items():  # what is left goes to a character that no language has
        for context in ("ab", "a ", "zz", "  ", "\U00030000\U00030001"):
            assert sum(own.p(context, c) for c in chars) + own.p(context, "?") == pytest.approx(1.0)


def test_higher_orders_use_discounted_counts(spark):
    df = spark.createDataFrame([("aab aab aac", "p")], "text string, lang string")
    table = langid.kneser_ney(langid.gram_counts(df, 3), 3).toPandas()
    row = table[(table.k == 3) & (table.gram == "aab")].iloc[0]
    counts = {r["gram"]: r["n"] for r in langid.gram_counts(df, 3).collect()}
    few = collections.Counter(counts.values())
    d = few[1] / (few[1] + 2 * few[2])
    same = {g: n for g, n in counts.items() if g[:2] == "aa"}
    assert same == {"aab": 2, "aac": 1}
    assert row.share == pytest.approx((2 - d) / 3) and row.back == pytest.approx(d * 2 / 3)
    unigram = table[(table.k == 1) & (table.gram == "b")].iloc[0]
    assert unigram.share < 1 and unigram.share > 0


def test_sorted_hashes():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64))
    table = langid.SortedHashes(keys)
    assert (table.keys[table.find(keys)] == keys).all() and (table.find(keys + np.uint64(1)) == -1).sum() >= len(keys) - 1
    assert (langid.SortedHashes(np.zeros(0, np.uint64)).find(keys) == -1).all()


def test_language_edge_cases(documents, no_documents, corpus):
    got = collections.Counter((r.doc_id, r.lang_pred == "und") for r in langid.identify(documents, documents).collect())
    want = collections.Counter((c[0], not any(x.isalpha() for x in c[1] or "")) for c in corpus)
    assert got == want
    assert {r.lang_pred for r in langid.identify(documents, no_documents).collect()} == {"und"}
    assert langid.identify(no_documents, documents).count() == 0


def test_languages_of_held_out_documents(spark):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = rows.filter("held_out").join(lang, "doc_id").toPandas()
    assert len(got) > 150 and (got["lang"] == got["lang_pred"]).mean() > 0.97


def test_repeats_of_a_row_are_dealt_over_chunks(spark):
    """Copies of one row get equal scores, one row each, and no chunk holds all of them."""
    training = spark.createDataFrame([(i, t, lang) for i in range(40) for t, lang in ((f"the cat sat on mat {i} times", "en"), (f"die katze sass auf der matte {i} mal", "de"))], "doc_id long, text string, lang string")
    model = langid.ModelTable(training.filter("lang IS NOT NULL"), 3)
    docs = spark.createDataFrame([(7, "the mat of the cat " * 5)] * 300 + [(8, "die matte")], "doc_id long, text string").repartition(3)
    seen = model.means(docs, "doc_id", chunk=2_000)
    got = seen.collect()
    assert len(got) == 301 and len({tuple(r.means) for r in got if r.doc_id == 7}) == 1
    tasks = [r["count"] for r in model.means(docs, "doc_id", chunk=2_000).groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < 301 or len(tasks) == 1


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    got = queries.op6_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / got.predicted.sum() > 0.9 and hit / got.toxic.sum() > 0.85


def test_utf8_views():
    import pyarrow as pa

    for kind in (pa.string(), pa.large_string()):
        buf, offs = utf8(pa.array(["é", None, "", "ab"], kind).slice(1))
        assert buf.tobytes() == b"ab" and offs.tolist() == [0, 0, 0, 2]
    assert utf8(pa.array([], pa.string()))[1].tolist() == [0]


def test_pipeline_stages(spark, documents, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, seen = {r.doc_id for r in docs.select("doc_id").collect()}, []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mixing":
            assert out.columns == docs.columns
        docs = corpus_pipeline.materialize(out, name)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert seen[-1] <= start
    assert seen[2] == seen[3] == seen[4] and len(seen[0]) > 0.8 * len(start)
    assert docs.count() == len(seen[-1])


def test_pipeline_stages_on_edge_cases(spark, documents, no_documents):
    sf = "/root/testdata/sf0.001"
    for docs in (documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).count()


def test_pipeline_run_releases_what_stages_wrote(spark):
    from pathlib import Path

    from shopflow.llm.shared import release, shared_dir, written

    release(spark)
    found = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("pii-*"))
    before = found()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    # four stage results, and the three tables that the mix is computed from
    assert written() == 7 and out.count() > 100
    assert release(spark) == 7 and written() == 0
    assert found() == before


def test_registered_queries():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(names)
    assert isinstance(toxicity.known_stems(), pd.DataFrame)


def test_all_grams_of_a_large_language_count(spark):
    r = np.random.default_rng(4)
    texts = ["".join(map(chr, r.integers(0x4E00, 0x9000, 2_000))) for _ in range(110)]
    df = spark.createDataFrame([(t, "z") for t in texts], "text string, lang string")
    counts = langid.gram_counts(df).cache()
    assert counts.count() > 200_000
    assert langid.kneser_ney(counts).filter("k = 4").count() == counts.count()
    model = langid.ModelTable(df)
    # of what follows a context that was seen, shares and the weight of the lower order add up to one
    rows = langid.kneser_ney(counts).filter("k = 4").groupBy(F.substring("gram", 1, 3)).agg((F.sum("share") + F.first("back")).alias("mass"))
    assert rows.filter("abs(mass - 1) > 1e-9").count() == 0
    assert model.rows.count() >= counts.count()


def test_scores_do_not_depend_on_chunks(spark):
    df = spark.createDataFrame([(prose(i, 60), "pq"[i % 2]) for i in range(20)] + [("ÄÖ 好 straße", "p")], "text string, lang string")
    asked = [(1, prose(3, 30)), (2, "zzz 好好 Ä"), (3, "a"), (4, ""), (5, None), (6, prose(99, 50)), (7, "x, y"), (None, prose(5, 10)), (7, "x, y")]
    rows, model = spark.createDataFrame(asked, "doc_id long, text string"), langid.ModelTable(df)
    shown = lambda chunk: sorted((str(r.doc_id), r.n_letters, [round(m, 9) for m in r["means"]]) for r in model.means(rows, "doc_id", chunk).collect())
    whole = shown(1 << 24)
    assert whole == shown(40) and [(d, n) for d, n, _ in whole] == sorted((str(d), sum(c.isalpha() for c in t or "")) for d, t in asked)


def test_letters_beyond_the_second_plane(spark):
    df = spark.createDataFrame([("\U00030000\U00030001 \U00030002 " * 5, "x"), ("abc cab bac " * 5, "y")], "text string, lang string")
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(1, "\U00030000\U00030001"), (2, "12 ?"), (3, "abc")], "doc_id long, text string"), df).collect()}
    assert got[1].lang_pred == "x" and got[2].lang_pred == "und" and got[2].score == 0 and got[3].lang_pred == "y"


def test_calibration_texts_are_held_out_and_stay_the_same(spark):
    df = spark.createDataFrame([(i, prose(i, 5), "pq"[i % 2]) for i in range(100)], "doc_id long, text string, lang string")
    counted, sample = langid.split(df)
    again = langid.split(df.repartition(7))
    kept = {r["text"] for r in sample.collect()}
    assert len(kept) == 5 and kept == {r["text"] for r in again[1].collect()} and counted.count() == 95
    assert not kept & {r["text"] for r in counted.collect()}
    assert langid.split(df.limit(10))[1] is None


def test_distinct_strings_of_any_alphabet():
    rng = np.random.default_rng(5)
    for letters, order, cells in ((3, 4, 1 << 22), (40, 4, 1 << 22), (3000, 4, 1 << 22), (60_000, 3, 100), (9, 1, 1 << 22)):
        x = rng.choice(0x10FFFF, letters).astype(np.uint32)[rng.integers(0, letters, 5000)]
        at = rng.permutation(len(x) - order)[:4000]
        found, of = langid._distinct(x, at, order, cells)
        windows = np.lib.stride_tricks.sliding_window_view(x, order)[at]
        assert (found[of] == windows).all() and len(found) == len({tuple(w) for w in windows.tolist()})
    found, of = langid._distinct(x, at[:0], 3)
    assert found.shape == (0, 3) and not len(of)


def test_small_bundles_of_a_chunk_are_taken_together():
    texts = pa.RecordBatch.from_pydict({"chunk": [0] * 60, "doc_id": list(range(60)), "text": [None if i % 9 == 0 else f"word {i} of text {'ab' * (i % 7)}" for i in range(60)]})
    one = pa.Table.from_batches(langid._bundle([texts]))
    many = pa.Table.from_batches([b for i in range(60) for b in langid._bundle([texts.slice(i, 1)])])
    assert (one.num_rows, many.num_rows) == (1, 60)
    (a,), (b,) = langid._texts(one, 4), langid._texts(many, 4)
    assert a[0] == b[0] and all((x == y).all() for x, y in zip(a[1:], b[1:], strict=True))
    assert langid._wanted((pa.scalar(0),), one, 4) == langid._wanted((pa.scalar(0),), many, 4)
    assert sum(len(x[0]) for x in langid._texts(many, 4, 50)) == 60


def test_chunks_are_tasks_of_their_own(spark):
    df = spark.createDataFrame([(i, f"text {i} in some language or other", "xy"[i % 2]) for i in range(200)], "doc_id long, text string, lang string")
    found = langid.ModelTable(df).means(df, "doc_id", chunk=100).select("doc_id", F.spark_partition_id().alias("part")).collect()
    assert len(found) == 200 and len({r.part for r in found}) > 4
