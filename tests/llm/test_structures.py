"""Merkle manifests, conversation repair and phrase fingerprints against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopflow.llm import conversations, merkle, phrases


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(hashes: list[str]) -> list[list[str]]:
    levels = [hashes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[str]], i: int) -> list[tuple]:
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append((level[j] if j < len(level) else None, i & 1))
        i >>= 1
    return out


def proofs_by_force(rows: list[tuple]) -> list[tuple]:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha(field(r[0]), field(r[3]), field(r[2]), field(None if r[4] is None else r[4] + more), field(r[1]))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r[2] is not None, (r[2] or "").encode())].append(r)
    names = sorted(groups)
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            own = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for h, left in path:
                own = sha(own) if h is None else sha(h, own) if left else sha(own, h)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*(h for h, _ in path if h)), own, own == top[-1][0]))
    return sorted(out, key=str)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
ROWS = "doc_id long, text string, lang string, source string, n_chars long, hash string, idx int, path string, _g int"


def test_merkle_of_awkward_rows(spark, corpus, documents):
    """Nulls in every field, repeated rows, ties of ids, long texts, names that clash."""
    rows = [r[:5] for r in corpus] + [(7 * k, "x", "fr", None, None if k % 3 else k) for k in range(40)] + [(None, None, None, None, None)] * 3 + [(1, "a", "", "s", 1)]
    df = spark.createDataFrame([(*r, "h", 1, "p", 2) for r in rows], ROWS).repartition(5)
    want = proofs_by_force(rows)
    for levels in (1, 3, merkle.LEVELS):
        got = merkle.document_proofs(df, levels)
        assert sorted((tuple(r[c] for c in NAMES) for r in got.collect()), key=str) == want
    assert {r[6] for r in want} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [64, 65, 1], [129], [1] * 67])
def test_merkle_of_group_sizes(spark, sizes):
    rows = [(g * 1000 + i, f"t{i}", f"l{g:02}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    got = merkle.document_proofs(spark.createDataFrame([(*r, "h", 1, "p", 2) for r in rows], ROWS))
    assert sorted((tuple(r[c] for c in NAMES) for r in got.collect()), key=str) == proofs_by_force(rows)


def test_merkle_of_nothing(no_documents):
    assert merkle.document_proofs(no_documents).collect() == []


def test_merkle_keeps_every_few_levels_and_splits_a_hot_group(spark):
    """Stored levels are runs of 64, and the leaves of the one large group are dealt over all ranges."""
    rows = spark.range(20_000).select("id", F.lit("en").alias("lang"))
    made = merkle.manifest(rows, "lang", "id", F.sha2(F.col("id").cast("string"), 256))
    assert [t.count() for t in made.groups.stored] == [20_000, 313, 5, 1]
    where = [r[0] for r in made.groups.stored[0].groupBy("_g", F.shiftright("idx", 13)).count().select("count").collect()]
    assert len(where) == 3 and made.groups.stored[0].select(F.max("idx")).first()[0] == 19_999
    leaves = made.groups.stored[0]
    assert leaves.agg(F.count_distinct("idx")).first()[0] == 20_000
    plan = leaves._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")


SPACES = re.compile("[^\x20\x09-\x0D]")
WROTE = {"u": "user", "a": "assistant"}


def damaged_by_force(rows: list[tuple]) -> dict:
    """Rows after damage by conversation, in order; conversations without any too."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2]))) for c, rs in out.items()}


def faults_by_force(rows: list[tuple]) -> list[str]:
    out, seen = [], set()
    for _, role, text in rows:
        said = SPACES.findall(text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def audits_by_force(rows: list[tuple], faults: list[str]) -> tuple:
    """(cost, audit, turns): of all ways to edit with up to two insertions in a row, the cheapest that gives sound roles."""
    found = []

    def go(i: int, inserted: int, cost: int, audit: str, turns: tuple) -> None:
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                found.append((cost, audit, turns))
        else:
            _, role, text = rows[i]
            late = 3 if faults[i] == "truncated" else 0
            go(i + 1, 0, cost + 4, audit + "D", turns)
            if faults[i] not in ("blank", "duplicate"):
                go(i + 1, 0, cost + late, audit + "K", (*turns, (role, text)))
                for name in WROTE.values():
                    go(i + 1, 0, cost + late + 3, audit + "R", (*turns, (name, text)))
        if inserted < 2:
            for name in WROTE.values():
                go(i, inserted + 1, cost + 3, audit + "I", (*turns, (name, "")))

    go(0, 0, 0, "", ())
    return min(found)


def repaired_by_force(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, own in damaged_by_force(rows).items():
        faults = faults_by_force(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, fixed = audits_by_force(own, faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in fixed))))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, signature string, digest string, at int, plan int, audit string"
FIXED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def talk(seed: int, conv, n: int) -> list[tuple]:
    r = random.Random(seed)
    texts = ["Yes.", "no", "  ", None, "", "Why?! \n", "é😀.", ". x", "A.\u00a0"]
    return [(conv, r.choice([None, *range(9)]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "useful", "Assistant"]), r.choice(texts)) for _ in range(n)]


def test_repair_of_small_conversations(spark):
    """Nulls, blanks, ties of turns, repeated rows, odd roles and names that clash against all edits there are."""
    rows = [x for k in range(60) for x in talk(k, k, 1 + k % 3)] + talk(999, None, 3) + [(1000, None, None, None), (1001, 5, "user", "Hi."), (1001, -3, "assistant", "Ho.")]
    rows += [(c, t, "user", "dropped.") for c, t in [(c, t) for c in range(2000, 2100) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], TURNS).repartition(5)
    got = conversations.digests(conversations.damage(df)).collect()
    assert sorted((tuple(r[c] for c in FIXED) for r in got), key=str) == repaired_by_force(rows)
    assert any(r.audit == "" for r in got) and {e for r in got for e in r.audit} == set("DIKR")


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "So"), (1, 2, "user", "So"), (2, 0, "user", "  ")]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], TURNS)
    got = [tuple(r) for r in conversations.repair(df).orderBy("conv_id", "n").collect()]
    own = [(t, r, x) for c, t, r, x in rows if c == 1]
    assert got == [(1, i, r, t) for i, (r, t) in enumerate(audits_by_force(own, faults_by_force(own))[2])]
    assert conversations.digests(conversations.damage(df.limit(0))).collect() == []


def test_equal_ends_are_one_node(spark):
    """Nodes are the different ends of signatures, and a pattern that many conversations share is solved once."""
    found = ["suaua", "uaua", "xua", "ua", "ua", "ua", "uaU", ""]
    got = conversations.plans(spark.createDataFrame([(x,) for x in found], "signature string").repartition(2)).coalesce(1).collect()
    assert sorted(r.signature for r in got) == sorted(set(found))
    one = conversations.Automaton()
    for x in sorted(x[::-1] for x in set(found)):
        one.read(x)
    assert one.nodes == len({x[i:] for x in found for i in range(len(x) + 1)})


def test_long_conversation_is_linear(spark):
    """200,000 rows of one conversation, with a fault now and then."""
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") % 1000 == 999, "").otherwise(F.concat(F.lit("Turn "), F.col("id"), F.lit("."))).alias("text"))
    got = conversations.digests(rows).first()
    assert got.blank == 200 and len(got.audit) == 200_200 and got.cost == 200 * (conversations.DELETE + conversations.INSERT)


def phrases_by_force(data: bytes) -> set[bytes]:
    out, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in out:
            out.add(data[start:end])
            start = end
    return out


def neighbours_by_force(rows: list[tuple]) -> list[tuple]:
    """doc_id, n_chars, edited_sha256, and the texts: own, edited, next. Rows are (doc_id, text, hash of the text)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    out = []
    for own, after in zip(rows, rows[1:] + rows[:1]):
        text, following = own[1] or "", after[1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + following[:m]
        out.append((own[0], len(text), sha(edited), text, edited, following))
    return out


def checked_fingerprints(df, parts: int) -> None:
    hashed = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    want = collections.Counter()
    of = lambda text: phrases.Parse().read(text.encode()).print()
    for doc_id, n, edited_sha, text, edited, following in neighbours_by_force([tuple(r) for r in hashed]):
        a, b, c = of(text), of(edited), of(following)
        want[(doc_id, n, edited_sha, phrases.shown(a), phrases.shown(b), phrases.likeness(a, b), phrases.likeness(a, c))] += 1
    got = collections.Counter(tuple(r) for r in phrases.fingerprints(df, parts).collect())
    assert got == want


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_of_awkward_rows(documents, parts):
    checked_fingerprints(documents, parts)


def test_fingerprints_of_few_rows(spark, no_documents):
    assert phrases.fingerprints(no_documents).collect() == []
    for rows in ([(1, "one text of one row")], [(None, None)], [(1, None), (2, "")], [(5, "a"), (5, "a"), (5, "a")], [(-(2**63), "least"), (2**63 - 1, "greatest one"), (0, "zero " * 9)]):
        checked_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 3)


def test_likeness_is_that_of_the_phrase_sets():
    """The phrases are those of the plain parse; estimates are near the exact likeness of the sets, of short texts too."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    errors = []
    for n in (3, 12, 60, 400, 3000):
        for keep in (0.0, 0.5, 0.9, 1.0):
            a = " ".join(r.choice(words) for _ in range(n)).encode()
            b = a[: int(len(a) * keep)] + " ".join(r.choice(words) for _ in range(n)).encode()[int(len(a) * keep) :]
            x, y = phrases_by_force(a), phrases_by_force(b)
            parse = phrases.Parse().read(a)
            assert len(parse.new) == len(x) and len(set(phrases._hashed(parse.new, phrases._ROOT).tolist())) == len(x) + 1
            errors.append(phrases.likeness(parse.print(), phrases.Parse().read(b).print()) - len(x & y) / len(x | y))
            assert a != b or errors[-1] == 0
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.03


def test_a_fork_parses_as_the_whole_text_does(monkeypatch):
    """Also where the dictionary starts anew, in the shared part and after it, and in runs of one byte."""
    monkeypatch.setattr(phrases, "DICTIONARY", 500)
    monkeypatch.setattr(phrases, "STEP", 256)
    r = random.Random(4)
    for text in ("x" * 5000, "".join(r.choice("abcdé") for _ in range(9000)), "ab" * 2000 + "é" * 700):
        for cut in (0, 1, 255, 256, 3000, len(text)):
            whole = phrases.Parse().read(text.encode()).print()
            assert (phrases.Parse().read(text[:cut].encode()).settle().fork().read(text[cut:].encode()).print() == whole).all()
