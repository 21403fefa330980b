import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, id long, at int, n int, root long, lead long, spans string, digest string, prefix string, score string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvz") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, nulls, empty and very long ones, repeated rows and ties."""
    r, rows = random.Random(5), []
    base, passage = prose(1, 120), prose(2, 60)
    for i in range(12):
        words = base.split()
        for _ in range(i // 2):
            words[r.randrange(len(words))] = prose(100 + i, 1)
        rows.append((i, " ".join(words)))
    rows += [(20 + i, prose(50 + i, 40) + " " + passage + " " + prose(80 + i, 30)) for i in range(6)]
    rows += [(40, None), (41, ""), (42, "   "), (43, "one two"), (44, "one two"), (45, "é" * 150), (46, "x" * 700), (47, "ab" * 400), (48, "Straße 😀 ОДИН " * 30)]
    rows += [(49, prose(9, 20_000)), (50, base), (50, base), (51, None), (51, prose(3, 30)), (None, prose(4, 90)), (None, base), (None, None)]
    rows += [(60 + i, prose(200 + i, r.randint(1, 80))) for i in range(10)]
    langs, sources = ["en", "de", None], ["a", "b", "Z", None]
    return [(d, t, langs[k % 3], sources[k % 4], len(t or ""), 1, 2, 3, 4, 5, "x", "y", "z", "w") for k, (d, t) in enumerate(rows)]


@pytest.fixture
def documents(spark, corpus):
    return spark.createDataFrame(corpus, DOCUMENTS).repartition(3)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
