from __future__ import annotations

import random

import pytest

SYLLABLES = ["an", "er", "ti", "on", "re", "es", "th", "ou", "ing", "de", "la", "ch", "st", "ble", "wh", "ha"]


def prose(rng: random.Random, words: int) -> str:
    out = []
    for i in range(words):
        w = "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
        out.append(w.capitalize() + "." if i % 9 == 0 else w)
    return " ".join(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "!!!", "x" * 50_000, "é́ 日本語 🎉 İΣ ß", "a\x00b \x1c c", "\n\n"]


@pytest.fixture(scope="session")
def made() -> list[tuple[int, str | None]]:
    """Texts with exact and near copies, repeated lines and odd cases."""
    rng = random.Random(4)
    texts: list[str | None] = [prose(rng, rng.randint(30, 160)) for _ in range(60)]
    texts += texts[:6]
    for t in list(texts[6:14]):
        w = t.split(" ")
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    line = prose(rng, 30)
    texts += [f"{prose(rng, 20)}\n{line}\n{prose(rng, 12)}" for _ in range(5)]
    texts += [f"{prose(rng, 20)}\n{line.replace(' th', ' wh', 1)}" for _ in range(2)]
    texts += ODD
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, made):
    """The made texts; repeated and null ids, and columns with names that operators use themselves."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in made]
    rows += [rows[3], rows[3], (None, "no id here at all", None, None, None), (None, None, None, None, None), (5, "one more text of the id five", "en", "s", 3)]
    clash = [(*r, "keep me", 1, 2.0, "x", "y") for r in rows]
    return spark.createDataFrame(clash, SCHEMA + ", id string, node int, score double, row_digest string, head_id string").repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
