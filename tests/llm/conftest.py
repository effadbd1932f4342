from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Names that operators use inside, as columns of the caller's.
EXTRA = "block string, key string, salt int, digest string, score double, y int, token string, label int, kept boolean, n_words long, x string, rep long, pattern string"


@pytest.fixture(scope="session")
def table(spark):
    """Makes documents from (doc_id, text) rows, with extra columns of clashing names."""

    def make(rows):
        extra = ["b", None, 3, "d", None, 1, "t", 0, True, 5, "x", 1, "p"]
        return spark.createDataFrame([(i, t, "en", "s", None, *extra) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")

    return make


@pytest.fixture(scope="session")
def odd():
    """Null ids and texts, empty and blank texts, a very long one, and repeated rows."""
    long_ = " ".join(f"w{k % 9973}" for k in range(60_000))
    return [(None, "lost words of a row without an id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "same row"), (4, "same row"), (5, long_), (6, long_ + " end"), (7, "é ü — ☃ 語")]


@pytest.fixture(scope="session")
def corpus():
    """Random prose with exact copies, edited copies, shared passages and shared lines."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    passages, lines = [prose(40) for _ in range(4)], [prose(12) for _ in range(6)]
    texts: list[str] = []
    for k in range(90):
        if texts and rng.random() < 0.15:
            texts.append(rng.choice(texts))
        elif texts and rng.random() < 0.25:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
        else:
            w = prose(rng.choice([1, 3, 20, 60, 150]))
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w[at:at] = rng.choice(passages)
            texts.append(" ".join(w))
        if rng.random() < 0.5:
            line = list(rng.choice(lines))
            if rng.random() < 0.5:
                line[rng.randrange(12)] = "other"
            texts[-1] += "\n" + " ".join(line) + "\n\nLast Line " + str(k)
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))
