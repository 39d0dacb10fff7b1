from __future__ import annotations

import random

import pytest


def _prose(rng, n):
    syllables = ["the", "an", "er", "in", "ou", "st", "é", "ment", "qu", "ß", "ing", "Re"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def docs():
    """(doc_id, text): copies, near copies, shared passages, repeats, nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(5)
    base = [_prose(rng, rng.randint(60, 200)) for _ in range(8)]
    passage = _prose(rng, 60)
    out = [(i, t) for i, t in enumerate(base)]
    for k in range(12):  # near copies of one text
        w = base[0].split()
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = "x" + str(rng.random())
        out.append((100 + k, " ".join(w)))
    out += [(200 + k, f"{_prose(rng, 20)}\n{passage}\t{_prose(rng, 15)}") for k in range(4)]
    out += [(300 + k, base[1]) for k in range(3)] + [(310, base[1].upper())]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one two"), (404, "One TWO"), (405, "日本 😀 é"), (406, "one two three four five")]
    out += [(410, (_prose(rng, 30) + "\n") * 9), (411, "spam eggs " * 300), (412, "a" * 3000), (413, _prose(rng, 4000))]
    out += [(500, base[2]), (500, base[2]), (500, base[3]), (None, base[4]), (None, _prose(rng, 40))]
    return out


@pytest.fixture(scope="session")
def bench(docs):
    first = {i: t for i, t in reversed(docs)}
    return [(0, " ".join(first[0].split()[10:40])), (1, "one two"), (2, None), (3, ""), (4, " ".join(first[413].split()[100:120])), (4, "again again"), (10, " ".join(first[5].split()[:13])), (11, "never seen " * 10)]


def keyed(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="session")
def frame(spark, docs):
    """The table with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "k", 1, "n") for i, t in docs], "doc_id bigint, text string, __key string, __n int, n_words string").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, __key string, __n int, n_words string")
