from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, lang, source])."""
    def build(rows, schema=SCHEMA):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)
    return build


@pytest.fixture(scope="session")
def near_copies():
    """Texts with exact copies, near copies of one text, short and empty texts and nulls."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 4)))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(draw.randint(0, 9)):
            copy[draw.randrange(len(copy))] = word()
        rows.append((1000 + i, " ".join(copy)))
    for i in range(60):
        rows.append((2000 + i, "  ".join(word() for _ in range(draw.randint(1, 60)))))
    for i in range(40):
        words = rows[90 + i][1].split()
        words[0] = word()
        rows.append((3000 + i, "\t".join(words)))
    rows += [(10, None), (11, ""), (12, " \n "), (13, "One two"), (14, "one TWO"), (15, "one"), (16, "É é"), (None, "one two"), (17, rows[0][1]), (17, rows[0][1])]
    rows.append((18, " ".join(f"w{i}" for i in range(30000))))
    rows.append((19, " ".join(f"w{i}" for i in range(100, 30000))))
    return rows
