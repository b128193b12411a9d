from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from carryover.llm import decontamination
from carryover.llm.decontamination import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = split(text)
        if item is not None and w:
            n = min(size, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = Counter()
    for doc, text in docs:
        w, hit, names = split(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    names |= found
                    hit |= set(range(i, i + n))
        out[(doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.fixture(scope="module")
def data():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abé1") for _ in range(draw.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(draw.choice([1, 2, 3, 4, 6, 9, 10, 11, 25])))) for i in range(30)]
    items += [(7, "Extra, words! of ITEM seven; in a second text that is long enough"), (None, "no id here"), (99, None), (98, " .,; "), (97, items[8][1]), (0, items[0][1])]
    docs = []
    for i in range(120):
        parts = [word() for _ in range(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 2)):
            source = split(draw.choice(items)[1])
            if source:
                cut = draw.randrange(len(source))
                parts[draw.randint(0, len(parts)):0] = [x.upper() if draw.random() < .3 else x for x in source[cut:]] if draw.random() < .4 else source
        docs.append((i, draw.choice([" ", ", ", "\n", " - "]).join(parts)))
    docs += [(500, None), (501, ""), (502, "  ..."), (None, items[9][1]), (503, items[9][1]), (503, items[9][1]), (504, "Éa " + "a b " * 3000)]
    return docs, items


@pytest.mark.parametrize("limit,window,shingle", [(10**6, 10, 4), (0, 10, 4), (10**6, 5, 2), (10**6, 3, 5)])
def test_against_brute_force(spark, data, limit, window, shingle, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", limit)
    docs, items = data
    left = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = contamination(left, spark.createDataFrame(items, "item_id bigint, text string"), window=window, shingle=shingle).collect()
    assert Counter(map(tuple, got)) == brute(docs, items, window)


def test_empty_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, words string, key int, n int, item string"
    docs = spark.createDataFrame([(1, "one two three", "w", 1, 2, "i")], schema)
    bench = spark.createDataFrame([(5, "two three", "rid", 3)], "item_id bigint, text string, rid string, len int")
    assert contamination(docs.limit(0), bench).collect() == []
    none = "".encode()
    assert [tuple(r) for r in contamination(docs, bench.limit(0)).collect()] == [(1, 3, 0, 0, hashlib.sha256(none).hexdigest(), False)]
    assert [tuple(r)[:4] for r in contamination(docs, bench).collect()] == [(1, 3, 2, 1)]
