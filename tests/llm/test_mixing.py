from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from carryover.llm import mixing
from carryover.llm.mixing import mix_sources, word_count


def goals(sizes, weights, limit):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        spare = total - sum(limit * sizes[s] for s in full)
        shared = sum(weight[s] for s in names if s not in full)
        out = {s: limit * sizes[s] if s in full else spare * weight[s] / shared for s in names}
        above = {s for s in names if s not in full and out[s] > limit * sizes[s]}
        if not above:
            return out
        full |= above


def run(spark, rows, weights=(5, 2, 1), seed=0):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string, rows int").repartition(3)
    return mix_sources(docs, word_count(F.col("text")), weights=weights, seed=seed).collect()


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    out = []
    for i in range(900):
        source = draw.choice(["b", "b", "b", "b", "a", "é", None, "tiny", "B"]) if i % 50 else "tiny2"
        text = None if i % 97 == 0 else " ".join("w" * draw.randint(0, 3) for _ in range(draw.choice([3, 20, 60])))
        out.append((i, text, source, "x", 1))
    return out


@pytest.mark.parametrize("chunk", [4, 128])
def test_targets_and_mass(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    got = run(spark, rows)
    assert len(got) == len(rows)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows}
    by = defaultdict(int)
    for d, _, s, *_ in rows:
        by[s] += size[d]
    want, taken, most = goals(by, (5, 2, 1), 3), defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[r.source] and r.target == pytest.approx(want[r.source])
        rate = want[r.source] / by[r.source]
        assert r.taken in (size[r.doc_id] * int(rate + 1e-9), size[r.doc_id] * int(rate + 1)) and r.taken <= 3 * size[r.doc_id]
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= most[s]
    assert sorted(map(str, got)) == sorted(map(str, run(spark, rows)))


def test_expectation_is_kept(spark):
    """Over many seeds each document is taken as often as its rate says."""
    rows = [(i, " ".join("w" * (1 + i)), "a" if i < 6 else "b", "x", 1) for i in range(12)]
    rows = [(i, " ".join(["w"] * (1 + i * i)), "a" if i < 6 else "b", "x", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string, rows int").coalesce(1)
    rounds, seen = 40, defaultdict(int)
    total = {}
    for seed in range(rounds):
        for r in mix_sources(docs, word_count(F.col("text")), weights=(5, 2), seed=seed).collect():
            seen[r.doc_id] += r.copies
            total[r.doc_id] = r.target / r.source_size
    for d, rate in total.items():
        assert abs(seen[d] / rounds - rate) < 0.25, (d, seen[d] / rounds, rate)


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, source string, size string, rows int"
    assert run(spark, []) == []
    rows = [(None, "a b", None, "x", 1), (None, "a b", None, "x", 1), (1, None, "s", "x", 1), (1, "", "s", "x", 1), (2, "a", "t", None, None), (2, "a", "t", None, None)]
    got = run(spark, rows)
    assert len(got) == 6 and len(spark.createDataFrame(rows, schema).columns) == 5
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert [r.target for r in got if r.source == "s"] == [0.0, 0.0]


def test_repeated_rows_are_no_lump(spark):
    """A third of all words lie in rows without an id and of one size: their source still meets its target."""
    rows = [(None, "a b c d e", "hot", "x", 1)] * 3000 + [(i, "a " * (1 + i % 9), "hot" if i % 2 else "cold", "x", 1) for i in range(4000)]
    got = run(spark, rows, weights=(5, 4))
    assert len(got) == 7000
    for source in ("hot", "cold"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9
    lump = [r.copies for r in got if r.doc_id is None]
    assert len(lump) == 3000 and len(set(lump)) == 2 and max(lump) - min(lump) == 1
