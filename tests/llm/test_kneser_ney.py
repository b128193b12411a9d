from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from carryover.llm import kneser_ney as K
from carryover.llm.language_id import fold


def tokens(text):
    return [*(text or "").encode().lower().split(), "END"]


def brute(rows, held, order):
    """The model by its formulas, with dictionaries."""
    count = [Counter() for _ in range(order + 1)]
    for (_, text), out in zip(rows, held):
        if not out:
            t = ["BOS"] * (order - 1) + tokens(text)
            count[order].update(tuple(t[i - order + 1:i + 1]) for i in range(order - 1, len(t)))
    for k in range(order - 1, 0, -1):
        count[k].update({g[1:] for g in count[k + 1]} and Counter(g[1:] for g in count[k + 1]))
    cut, follow = {}, {}
    for k in range(1, order + 1):
        n = Counter(count[k].values())
        cut[k] = (0, *K.discounts(n[1], n[2], n[3], n[4]))
        follow[k] = defaultdict(list)
        for g, c in count[k].items():
            follow[k][g[:-1]].append(c)
    raw = Counter(t for (_, text), out in zip(rows, held) if not out for t in tokens(text))
    total, vocabulary = sum(raw.values()), len(raw)

    def p(g, k):
        if k == 0:
            return 1 / (vocabulary + 1)
        after = follow[k].get(g[:-1])
        lower = p(g[1:], k - 1)
        if not after:
            return lower
        c = count[k][g]
        return (max(c - cut[k][min(c, 3)], 0) + sum(cut[k][min(x, 3)] for x in after) * lower) / sum(after)

    out = []
    for (doc, text), no in zip(rows, held):
        own = tokens(text)
        t = ["BOS"] * (order - 1) + own
        score = sum(math.log10(p(tuple(t[i - order + 1:i + 1]), order)) for i in range(order - 1, len(t)))
        base = sum(math.log10((raw[x] + 1) / (total + vocabulary + 1)) for x in own)
        out.append((doc, no, len(own), sum(raw[x] > 0 for x in own), total, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["a", "b", "B", "c", "dé", "e" * draw.randint(1, 3)]) for _ in range(draw.randint(0, 40))) for _ in range(150)]
    out = [(i, t) for i, t in enumerate(texts)] + [(200 + i, texts[i] + "\tnew words here") for i in range(30)]
    return out + [(300, None), (301, ""), (302, " \n"), (None, "a b c"), (303, "a b"), (303, "a b"), (304, "long " * 5000 + "tail")]


@pytest.mark.parametrize("order,size", [(2, 10**6), (3, 300), (4, 300)])
def test_against_the_formulas(spark, rows, order, size, monkeypatch):
    import zlib

    monkeypatch.setattr(K, "CHUNK_TOKENS", size)
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = K.kneser_ney_scores(docs, held_out=fold("doc_id", 7) == 2, order=order).collect()
    assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got), key=str) == brute(rows, held, order)


def test_beats_single_words_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = K.kneser_ney_scores(docs, held_out=fold("doc_id", 7) == 2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_empty_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, chunk string, kind int, deal int"
    assert K.kneser_ney_scores(spark.createDataFrame([], schema)).collect() == []
    one = K.kneser_ney_scores(spark.createDataFrame([(1, "a", "c", 1, 2)], schema), held_out=F.lit(True)).collect()
    assert [tuple(r) for r in one] == [(1, True, 2, 0, 0, 0.0, 0.0)]


def test_steps_of_a_full_chunk_take_little_memory(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute

    monkeypatch.setattr(K, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in draw.zipf(1.3, 2000) % 50_000) for _ in range(490)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(490)), pa.array(texts), pa.array([i % 7 == 2 for i in range(490)])], names=["doc_id", "text", "held_out"])
    del texts
    state = pa.Table.from_batches(list(K._chunks(K.CHUNK_TOKENS)(iter([docs]))))
    assert state.num_rows == 1

    def step(run, *tables):
        rows = pa.concat_tables(tables)
        rows = rows.sort_by([(c, "ascending") for c in ("deal", "chunk", "kind")] if run.__qualname__.startswith("_merge") else [("chunk", "ascending"), ("kind", "ascending")])
        tracemalloc.start()
        out = list(run(iter(rows.to_batches(max_chunksize=8))))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 160e6, (run.__qualname__, peak)
        return pa.Table.from_batches(out)

    answers, asked = {}, step(K._ask_highest(3, 64), state)
    for k in (3, 2, 1):
        merged = step(K._merge(k), asked)
        answers[k] = merged.filter(pa.compute.equal(merged["kind"], k))
        if k > 1:
            asked = step(K._ask_lower(k - 1, 64), state, answers[k])
    got = step(K._score(3, {k: (0.5, 1.0, 1.5) for k in (1, 2, 3)}, 50_000, (10, 1, 1, 1), 10), state, *answers.values())
    assert got.num_rows == 490
