from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from carryover.llm import jaccard_join as J


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    root[find(a)] = find(b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return Counter((doc, len(sets[i]), low.get(find(i))) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("k,percent", [(4, 85), (2, 60)])
def test_against_all_pairs(spark, make, near_copies, k, percent, small, monkeypatch):
    if small:  # many chunks, hot shingles, buckets cut into blocks
        for name, value in (("CHUNK_SHINGLES", 700), ("HOT", 3), ("BUCKET", 4), ("BLOCK_SHINGLES", 900), ("BLOCK_CLASSES", 3)):
            monkeypatch.setattr(J, name, value)
    got = J.jaccard_groups(make(near_copies), shingle=k, percent=percent).collect()
    assert Counter(map(tuple, got)) == brute(near_copies, k, percent)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, n bigint, rid string, label int, shared string")
    assert J.jaccard_groups(empty).collect() == []
    rows = [(1, "a b c d e f", 5, "x", 1, "y"), (2, "a b c d e f", 6, "x", 1, "y")]
    got = J.jaccard_groups(spark.createDataFrame(rows, empty.schema)).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1), (2, 2, 1)]


@pytest.mark.parametrize("small", [False, True])
def test_every_link_is_counted(spark, make, near_copies, small, monkeypatch):
    if small:
        for name, value in (("BUCKET", 4), ("BLOCK_SHINGLES", 900), ("BLOCK_CLASSES", 5)):
            monkeypatch.setattr(J, name, value)
    got = J.jaccard_join(make(near_copies), shingle=2, percent=60).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(near_copies, 2, 60)
    sets = []
    for _, text in near_copies:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 2]) for i in range(max(1, len(words) - 1))} if words else set())
    alike = lambda a, b: 100 * len(a & b) >= 60 * len(a | b)
    want = [sum(i != j and bool(a) and bool(b) and alike(a, b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((doc, n) for (doc, _), n in zip(near_copies, want))


def test_a_common_template_makes_no_cells(spark, monkeypatch):
    """Ten words of which nine are the same everywhere: the positional filter leaves no pair of a bucket of thousands to compare."""
    texts = spark.range(20_000).select("id", F.concat(F.lit("one two three four five six seven eight nine w"), F.col("id").cast("string")).alias("text"))
    cells = []
    plain = J._cells

    def counted(large, percent):
        out = plain(large, percent)
        cells.append((large.count(), out.count()))
        return out

    monkeypatch.setattr(J, "_cells", counted)
    got = J.jaccard_join(texts, "id", shingle=4, percent=85)
    assert got.where("n_links > 0 OR component_id <> doc_id").count() == 0
    assert all(out == 0 for _, out in cells)


def test_large_buckets_are_cut_into_bounded_cells(spark, monkeypatch):
    """Texts of two templates and of many sizes in one bucket: every cell stays within its bounds and no link is lost."""
    for name, value in (("BUCKET", 4), ("BLOCK_SHINGLES", 400), ("BLOCK_CLASSES", 8)):
        monkeypatch.setattr(J, name, value)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:40 + i % 20] + [f"x{i}", f"y{i % 7}"])) for i in range(300)]
    seen = []
    plain = J._cells

    def watched(large, percent):
        out = plain(large, percent)
        seen.append(out.groupBy("key", "g", "h", "i", "j").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(J, "_cells", watched)
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), shingle=2, percent=80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2, 80)
    assert all(n is None or n <= 60 for n in seen)


def test_scratch_memory_is_bounded():
    """A chunk of texts and a full cell each stay within a share of an executor that holds two workers."""
    import tracemalloc

    import numpy as np

    from carryover.llm import jaccard_join as J

    rng = np.random.default_rng(1)
    found = [{"n": 60, "shared": np.sort(rng.integers(0, 1 << 40, 60)).tobytes()} for _ in range(2 * J.BLOCK_CLASSES)]
    found += [{"n": 60, "shared": found[0]["shared"]}]
    tracemalloc.start()
    try:
        similar = J._similar(found, 85)
        assert np.argwhere(np.triu(similar, 1)).tolist() == [[0, len(found) - 1]]
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
        tracemalloc.reset_peak()
        J.grams.words(np.full(1 << 22, 97, np.uint8), np.arange(0, (1 << 22) + 1, 1 << 10))
        assert tracemalloc.get_traced_memory()[1] < 50 << 20
    finally:
        tracemalloc.stop()
