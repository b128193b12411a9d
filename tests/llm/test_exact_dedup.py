from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from carryover.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        spare = ids.count(keep) - 1
        for i in ids:
            kept = i == keep
            if kept and spare:
                spare, kept = spare - 1, False
            out[(i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("block", [1, 3, 64, 4096])
def test_against_brute_force(spark, make, near_copies, block):
    rows = [r for r in near_copies if block > 3 or len(r[1] or "") < 60]
    rows += [(5000 + i, "hot é text") for i in range(80)] + [(6000, "ab"), (6001, "abc"), (6002, "abcabc"), (6003, "abcabc"), (6004, "abcab")]
    got = exact_dedup(make(rows), block_bytes=block).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_blocks_with_one_hash(spark, make, near_copies, monkeypatch):
    """Names do not rest on the hash: here every block has the same one."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    rows = near_copies[:60] + near_copies[-12:-2]
    assert Counter(map(tuple, exact_dedup(make(rows), block_bytes=200).collect())) == brute(rows)


def test_empty_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, name string, rid int, key int, level string"
    assert exact_dedup(spark.createDataFrame([], schema)).collect() == []
    got = exact_dedup(spark.createDataFrame([(1, "a", "n", 1, 2, "l"), (2, "a", "m", 1, 2, "k")], schema)).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(1, 2, False), (2, 2, True)]
