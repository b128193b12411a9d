from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from carryover.llm import importance as I
from carryover.llm.queries import ORACLES, QUERIES
from tools import check


def test_checksums_against_the_library():
    draw = random.Random(1)
    spans = [bytes(draw.randrange(256) for _ in range(draw.choice([1, 2, 5, 9, 63, 64, 65, 127, 128, 129, 300, 5000]))) for _ in range(500)]
    spans += [b"\0" * 1000, b"\xff", b"x" * 1000003]
    for part in (spans, [s for s in spans if len(s) <= I.BLOCK], spans[-1:], []):
        got = I.crc32_of_spans(np.frombuffer(b"".join(part), np.uint8), np.array([len(s) for s in part], np.int64))
        assert [int(x) for x in got] == [zlib.crc32(s) for s in part]


def brute(docs, target, longest, buckets, seed, least, percent):
    def split(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    raw, goal = Counter(b for _, t in docs for b in split(t)[1]), Counter(b for t in target for b in split(t)[1])
    s_all, t_all = sum(raw.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log(((goal[b] + 1.) * (s_all + buckets)) / ((raw[b] + 1.) * (t_all + buckets))))
    rows = []
    for i, t in docs:
        words, found = split(t)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return Counter(rows), [(r[0], r[3]) for r in drawn]


@pytest.fixture(scope="module")
def data(near_copies):
    draw = random.Random(3)
    target = ["one two three", None, "", "É One " * 9, " ".join(near_copies[3][1].split()[:40])]
    docs = [*near_copies, (77, "x" * 700 + " " + "é" * 90 + " y-z"), (78, "日本語" * 50), (5, "aa bb " * 20), (4, "aa bb " * 20), (None, "aa bb " * 20), (None, "aa bb " * 20)]
    docs += [(6000 + i, " ".join(draw.choice(["aa", "bb", "Cc"]) for _ in range(draw.randint(0, 60)))) for i in range(300)]
    return docs, target


@pytest.mark.parametrize("longest,buckets,least,percent", [(1, 10000, 20, 10), (3, 97, 0, 100), (2, 500, 5, 33)])
def test_against_brute_force(spark, make, data, longest, buckets, least, percent):
    docs, target = data
    rows = I.importance_sample(make(docs), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets,
                               least_words=least, percent=percent).collect()
    want, drawn = brute(docs, target, longest, buckets, 2024, least, percent)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in rows) == want
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == drawn


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c " * 20, 1, "s", 2) for i in range(20)], "doc_id bigint, text string, _row int, score string, weight int")
    target = spark.createDataFrame([("a b", 1)], "text string, bucket int")
    assert I.importance_sample(docs.limit(0), target).collect() == []
    assert sum(r["rank"] is not None for r in I.importance_sample(docs, target.limit(0)).collect()) == 2


def test_query_against_sql(spark):
    sf, name = "/root/testdata/sf0.001", "op12_importance_resampling"
    ok, why, _, _ = check.compare(spark, check.database(sf), sf, name, QUERIES[name], ORACLES[name])
    assert ok, why
