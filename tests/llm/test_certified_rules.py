from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from carryover.llm import certified_rules as C


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] >= 2 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines),
            len(re.findall("[A-Z]", text)), len(re.findall("[!?]", text)))


def odd_texts():
    draw = random.Random(6)
    out = [None, "", " ", "\n\n", "a", "a a", "a a a", "a a a a", "a b c a b c", "\r\na\r\na\n a\na", "é è é è é | <b>", "x\x0by\x0cz\x1cw"]
    for _ in range(300):
        out.append("".join(draw.choice(["a", "b", "é", "日", "#", "|", " ", " ", "\n", "\t", "A", "!"]) for _ in range(draw.randint(1, 200))))
    return [*out, "one two three\n" * 30000, "w" * 200000]


def test_statistics_against_brute_force(make):
    texts = odd_texts()
    got = {r.doc_id: tuple(r[c] for c in C.STATS) for r in C.text_stats(make(list(enumerate(texts)))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def exact_tail(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)))


@pytest.mark.parametrize("n,p", [(1, .5), (40, .05), (300, .02), (1000, .0125)])
def test_binomial_tails(n, p):
    for k in {0, 1, int(n * p), int(n * p / 2)}:
        if k <= n * p:
            assert C.tail(k, n, p) == pytest.approx(exact_tail(k, n, p), rel=1e-9)
    for level in (.05, 1e-3):
        k = C.most_rejections(n, p, level)
        assert k == max([-1, *[i for i in range(int(n * p) + 1) if exact_tail(i, n, p) <= level]])
        if k >= 0:
            assert C.upper_bound(k, n, level) <= p and C.tail(k, n, C.upper_bound(k, n, level)) == pytest.approx(level, rel=1e-6)


def split(i):
    return zlib.crc32(str(i).encode()) % 2 == 1


@pytest.fixture(scope="module")
def labelled(spark):
    """Language aa: bad documents are full of symbols. bb: symbols say nothing. cc: too few labels."""
    draw = random.Random(8)
    rows = []
    for i in range(5000):
        lang = "cc" if i < 60 else draw.choice(["aa", "bb", None])
        good = draw.random() < .8
        noisy = draw.random() < .5 if lang == "bb" else not good
        rows.append((i, " ".join(draw.choice("abcdefghijklmnop") * 4 + f"{draw.random():.4f}" + ("**" if noisy and draw.random() < .6 else "") for _ in range(60)), lang, good))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], int(r[3])) for r in rows], "doc_id bigint, quality int")
    return rows, docs, labels


def test_cutoffs_against_brute_force(labelled):
    rows, docs, labels = labelled
    rules = {"symbols": C.RULES["symbols"]}
    stats = C.text_stats(docs)
    got = {r.stratum: r for r in C.certified_cutoffs(stats, labels, rules=rules).collect()}
    measured = {r.doc_id: (r.stratum, 1000 * r.n_symbols // r.word_chars) for r in stats.collect()}
    want = {}
    for lang in ("aa", "bb", "cc", ""):
        half = lambda hold, good: [measured[i][1] for i, _, l, g in rows if (l or "") == lang and g == good and split(i) == hold]  # noqa: E731, B023
        n = lambda values, c: sum(v >= c for v in values)
        tune_bad, tune_good, good = half(False, False), half(False, True), half(True, True)
        worth = {c: n(tune_bad, c) - 5 * n(tune_good, c) for c in range(1, 1001)}
        best = max(worth.values())
        if best <= 0:
            continue
        target = max(c for c, w in worth.items() if w == best)
        allowed = max([-1, *[k for k in range(int(len(good) * .05) + 1) if exact_tail(k, len(good), .05) <= (1 - .95) / 4]])
        fit = [c for c in range(target, 1001) if n(good, c) <= allowed]
        if fit:
            want[lang] = (fit[0], len(good), n(good, fit[0]))
    assert {k: (r.cutoff, r.good, r.good_lost) for k, r in got.items()} == want
    assert "aa" in want and "" in want and "cc" not in want and all(r.bound <= .05 for r in got.values())


def test_verdicts(labelled):
    rows, docs, labels = labelled
    out = {r.doc_id: r for r in C.quality_rules(docs, labels).collect()}
    assert len(out) == len(rows)
    for lang, least in (("aa", .9), (None, .9)):
        bad = [not out[i].kept for i, _, l, g in rows if l == lang and not g]
        good = [out[i].kept for i, _, l, g in rows if l == lang and g]
        assert sum(bad) / len(bad) > least and sum(good) / len(good) > .95
    assert all(out[i].kept for i, _, l, _ in rows if l == "cc")
    assert all(r.kept == (not r.base_failed and not r.failed_rules) for r in out.values())


def test_odd_rows(spark, make):
    texts = odd_texts()
    rows = [(i, t, "aa", "s") for i, t in enumerate(texts)] + [(None, "x " * 60, None, None), (3, "word " * 70, "aa", "s"), (3, "word " * 70, "aa", "s")]
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (3, 1), (99999, 0)], "doc_id bigint, quality int")
    got = C.quality_rules(make(rows), marks).collect()
    base = Counter((r[0], *brute(r[1])[:5], (b := brute(r[1]))[0] < 50 or 100 * b[4] > 50 * b[0]) for r in rows)
    assert Counter(tuple(r[:7]) for r in got) == base
    assert all(r.kept != r.base_failed for r in got)
    assert C.quality_rules(make(rows).limit(0), marks).collect() == []
    named = spark.createDataFrame([(1, "a b " * 40, "x", 1, 2)], "doc_id bigint, text string, lang string, stratum int, cutoffs int")
    assert C.quality_rules(named, marks.limit(0)).select("doc_id", "kept", F.size("failed_rules")).collect() == [(1, False, 0)]
