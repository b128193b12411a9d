from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from carryover.llm import divergence as D
from carryover.llm.queries import ORACLES, QUERIES
from tools import check


def brute(docs, least, top, scale=10**9, smoothing=5):
    split = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, count, all_ = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        words = split(text)
        df[lang or ""].update(set(words))
        count[lang or "", source or ""].update(words)
        all_[lang or ""].update(words)
    out = []
    for lang, source in count:
        kept = [t for t, n in df[lang].items() if n >= least]
        share = lambda c: {t: 1 + scale * (c[t] + smoothing) // (sum(c[k] for k in kept) + smoothing * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = share(count[lang, source]), share(all_[lang])
        pairs = [(o, sum(abs(p[t] - r[t]) for t in kept)) for (l2, o) in count if l2 == lang and o != source for r in [share(count[l2, o])]]
        terms = [(t, p[t] - q[t]) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(4)
    words = [f"{a}{b}" for a in ("é", "z", "Ab", "日本", "q") for b in "abcdefghij"]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else draw.choice([None, "", *(f"s{k}" for k in range(12))])
        lang = draw.choice(["en", "en", "en", "de", None, "fr"])
        some = words[:20] if source == "hot" else words[draw.randint(0, 20):]
        rows.append((i, draw.choice([" ", "1", "-"]).join(draw.choice(some) for _ in range(draw.randint(0, 60))), lang, source))
    rows += [(900, None, "en", "empty"), (901, "", "en", "silent"), (902, "rare words only", "xx", "a"), (903, None, "xx", "b"), (904, "lone", "yy", "a"), (905, "1 2 3", "en", "digits")]
    return [*rows, *rows[:5], (None, "za " * 20000, "de", "long")]


@pytest.mark.parametrize("least,top,block,postings", [(30, 50, 512, 1 << 14), (3, 4, 3, 8), (1, 50, 1, 4)])
def test_against_brute_force(make, docs, least, top, block, postings, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "POSTINGS", postings)
    got = D.source_divergence(make(docs), least_docs=least, top=top)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(docs, least, top)


def test_accumulators_of_one_cell():
    draw = np.random.default_rng(2)
    a, b = draw.integers(0, 4, (5, 30)), draw.integers(0, 4, (7, 30))
    sides = []
    for m in (a, b):
        base = draw.integers(1, 50, len(m))
        full = np.where(m > 0, m * 1000 + base[:, None], base[:, None])
        rows, terms = np.nonzero(m)
        mixed = draw.permutation(len(rows))
        sides.append(((terms[mixed], rows[mixed], full[rows[mixed], terms[mixed]], base), full))
    want = np.abs(sides[0][1][:, None, :] - sides[1][1][None, :, :]).sum(-1)
    assert (D.accumulate(sides[0][0], sides[1][0], 30) == want).all()


def test_empty_and_clashing_columns(spark, make):
    assert D.source_divergence(make([]).limit(0)).collect() == []
    rows = [("a b", "en", "s", 1, 2, "t"), ("a c", "en", "r", 1, 2, "t")]
    got = D.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string, n int, p int, term string"), least_docs=1)
    assert {r.part for r in got.collect()} == {"pair", "term"}


def test_query_against_sql(spark):
    sf, name = "/root/testdata/sf0.001", "op11_source_divergence"
    ok, why, _, _ = check.compare(spark, check.database(sf), sf, name, QUERIES[name], ORACLES[name])
    assert ok, why
