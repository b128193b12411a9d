"""Closest templates by prefixes against all pairs."""

from __future__ import annotations

import random

import pytest

from carryover.operators import access as A

MATRIX = "grp string, object string, privilege string"


def table(spark, sets):
    return spark.createDataFrame([(g, f"o{i}", "x" if i % 3 else "r") for g, items in sets.items() for i in items], MATRIX)


@pytest.fixture(scope="module")
def matrices(spark):
    draw = random.Random(9)
    # object 0 is held by everybody, others by few
    item = lambda: int(400 * draw.random() ** 2) + 1
    stock = {f"stock {k:02}": {0, *(item() for _ in range(draw.randint(1, 40)))} for k in range(60)}
    stock["twin a"] = stock["twin b"] = {500, 501, 502}
    custom = {}
    for k in range(120):
        base = set(draw.choice(list(stock.values())))
        for _ in range(draw.randint(0, 12)):
            base.add(item())
        custom[f"mine {k:03}"] = {i for i in base if draw.random() < draw.choice([1, .9, .5])} | {0}
    custom["tied"], custom["alone"], custom["Equal "] = {500, 501}, {900}, stock["stock 07"]
    return custom, stock


def brute(custom, stock):
    out = {}
    for c, x in custom.items():
        scored = sorted((-len(x & y) / len(x | y), t, len(x & y), len(x | y)) for t, y in stock.items() if x & y)
        if scored:
            score, t, shared, union = scored[0]
            out[c.strip().lower()] = (t, shared, union)
    return out


def test_closest_templates(spark, matrices):
    custom, stock = matrices
    best, rounds = A.closest_templates(table(spark, custom), table(spark, stock))
    assert {r.custom: (r.template, r.shared, r.union) for r in best.collect()} == brute(custom, stock)
    assert sum(r.settled for r in rounds) > 60 and sum(r.candidates for r in rounds) < len(custom) * len(stock) / 3
    assert rounds[0].candidates < 1000 and [r.groups for r in rounds] == [123 - sum(x.settled for x in rounds[:i]) for i in range(len(rounds))]


@pytest.mark.parametrize("thresholds", [(0.3,), (1.0, 0.01)])
def test_any_threshold_gives_the_same(spark, matrices, thresholds):
    custom, stock = matrices
    best, _ = A.closest_templates(table(spark, custom), table(spark, stock), thresholds)
    assert {r.custom: (r.template, r.shared, r.union) for r in best.collect()} == brute(custom, stock)


def test_nothing_to_compare(spark, matrices):
    custom, stock = (table(spark, m) for m in matrices)
    for a, b in ((custom.limit(0), stock), (custom, stock.limit(0))):
        assert A.closest_templates(a, b)[0].collect() == []
    assert {r.template for r in A.jaccard_template(custom, stock.limit(0), 0.1, best=A.closest_templates(custom, stock.limit(0))[0]).collect()} == {None}


def test_matrices_are_made_once_per_query(spark, monkeypatch):
    """The large tables are joined once, however often a query asks for its matrices."""
    from workload import QUERIES, roles

    written = []
    write = roles.materialise
    monkeypatch.setattr(roles, "materialise", lambda df, name="step": written.append(name) or write(df, name))
    for name in ("grant_backfill", "matrix_diff"):
        written.clear()
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count()
        assert sorted(written) == ["grants_all", "seed_matrix", "staged_matrix"]
