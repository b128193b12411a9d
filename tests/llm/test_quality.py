from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from carryover.llm import quality as Q


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    got = Q.quality_scores(docs, labels.where(~out), ["quality", "toxic"], F.col("source"), F.col("lang")).toPandas()
    assert len(got) == docs.count()
    both = got.merge(labels.where(out).toPandas(), on="doc_id")
    for name in ("quality", "toxic"):
        right = ((both[f"p_{name}"] >= 0.5) == (both[name] == 1)).mean()
        common = max((both[name] == 1).mean(), (both[name] == 0).mean())
        assert right > common + {"quality": 0.95, "toxic": 0.4}[name] * (1 - common), (name, right, common)


def test_posteriors_by_hand(spark):
    rows = [("a", "x", 100.0, 90.0), ("a", "y", 2.0, 0.0), ("b", "x", 50.0, 5.0), ("b", None, 1.0, 1.0), (None, None, 40.0, 20.0)]
    sites, corpus = Q.site_posteriors(spark.createDataFrame(rows, "host string, path string, n double, good double"))
    got = {(r.host, r.path): r.rate for r in sites.collect()}
    assert corpus == pytest.approx(117 / 195)
    assert got["a", "x"] > 0.85 and got["b", "x"] < 0.15
    # two bad rows move the sparse path away from its good host, but not to zero
    assert 0 < got["a", "y"] < got["a", "x"] and got["b", None] > got["b", "x"] and abs(got[None, None] - 0.5) < 0.05


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, source string, lang string, z int, host string"
    label = "doc_id bigint, quality int, text string"
    rows = [(i, ("good words here " if i % 2 else "bad ### stuff ") * (1 + i % 7), "s", None, 1, "h") for i in range(60)]
    rows += [(100, None, None, "en", 1, ""), (101, "", "s", "en", 1, ""), (None, "good words", "s", None, 1, ""), (1, "good words here", "s", None, 1, ""), (102, "good " * 300000, "t", "t", 1, "")]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    marks = [(i, i % 2, "t") for i in range(60)] + [(3, None, ""), (5, 1, ""), (999, 1, ""), (None, 1, "")]
    run = lambda d, m: Q.quality_scores(d, m, ["quality"], F.col("source"), F.col("lang"), rounds=60)
    got = run(docs, spark.createDataFrame(marks, label)).collect()
    assert len(got) == len(rows) and all(0 <= r.p_quality <= 1 for r in got)
    assert all((r.p_quality > .5) == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id < 60)
    assert run(docs.limit(0), spark.createDataFrame(marks, label)).collect() == []
    assert {round(r.p_quality, 6) for r in run(docs, spark.createDataFrame([], label)).collect()} == {0.5}
