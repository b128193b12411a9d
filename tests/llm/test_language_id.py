from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carryover.llm import language_id as L

SF = "/root/testdata/sf0.01"


def plain(texts):
    """Trigram counts, text by text."""
    out = np.zeros((len(texts), L.DIMENSIONS))
    for i, text in enumerate(texts):
        c = []
        for b in b" " + (text or "").encode() + b" ":
            k = int(L.CLASS[b])
            if k or not c or c[-1]:
                c.append(k)
        for j in range(len(c) - 2):
            out[i, ((((c[j] << 16) | (c[j + 1] << 8) | c[j + 2]) * 2654435761) & 0xFFFFFFFF) >> 18] += 1
    return out


@pytest.mark.parametrize("group", [1 << 20, 64])
def test_vectors_against_plain_counting(group, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(L, "GROUP_BYTES", group)
    texts = ["Hello, World!!  again", None, "", " ", "é à", "a", "x" * 30, "one  two%%%three " * 9, "##", "é" * 40]
    got = np.zeros((len(texts), L.DIMENSIONS))
    for start, counts in L.counted(*L.binary_parts(pa.array(texts))):
        got[start:start + len(counts)] = counts
    want = plain(texts)
    long = [i for i, t in enumerate(texts) if len((t or "").encode()) > group]
    for i in range(len(texts)):
        if i not in long:
            assert (got[i] == want[i]).all(), texts[i]
        else:  # a cut may split a run of spaces
            assert np.abs(got[i] - want[i]).sum() <= 4 * len(texts[i]) / group + 4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    part = L.fold("doc_id", 5)
    got = L.language_id(docs, docs.where(part != 0), held_out=part == 0).toPandas()
    truth = docs.select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(both) == 1000 and both.held_out.sum() == sum(zlib.crc32(str(d).encode()) % 5 == 0 for d in both.doc_id)
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert both.score.between(0, 1).all() and both.rejected.mean() < 0.01


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, score int, slots string"
    words = {"aa": "kala bala mala ", "bb": "stroz vrizt prutz "}
    rows = [(i, words[k] * (i % 5 + 1), k, 1, "s") for i, k in enumerate(["aa", "bb"] * 20)]
    docs = spark.createDataFrame(rows, schema)
    odd = spark.createDataFrame([(1, None, None, 1, ""), (2, "", "aa", 1, ""), (3, "123 %%", "aa", 1, ""), (4, "kala mala", None, 1, ""), (None, "vrizt", "x", 1, ""),
                                 (4, "kala mala", None, 1, ""), (5, "你好你好", None, 1, ""), (6, "prutz " * 100000, None, 1, "")], schema)
    got = sorted(map(tuple, L.language_id(odd, docs).select("doc_id", "lang_pred", "rejected").collect()), key=str)
    assert got == sorted([(1, "und", True), (2, "und", True), (3, "und", True), (4, "aa", False), (4, "aa", False), (None, "bb", False), (5, "aa", True), (6, "bb", False)], key=str)
    assert L.language_id(odd.limit(0), docs).collect() == []
    assert {r.lang_pred for r in L.language_id(odd, docs.limit(0)).collect()} == {"und"}


@pytest.fixture(scope="module")
def learned(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")


def test_every_centroid_stands_for_many_texts(learned):
    rows = learned.distinct().toPandas()
    idf = np.ones(L.DIMENSIONS, np.float32)
    for lang, texts in rows.groupby("lang")["text"]:
        x = L._scaled(plain(list(texts)).astype(np.float32), idf)
        centres = L.clustered(x, 4, 8)
        size = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres))
        assert len(centres) >= 2 and size.min() >= L.LEAST_SHARE * len(x), (lang, size)
        assert np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-4)
    same = np.repeat(x[:1], 50, axis=0)
    assert len(L.clustered(same, 4, 8)) == 1 and len(L.clustered(x[:1], 4, 8)) == 1


def test_copies_count_once_in_the_sample(spark):
    copies = spark.range(100_000).select(F.lit("the very same text " * 3).alias("text"), F.lit("aa").alias("lang"))
    others = spark.range(700).select(F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 690, "bb").otherwise("aa").alias("lang"))
    drawn = L.drawn_texts(copies.unionByName(others), 300).collect()
    assert len({(r.lang, r.text) for r in drawn}) == len(drawn)
    assert sum(r.lang == "aa" for r in drawn) == 11 and sum(r.lang == "bb" for r in drawn) == 300
    langs, centroids, floors, _ = L.fit(copies.unionByName(others), sample=300)
    assert set(langs) == {"aa", "bb"} and len(centroids) == len(langs) == len(floors)


def test_predictions_by_hand(spark, learned):
    """Document frequencies, vectors, cosines and the floor recomputed text by text."""
    rows = [r.text for r in learned.collect()]
    langs, centroids, floors, idf = L.fit(learned)
    counts = plain(rows)
    assert np.allclose(idf, np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1, atol=1e-4)
    vectors = np.log1p(counts) * idf
    cosine = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ centroids.T
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in L.language_id(docs, learned).collect()}
    for i, c in enumerate(cosine):
        best = int(c.argmax())
        sure = c[best] - np.max(np.where(np.array(langs) == langs[best], -1, c)) > 1e-4
        assert not sure or got[i].lang_pred == langs[best]
        assert got[i].score == pytest.approx(c[best], abs=1e-4)
        assert abs(c[best] - floors[best]) < 1e-4 or got[i].rejected == (c[best] < floors[best])
