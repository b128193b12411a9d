from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from carryover.llm import license_scan as S


def words(text):
    return re.findall(r"[0-9a-z\x80-\xff]+", (text or "").encode().decode("latin-1").lower().translate({i: i for i in range(256)}))


def bigrams(w):
    return {tuple(w[i:i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def brute(text, templates, threshold):
    known = [(name, bigrams(words(t))) for name, texts in templates.items() for t in texts]
    sizes = {len(t) for _, t in known}
    matches, begin = set(), 0
    units = []
    for line in (text or "").split("\n"):
        units.append((begin, words(line)))
        begin += len(units[-1][1])
    units.append((0, words(text)))
    for start, w in units:
        n = max(len(w) - 1, min(len(w), 1))
        for at, span in [(0, w), *((i, w[i:i + m + 1]) for m in sizes if n > m for i in range(n - m + 1))]:
            s = bigrams(span)
            for name, t in known:
                dice = 2 * len(s & t) / (len(s) + len(t)) if s else 0
                if dice >= threshold - 1e-12:
                    matches.add((dice, start + at, start + at + max(2, len(span)), name))
    return S.Scanner.closest(list(matches))


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_against_brute_force(threshold):
    draw = random.Random(4)
    notices = [t for texts in S.TEMPLATES.values() for t in texts]
    texts = [None, "", " \n ", "MIT", "é"]
    for _ in range(120):
        parts = []
        for _ in range(draw.randint(0, 3)):
            w = draw.choice(notices).split()
            for _ in range(draw.randint(0, 1 + len(w) // 10)):
                w[draw.randrange(len(w))] = draw.choice(["foo", "the", "LICENSE"])
            parts.append(" ".join(w))
        parts += [" ".join(draw.choice(["the", "of", "license", "under", "foo", "bär"]) for _ in range(draw.randint(0, 30))) for _ in range(2)]
        draw.shuffle(parts)
        texts.append(draw.choice(["\n", " ", " -- "]).join(parts))
    got = S.Scanner(S.TEMPLATES, threshold).scan(pa.array(texts, pa.string()))
    for text, found in zip(texts, got):
        assert {k: round(v, 9) for k, v in found.items()} == {k: round(v, 9) for k, v in brute(text, S.TEMPLATES, threshold).items()}, text


def test_long_licence_texts_take_linear_time():
    """A file of a megabyte that is nothing but licences, and one line over and over."""
    import time

    scanner = S.Scanner(S.TEMPLATES, 0.8)
    five = "\n\n".join(S.TEMPLATES[n][-1] for n in ("MIT", "ISC", "BSD", "Apache-2.0", "AGPL"))
    for text, names in ((five * 320, {"MIT", "ISC", "BSD", "Apache-2.0", "AGPL"}), ("Released under the MIT License.\n" * 32000, {"MIT"})):
        assert len(text) > 1_000_000
        started = time.process_time()
        assert set(scanner.scan(pa.array([text]))[0]) == names
        assert time.process_time() - started < 20


def test_relatives_are_told_apart():
    scanner = S.Scanner(S.TEMPLATES, 0.8)
    for name in ("GPL", "LGPL", "AGPL"):
        for notice in S.TEMPLATES[name]:
            assert scanner.scan(pa.array([f"Copyright 2020 somebody.\n{' '.join(notice.split())}\nsome code here"]))[0].keys() == {name}


def test_templates_from_files(spark, tmp_path):
    draw = random.Random(1)
    long = " ".join(draw.choice(["grant", "of", "patent", "the", "work", "you", "may", "not", f"clause{draw.randint(1, 300)}"]) for _ in range(3000))
    (tmp_path / "Long-1.0.txt").write_text(long)
    (tmp_path / "Short").write_text("do what you like with it")
    own = S.license_texts(spark, str(tmp_path))
    assert set(own) == {"Long-1.0", "Short"}
    texts = ["preface of many words " * 20 + long.replace("patent", "Patent!", 1) + " tail" * 50, "you may do what you like with it", "Released under the MIT License.", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.licenses for r in S.license_scan(docs, templates={**S.TEMPLATES, **own}).collect()}
    assert got == {0: "Long-1.0", 1: "Short", 2: "MIT", 3: ""}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in S.license_scan(docs).collect()}
    assert len(got) == 1000
    for r in docs.collect():
        # every planted notice is found and nothing else
        named = [n for n, sign in (("MIT", "MIT License"), ("Apache-2.0", "Apache License"), ("GPL", "GNU General"), ("CC-BY-NC", "CC BY-NC")) if sign in r.text]
        assert set(named) == set(filter(None, got[r.doc_id].licenses.split(",")))
        if named:
            assert got[r.doc_id].best_license in named


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, licenses int"
    assert S.license_scan(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None, 1), (1, "Released under the MIT License.", 1), (1, "Released under the MIT License.", 1), (2, "x " * 300000 + "\nreleased UNDER the mit license", 1)]
    got = S.license_scan(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.licenses, r.best_license, r.best_dice) for r in got) == [("1", "MIT", "MIT", 1.0), ("1", "MIT", "MIT", 1.0), ("2", "MIT", "MIT", 1.0), ("None", "", None, 0.0)]


def test_few_templates_are_measured_on_short_runs(monkeypatch):
    """Bounds leave the result as it is, and little to do on a text that is nothing but licences."""
    import numpy as np

    five = "\n\n".join(S.TEMPLATES[n][-1] for n in ("MIT", "ISC", "BSD", "Apache-2.0", "AGPL"))
    texts = pa.array([five * 3, five.replace("the ", "a ") + "\nReleased under the MIT License, or so.\n", "No licence here at all, only some words.", None])

    class Counted(np.ndarray):
        taken = 0

        def __getitem__(self, at):
            if isinstance(at, tuple) and len(at) == 2 and np.isscalar(at[0]):
                Counted.taken += 1
            return np.asarray(super().__getitem__(at)) if isinstance(at, tuple) else super().__getitem__(at)

    results, taken = [], []
    for short in (0, 2000):
        monkeypatch.setattr(S, "SHORT", short)
        scanner = S.Scanner(S.TEMPLATES, 0.8)
        scanner.holds = scanner.holds.view(Counted)
        Counted.taken = 0
        results.append(scanner.scan(texts))
        taken.append(Counted.taken)
    assert results[0] == results[1] and results[0][0] and taken[1] < taken[0] / 2
