from __future__ import annotations

from collections import defaultdict

import corpus_pipeline as P
from carryover.llm import queries as Q
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_mixing import goals

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_against_brute_force(spark):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    for name, stage in P.STAGES:
        before = sorted(docs.collect(), key=lambda r: r.doc_id)
        docs = P.materialise(stage(spark, docs, SF), name)
        after = docs.collect()
        steps.append((name, len(before), len(after)))
        ids = {r.doc_id for r in after}
        if name != "source_mixing":
            assert docs.columns == columns and {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "language_id":
            assert len(ids) >= 0.98 * len(before) and all(any(c.isalpha() for c in r.text) for r in after)
        elif name == "exact_dedup":
            best = defaultdict(int)
            for r in before:
                best[r.text] = max(best[r.text], r.doc_id)
            assert ids == set(best.values())
        elif name == "jaccard_join":
            found = groups([(r.doc_id, r.text) for r in before], 5, 80)
            assert ids == {doc for doc, _, component in found if doc == component}
        elif name == "decontamination":
            found = hits([(r.doc_id, r.text) for r in before], bench)
            assert ids == {doc for doc, *_, bad in found if not bad}
        else:
            sizes, taken = defaultdict(int), defaultdict(int)
            for r in after:
                sizes[r.source] += r["size"]
                taken[r.source] += r.taken
            want = goals(sizes, (5, 2, 1), 3)
            assert all(abs(taken[s] - want[s]) <= max(r["size"] for r in after if r.source == s) for s in want)
    assert steps[1][2] < steps[1][1] and steps[2][2] < steps[2][1] and steps[3][2] < steps[3][1], steps
    assert sorted(map(tuple, after)) == sorted(map(tuple, P.run(spark, SF).collect()))


def test_odd_documents(spark):
    long = " ".join(f"word{i % 977} the of" for i in range(20000))
    rows = [(i, f"The text of document {i} is about thing number {i * i} and so on {' and on' * (i % 9)}", "en", f"s{i % 3}", 5) for i in range(60)]
    rows += [(None, rows[3][1], "en", None, None), (None, rows[3][1], "en", None, None), (7, rows[7][1], "en", "s1", 5), (100, None, None, None, None), (101, "", "en", "", 0),
             (102, "12 34", "en", "s", 1), (103, long, "en", "s", 1), (104, long + " tail", "en", "s", 1), (7, "Another text under the same id, quite unlike the first one", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, SF), "odd")
    got = [r.doc_id for r in docs.collect()]
    assert got.count(7) == 2 and 103 in got and 104 not in got and not {100, 101, 102} & set(got)
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, SF), "none")
    assert docs.collect() == []


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "source_mixing"]


def test_rows_are_judged_whatever_their_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").select("text").first()[0]
    base = " ".join(f"the word{i} of" for i in range(80))
    near, other = base + " and more", " ".join(f"a thing{i} is" for i in range(80))
    rows = [(1, base), (None, near), (5, near + " still"), (5, other), (None, other), (9, "A text that shares its id with a leak and is clean itself"), (9, item),
            (None, "Here it is: " + item), (None, "A text without an id that resembles nothing else at all"), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    for _, stage in P.STAGES[1:4]:
        docs = P.materialise(stage(spark, docs, SF), "rows")
    got = sorted(((r.doc_id or 0), r.text or "") for r in docs.collect())
    assert got == sorted([(1, base), (5, other), (9, rows[5][1]), (0, rows[8][1]), (0, "")])
