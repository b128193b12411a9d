from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from carryover.functions import transforms as T
from carryover.operators import reconcile as R
from carryover.operators.merge import fk_remap, project_mapped, with_idmaps
from carryover.plans.circles import circles
from carryover.plans.lifecycle import Migration, Refused
from carryover.plans.preflight import Expectations, Preflight
from carryover.spec import ColumnInfo, TableClass, TableSpec, effective_spec, written, written_columns

PARENT = TableSpec("parent", TableClass.MERGE, columns={"id": ColumnInfo("bigint"), "code": ColumnInfo("varchar", length=5)},
                   key=("id",), merge_keys=("code",), surrogate_pk="id", archived={"import_archived_old": "old"})
CHILD = TableSpec("child", TableClass.COPY, columns={"id": ColumnInfo("bigint"), "parent_id": ColumnInfo("bigint"),
                                                     "n": ColumnInfo("int", nullable=False)},
                  key=("id",), fk_remap={"parent_id": "parent"})


def staging(spark, n="7"):
    return {"parent": spark.createDataFrame([(1, "x", "o1"), (2, "y", None), (3, "x", None)], "id bigint, code string, old string"),
            "child": spark.createDataFrame([(1, 1, 5), (2, 2, None), (3, 99, 6), (4, 3, 7)], "id bigint, parent_id bigint, n int")}


SEED = "id bigint, code string, import_archived_old string"


def test_run(spark, tmp_path):
    seed = {"parent": spark.createDataFrame([(50, "x", None)], SEED)}
    m = Migration(spark, staging(spark), seed, [CHILD, PARENT], str(tmp_path))
    assert m.preflight()[1].first().verdict == "go"
    m.apply()
    live = {r.id: (r.parent_id, r.n) for r in spark.read.parquet(f"{tmp_path}/live/child").collect()}
    assert live == {1: (50, 5), 2: (51, 0), 3: (None, 6), 4: (50, 7)}
    verified = m.verify()
    assert verified.where("rows > 0").count() == 0
    report = m.report(verified)
    assert report.where("section = 'verdict'").first()["item"] == "verdict: go"
    # a change behind its back is found
    tampered = spark.read.parquet(f"{tmp_path}/live/child").withColumn("n", F.col("n") + 1)
    tampered.write.parquet(f"{tmp_path}/tampered")
    spark.read.parquet(f"{tmp_path}/tampered").write.mode("overwrite").parquet(f"{tmp_path}/live/child")
    assert m.verify().where("item = 'n'").first()["rows"] == 4


def test_gate_refuses(spark, tmp_path):
    narrow = replace(PARENT, columns={**PARENT.columns, "code": ColumnInfo("varchar", length=0 + 1)})
    long = staging(spark)
    long["parent"] = long["parent"].withColumn("code", F.concat("code", F.lit("long")))
    m = Migration(spark, long, {"parent": spark.createDataFrame([], SEED)}, [narrow], str(tmp_path))
    with pytest.raises(Refused):
        m.apply()


def test_check_uses_the_writes_expression():
    """What the check compares is what the write selects."""
    for name in CHILD.carried:
        assert str(written(CHILD, name).alias(name)) in [str(c) for c in written_columns(CHILD)]


def test_effective_spec_reports():
    spec, notes = effective_spec(CHILD, ["ID", "N"], ["child"])
    assert list(spec.columns) == ["id", "n"] and spec.renames == {"id": "ID", "n": "N"}
    assert ("parent_id", "skipped") in notes and spec.fk_remap == {}


def test_remap_of_unknown_id(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id bigint, p bigint")
    idmap = spark.createDataFrame([(1, 100)], "old_id bigint, new_id bigint")
    assert [r.p for r in fk_remap(child, idmap, "p", True, ["id"]).orderBy("id").collect()] == [100, None, None]
    assert [r.p for r in fk_remap(child, idmap, "p", False, ["id"]).orderBy("id").collect()] == [100, 9, None]
    strict = replace(CHILD, columns={**CHILD.columns, "parent_id": ColumnInfo("bigint", nullable=False)})
    whole = ColumnInfo("bigint", primitive=True)
    assert [r.p for r in fk_remap(child, idmap, "p", whole, ["id"]).orderBy("id").collect()] == [100, 0, 0]
    zero = replace(CHILD, columns={**CHILD.columns, "parent_id": whole})
    assert [r.parent_id for r in project_mapped(staging(spark)["child"], zero, {"parent": idmap}).orderBy("id").collect()] == [100, 0, 0, 0]
    out = project_mapped(staging(spark)["child"], strict, {"parent": idmap})
    assert [r.parent_id for r in out.orderBy("id").collect()] == [100, 2, 99, 3]
    with pytest.raises(KeyError):  # a missing map must not turn references into NULL
        with_idmaps(staging(spark)["child"], CHILD, {}, ["id"])


def test_context_rewrite(spark):
    cases = [("/v/Docs/ctx/a/b.pdf", "/srv/new/a/b.pdf"), ("/x/Docs/ctx/", "/srv/new/"), ("/x/Docs/ctx", "/srv/new"),
             ("/x/Docs/ctx/a/../b", "/srv/new/b"), ("/x/Docs/ctx/../../etc", None), ("/x/Docs/ctx/../new/y", "/srv/new/y"), ("/x/y", None), (None, None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, p string")
    got = df.select("i", T.context_rewrite(F.col("p"), "Docs", "/srv/new").alias("n")).orderBy("i")
    assert [r.n for r in got.collect()] == [b for _, b in cases]


HTML = [('<img src="${t}my scan[1].png">', ["my scan[1].png"]), ("<img src='${t}a%20b.png#x'>", ["a b.png"]),
        ("<img src=${t}bare.png>", ["bare.png"]), ("<b style='background: URL( ${t}css.png )'>", ["css.png"]),
        ('<!-- <img src="${t}no.png"> --><p>', []), ('<script src="${t}yes.js">x="${t}no.js"</script>', ["yes.js"]),
        ('<img src="${t}a+b%2B.png&amp;x=1">', ["a b+.png"]), ('<img src="${t}&eacute;.png">', ["é.png"]), ("<!-- open ${t}x", [])]


def test_html_references(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HTML)], "i int, h string")
    got = {}
    for r in R.html_asset_refs(df, "i", "h", "${t}").collect():
        got.setdefault(r.i, []).append(r.ref)
    assert got == {i: refs for i, (_, refs) in enumerate(HTML) if refs}


def damaged(spark, path, change):
    """Replace a written table by a changed one."""
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(path + "_changed")
    spark.read.parquet(path + "_changed").write.mode("overwrite").parquet(path)


def wrong(m):
    return {(r.table_name, r["item"]): r["rows"] for r in m.verify().where("rows > 0").collect()}


def test_reference_to_a_copied_parent_arrives(spark, tmp_path):
    parent = TableSpec("p", columns={"id": ColumnInfo("bigint")}, key=("id",))
    child = TableSpec("c", columns={"id": ColumnInfo("bigint"), "pid": ColumnInfo("bigint"), "up": ColumnInfo("bigint")}, key=("id",),
                      fk_remap={"pid": "p", "up": "c"})
    given = {"p": spark.createDataFrame([(7,), (8,)], "id bigint"),
             "c": spark.createDataFrame([(1, 7, None), (2, 9, 1), (3, None, 99)], "id bigint, pid bigint, up bigint")}
    m = Migration(spark, given, {}, [child, parent], str(tmp_path))
    found = {(r.finding_id, r.column_name): r["rows"] for r in m.preflight()[0].collect()}
    assert found == {("reference-without-parent", "pid"): 1, ("reference-without-parent", "up"): 1}
    m.apply()
    rows = {r.id: (r.pid, r.up) for r in spark.read.parquet(f"{tmp_path}/live/c").collect()}
    assert rows == {1: (7, None), 2: (None, 1), 3: (None, None)} and wrong(m) == {}
    damaged(spark, f"{tmp_path}/live/c", lambda df: df.withColumn("pid", F.lit(None).cast("bigint")))
    assert wrong(m)["c", "pid: lost references"] == 1
    damaged(spark, f"{tmp_path}/live/c", lambda df: df.union(df.limit(1).withColumn("id", F.lit(77).cast("bigint"))))
    assert wrong(m)["c", "(surplus)"] == 1


def test_merge_that_refers_to_itself_and_circles(spark, tmp_path):
    tree = TableSpec("t", TableClass.MERGE, columns={"id": ColumnInfo("bigint"), "code": ColumnInfo("varchar", length=5), "up": ColumnInfo("bigint")},
                     key=("id",), merge_keys=("code",), surrogate_pk="id", fk_remap={"up": "t"})
    schema = "id bigint, code string, up bigint"
    given = {"t": spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2), (4, "x", 3)], schema)}
    m = Migration(spark, given, {"t": spark.createDataFrame([(50, "a", None)], schema)}, [tree], str(tmp_path))
    m.apply()
    rows = {r.code: (r.id, r.up) for r in spark.read.parquet(f"{tmp_path}/live/t").collect()}
    assert rows == {"a": (50, None), "b": (51, 50), "c": (52, 51), "x": (53, 52)} and wrong(m) == {}
    damaged(spark, f"{tmp_path}/live/t", lambda df: df.where("code <> 'c'"))
    assert wrong(m) == {("t", "appended and there"): 1, ("t", "(row count)"): 1}
    # two tables that renumber each other, and a third that hangs on one of them
    a, b = replace(tree, fk_remap={"up": "u"}), replace(tree, name="u", fk_remap={"up": "t"})
    leaf = TableSpec("leaf", columns={"id": ColumnInfo("bigint"), "up": ColumnInfo("bigint")}, key=("id",), fk_remap={"up": "u"})
    others = spark.createDataFrame([(7, "p", 4), (8, "a", 1), (9, "q", 77), (10, "a", 2)], schema)
    seeds = {"t": spark.createDataFrame([(50, "a", None)], schema), "u": spark.createDataFrame([(3, "p", None), (200, "z", 3)], schema)}
    staged = {"t": given["t"].withColumn("up", F.col("id") + 6), "u": others, "leaf": spark.createDataFrame([(1, 8), (2, 10), (3, None)], "id bigint, up bigint")}
    m = Migration(spark, staged, seeds, [leaf, a, b], str(tmp_path / "circle"))
    assert [[s.name for s in g] for g in m.groups()] == [["t", "u"], ["leaf"]]
    m.apply()
    live = lambda name: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/circle/live/{name}").select(*(["id", "code", "up"] if name != "leaf" else ["id", "up"])).collect()))
    assert live("t") == [(50, "a", None), (51, "b", 201), (52, "c", 202), (53, "x", 203)]
    assert live("u") == [(3, "p", None), (200, "z", 3), (201, "a", 50), (202, "q", None), (203, "a", 51)]
    assert live("leaf") == [(1, 201), (2, 203), (3, None)] and wrong(m) == {}
    damaged(spark, f"{tmp_path}/circle/live/u", lambda df: df.withColumn("up", F.when(F.col("id") == 203, 50).otherwise(F.col("up"))))
    assert wrong(m) == {("u", "appended as written"): 1}
    # ids that depend on the references that need them cannot be settled in two passes
    tied = Migration(spark, staged, seeds, [replace(a, merge_keys=("code", "up")), b], str(tmp_path / "tied"))
    with pytest.raises(Refused):
        tied.apply()


def test_merge_without_surrogate_and_archive_homes(spark, tmp_path):
    names = TableSpec("n", TableClass.MERGE, columns={"code": ColumnInfo("varchar", length=5), "v": ColumnInfo("int")}, key=("code",), merge_keys=("code",))
    old, gone = TableSpec("old", TableClass.ARCHIVE, columns={"v": ColumnInfo("int")}), TableSpec("gone", TableClass.DROP, columns={"v": ColumnInfo("int")})
    schema = "code string, v int"
    given = {"n": spark.createDataFrame([("a", 1), ("b", 2)], schema), "old": spark.createDataFrame([(1,)], "v int"), "gone": spark.createDataFrame([(2,)], "v int")}
    m = Migration(spark, given, {"n": spark.createDataFrame([("a", 9)], schema)}, [names, old, gone], str(tmp_path))
    m.apply()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/live/n").collect())) == [("a", 9), ("b", 2)] and wrong(m) == {}
    assert not (tmp_path / "live" / "old").exists() and not (tmp_path / "live" / "gone").exists()
    assert spark.read.parquet(f"{tmp_path}/kept/archive/old").count() == 1
    assert m.gate().first().may_release and not m.gate(spark.createDataFrame([("extra", 2)], "claim string, rows bigint")).first().may_release
    damaged(spark, f"{tmp_path}/live/n", lambda df: df.where("code <> 'b'"))
    assert wrong(m) == {("n", "appended and there"): 1, ("n", "(row count)"): 1}
    damaged(spark, f"{tmp_path}/kept/archive/old", lambda df: df.withColumn("v", F.col("v") + 1))
    assert m.gate().first().asDict() == {"homes": 4, "homes_not_verified": 1, "mapping_violations": 0, "may_release": False}


def test_accepted_class_changes_the_verdict(spark, tmp_path):
    spec = TableSpec("t", columns={"id": ColumnInfo("bigint"), "name": ColumnInfo("varchar", length=20)}, key=("id",), charset_scan=("name",))
    given = {"t": spark.createDataFrame([(1, "caf\u00c3\u00a9"), (1, "x")], "id bigint, name string")}
    m = Migration(spark, given, {}, [spec], str(tmp_path))
    assert {r.finding_id for r in m.preflight()[0].collect()} == {"key-repeats", "charset-repairable"}
    given = {"t": given["t"].where("name <> 'x'")}
    assert Migration(spark, given, {}, [spec], str(tmp_path)).preflight()[1].first().verdict == "go-with-acknowledgements"
    assert Migration(spark, given, {}, [spec], str(tmp_path), accepted=["charset-repair"]).preflight()[1].first().verdict == "go"


def test_circles():
    assert circles({"a": ["b"], "b": ["c"], "c": ["b"], "d": [], "e": ["a", "x"]}) == [["b", "c"], ["a"], ["d"], ["e"]]
    assert circles({"a": ["a"], "b": ["a"]}) == [["a"], ["b"]] and circles({}) == []
    ring = {str(i): [str((i + 1) % 50)] for i in range(50)}
    assert circles(ring) == [list(ring)]


def expecting(spark, tmp_path):
    names = TableSpec("names", TableClass.COPY, columns={"id": ColumnInfo("int"), "label": ColumnInfo("varchar", length=4), "file": ColumnInfo("varchar", length=90)},
                      key=("id",), charset_scan=("label",), dropped={"note": lambda: F.col("note") != ""})
    uses = TableSpec("uses", columns={"id": ColumnInfo("bigint"), "name_id": ColumnInfo("int", primitive=True), "strict_id": ColumnInfo("int", nullable=False),
                                      "code": ColumnInfo("varchar", length=9, collation="ci")}, key=("code",), fk_remap={"name_id": "names", "strict_id": "names"})
    given = {"names": spark.createDataFrame([(1, "caf\u00c3\u00a9", "a/x.png", ""), (2, "toolong", "b\\\\x.png", "kept?"), (2, "ok", "a/x.png", ""), (-1, "ok", "", "")], "id int, label string, file string, note string"),
             "uses": spark.createDataFrame([(1, 1, 1, "A", 5), (2, 9, 9, "a ", 5), (3, -1, 2, "b", None), (4, None, None, "c", 1)], "id bigint, name_id bigint, strict_id bigint, code string, `odd name` int"),
             "ghost": spark.createDataFrame([(1,)], "x int"), "empty": spark.createDataFrame([], "x int")}
    for name, df in list(given.items()):
        df.write.parquet(f"{tmp_path}/staged/{name}")
        given[name] = spark.read.parquet(f"{tmp_path}/staged/{name}")
    schema = spark.createDataFrame([("names", "id", "bigint"), ("names", "label", "int"), ("names", "gone", "int"), ("lost", "x", "int")], "table_name string, column_name string, data_type string")
    pristine = spark.createDataFrame([("names", "copy", 1, False, 0), ("uses", "merge", 0, False, 0)], "table_name string, class string, expected bigint, tolerated boolean, startup_rows int")
    seed = {"names": given["names"].limit(3), "uses": given["uses"].limit(2)}
    expect = Expectations(required={"names": lambda: F.col("label") == "none", "uses": lambda: F.col("id") > 3}, sentinels={("uses", "name_id"): -1},
                          paths={"names": "file"}, schema=schema, pristine=pristine)
    return Migration(spark, given, seed, [names, uses], str(tmp_path / "out"), expect=expect)


def test_every_check_of_a_preflight(spark, tmp_path):
    m = expecting(spark, tmp_path)
    found = {(r.finding_id, r.table_name, r.column_name): (r["rows"], r.severity, r.accept) for r in m.preflight()[0].collect()}
    blocker, advisory = "blocker", "advisory"
    assert found == {
        ("value-width", "names", "label"): (2, blocker, None), ("key-repeats", "names", "id"): (1, blocker, None), ("key-repeats", "uses", "code"): (1, blocker, None),
        ("charset-repairable", "names", "label"): (1, blocker, "charset-repair"), ("value-without-home", "names", "note"): (1, advisory, None),
        ("reference-becomes-zero", "uses", "name_id"): (1, advisory, None), ("reference-without-parent", "uses", "strict_id"): (1, blocker, "keep-raw-references"),
        ("sentinel-is-a-key", "names", "id"): (1, blocker, None), ("required-rows-missing", "names", None): (1, blocker, "missing-required-rows"),
        ("ambiguous-file-name", "names", "file"): (1, blocker, "ambiguous-file-names"), ("unknown-table", "ghost", None): (1, blocker, "leave-unknown-tables"),
        ("unknown-column-unsafe-name", "uses", "odd name"): (4, blocker, None), ("schema-lossless-widening", "names", "id"): (4, "info", None),
        ("schema-type-change", "names", "label"): (4, blocker, "schema-differs"), ("schema-missing-column", "names", "gone"): (1, blocker, "schema-differs"),
        ("schema-missing-table", "lost", "x"): (1, blocker, "schema-differs"), ("target-not-pristine", "names", None): (2, blocker, "target-not-pristine")}
    with pytest.raises(Refused):
        m.apply()


def test_a_preflight_scans_each_table_once(spark, tmp_path):
    m = expecting(spark, tmp_path)
    checks = Preflight(spark, m.staging, m.seed, m._specs, m.expect)
    for name in m.staging:
        plan = checks.tally(name)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1, plan
    # what is read later are the tallies; neither the gate nor the report checks again
    m.preflight()
    spark.sparkContext.setJobGroup("again", "")
    with pytest.raises(Refused):
        m.apply()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("again")
    assert len(jobs) <= 2


def test_not_checked_is_not_passed(spark, tmp_path):
    spec = TableSpec("t", columns={"id": ColumnInfo("bigint")}, key=("id",), archived={"import_archived_v": "v"})
    given = {"t": spark.createDataFrame([(1, "a"), (2, None)], "id bigint, v string")}
    m = Migration(spark, given, {}, [spec], str(tmp_path / "a"))
    m.apply()
    assert wrong(m) == {} and m.verify().where("item = 'import_archived_v: archived values'").first()["rows"] == 0
    damaged(spark, f"{tmp_path}/a/live/t", lambda df: df.withColumn("import_archived_v", F.lit(None).cast("string")))
    assert wrong(m) == {("t", "import_archived_v"): 1, ("t", "(row)"): 1, ("t", "import_archived_v: archived values"): 1}
    m = Migration(spark, given, {}, [spec], str(tmp_path / "a"), rewritten={"t": "renumbering"})
    verified = m.verify()
    assert [(r["item"], r["rows"]) for r in verified.collect()] == [("not checked: rewritten on purpose (renumbering)", None)]
    assert m.report(verified).where("section = 'not checked'").first()["item"] == "t: not checked: rewritten on purpose (renumbering)"


@pytest.mark.parametrize("exclude", [None, lambda: F.col("id") == 3])
def test_a_merge_numbers_its_rows_once(spark, tmp_path, monkeypatch, exclude):
    """Twins of all kinds keep the map of :func:`idmap_twins`; a table in a circle is judged and numbered once."""
    from carryover.operators import merge as M

    calls = []
    for name in ("judge", "with_ordinal"):
        monkeypatch.setattr(M, name, lambda *a, plain=getattr(M, name), name=name, **b: calls.append(name) or plain(*a, **b))
    schema = "id bigint, code string, up bigint"
    alone = TableSpec("t", TableClass.MERGE, columns={"id": ColumnInfo("bigint"), "code": ColumnInfo("varchar", length=5, collation="ci"), "up": ColumnInfo("bigint")},
                      key=("id",), merge_keys=("code",), surrogate_pk="id", merge_exclude=exclude)
    codes = ["a", "B", "b", "A ", None, "n", "n", None, "a", "z"]
    src = spark.createDataFrame([(i + 1, c, 9 - i) for i, c in enumerate(codes)], schema)
    seed = spark.createDataFrame([(90, "A", None), (70, "a", 1), (80, "n", None)], schema)
    for spec in (alone, replace(alone, fk_remap={"up": "t"})):
        calls.clear()
        m = Migration(spark, {"t": src}, {"t": seed}, [spec], str(tmp_path / str(len(spec.fk_remap))))
        m.apply()
        assert calls == ["judge", "with_ordinal"]
        live = m._read("live", "t")
        assert sorted(map(tuple, m._read("idmap", "t").collect())) == sorted(map(tuple, M.idmap_twins(src, live, alone).collect()))
        left = [i for i, c in enumerate(codes, 1) if (c or "").strip().lower() not in ("a", "n") and not (exclude and i == 3)]
        assert sorted(r.id for r in live.select("id").collect()) == [70, 80, 90, *range(91, 91 + len(left))] and wrong(m) == {}
        plain = M.merge_overridden(M.judge(src, seed, alone)).first().asDict()
        assert m._read("overridden", "t").first().asDict() == plain
