from __future__ import annotations

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from carryover.sources import audit_log, catalog, export, policy, snapshots, windows
from carryover.streaming.triage import triage_stream


def test_windows_resume_after_a_lost_confirmation(spark, tmp_path):
    src = spark.range(-5, 1000).withColumn("v", F.col("id") * 2)
    ledger = windows.WindowLedger(spark, str(tmp_path / "ledger"), "digest-1")
    out = str(tmp_path / "copy")
    assert windows.copy_windows(src, "id", out, "t", ledger, size=100, limit=3) == 3
    assert ledger.confirmed().count() == 3
    # a window written but never confirmed is simply written again
    stale = src.where("id BETWEEN 300 AND 350").withColumn("window", windows.window_id(F.col("id"), -5, 100))
    stale.withColumn("v", F.lit(-1).cast("bigint")).write.mode("append").partitionBy("window").parquet(out)
    assert windows.copy_windows(src, "id", out, "t", ledger, size=100) == 8
    assert windows.copy_windows(src, "id", out, "t", ledger, size=100) == 0
    got = spark.read.parquet(out)
    assert got.count() == 1005 and got.where("v <> id * 2").count() == 0
    assert windows.WindowLedger(spark, str(tmp_path / "ledger"), "digest-2").confirmed().count() == 0


def test_window_span_is_refused():
    with pytest.raises(windows.TooManyWindows):
        windows.check_span(0, 50_000 * 200_001)
    assert windows.check_span(0, 50_000 * 200_001, max_windows=10**6) > 200_000


def test_window_numbers_are_exact_above_2_to_53(spark):
    low = -(2**62)
    df = spark.createDataFrame([(low,), (low + 49_999,), (low + 50_000,), (2**62 + 7,)], "id bigint").select("id", windows.window_id(F.col("id"), 0).alias("w"))
    assert {r.id: r.w for r in df.collect()} == {k: k // 50_000 for k in (low, low + 49_999, low + 50_000, 2**62 + 7)}


def test_window_with_other_values_is_not_confirmed(spark, tmp_path, monkeypatch):
    src = spark.range(0, 300).withColumn("v", F.col("id") * 2)
    ledger = windows.WindowLedger(spark, str(tmp_path / "ledger"), "d")
    plain = windows.grouped_digest
    seen = []

    def other_on_disk(df, *args, **kwargs):  # the second digest is the one of the stored rows
        seen.append(df)
        return plain(df if len(seen) % 2 else df.withColumn("v", F.when(F.col("id") == 150, -1).otherwise(F.col("v")).cast("bigint")), *args, **kwargs)

    monkeypatch.setattr(windows, "grouped_digest", other_on_disk)
    with pytest.raises(windows.Unconfirmed):
        windows.copy_windows(src, "id", str(tmp_path / "copy"), "t", ledger, size=100)
    assert sorted(r.window for r in ledger.confirmed().collect()) == [0, 2]
    monkeypatch.setattr(windows, "grouped_digest", plain)
    assert windows.copy_windows(src, "id", str(tmp_path / "copy"), "t", ledger, size=100) == 1


def test_csv_files_keep_null_empty_binary_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(2, None, bytearray(b"\x00\xff")), (1, "", None), (3, 'a "q", b\nline', bytearray(b""))],
                               "id int, t string, b binary")
    assert export.export_csv(df, str(tmp_path / "csv"), ["id"]) == 3
    raw = "".join(open(f, encoding="utf-8", newline="").read().split("\n", 1)[1] for f in sorted(glob.glob(str(tmp_path / "csv" / "part-*"))))
    assert '1,"",' in raw and "2,,00FF" in raw
    assert [r[0] for r in csv.reader(raw.splitlines(True))] == ["1", "2", "3"]
    assert [r.line for r in export.csv_lines(df.orderBy("id")).collect()][:2] == ['"1","",', '"2",,"00FF"']


def test_snapshots_refuse_a_conflict(spark):
    a, b = spark.range(5), spark.range(6)
    tables, report = snapshots.snapshot_union_checked([{"x": a, "y": a}, {"X": a.repartition(3), "z": b}])
    assert sorted(tables) == ["x", "y", "z"] and report.where("state = 'duplicate'").count() == 1
    with pytest.raises(ValueError):
        snapshots.snapshot_union_checked([{"x": a}, {"x": b}])


def test_policy(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert policy.column_policy_view(df, "T", hidden={"t": ["B"]}, restricted=[]).columns == ["a"]
    for hidden, restricted in (({}, ["T"]), ({"t": ["a", "b"]}, [])):
        with pytest.raises(policy.Restricted):
            policy.column_policy_view(df, "t", hidden=hidden, restricted=restricted)


def log_line(uri, *messages):
    return json.dumps({"transaction": {"request": {"uri": uri}, "messages": list(messages)}})


LINES = [log_line("/a?patient=1", {"message": "m1", "details": {"ruleId": "9", "match": "ARGS (Value: secret"}}),
         "not json", log_line("/b"), log_line("", {"message": "m2"}), "{}"]


def test_triage_batch_and_stream_agree(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text("\n".join(LINES[:2]))
    (tmp_path / "log" / "2.json").write_text("\n".join(LINES[2:]))
    wanted = {("9", "ARGS (value redacted)", "/a", "m1"), ("?", "", "", "m2")}
    batch = audit_log.triage(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert {tuple(r) for r in batch.collect()} == wanted
    run = triage_stream(spark, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert run.awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == wanted


def test_last_lines(spark):
    df = spark.range(10)
    assert sorted(r.id for r in audit_log.last_lines(df, "id", 3).collect()) == [7, 8, 9]
    with pytest.raises(ValueError):
        audit_log.last_lines(df, "id", 0)


def test_profile_with_distinct_estimates(spark):
    df = spark.range(1000).withColumn("m", F.when(F.col("id") % 2 == 0, F.col("id") % 10))
    got = {r.column_name: r for r in catalog.catalog_profile({"t": df}, distinct=True).collect()}
    assert got["m"].nulls == 500 and got["m"].distinct_estimate == 5 and abs(got["id"].distinct_estimate - 1000) < 60


def test_file_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes(b"123")
    row = catalog.file_inventory(spark, str(tmp_path)).first()
    assert (row.file_name, row.size) == ("a.pdf", 3)
