"""The driver contract in a fresh process, on a session this package did not build."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
import __spark_entry__ as entry
assert entry.entry(spark).count() == 14
for name in ("table_digest", "one_live_per_key", "html_asset_refs"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
for name in [n for n in entry.queries() if n.startswith("op1_")]:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
print("CONTRACT HOLDS")
"""


def test_entry_on_a_plain_session(tmp_path):
    script = SCRIPT.format(root=str(ROOT), shared=str(tmp_path))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600, cwd=tmp_path,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "CONTRACT HOLDS" in done.stdout, done.stderr[-2000:]
