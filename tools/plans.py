"""List physical-plan features worth a second look: loops, cartesian products, one-task windows, Python stages.

    python tools/plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import io
import re
import sys
from contextlib import redirect_stdout
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import workload  # noqa: E402
from carryover import session  # noqa: E402


def plan_text(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def features(text: str) -> list[str]:
    found = []
    for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "ArrowEvalPython", "BatchEvalPython", "ObjectHashAggregate",
                 "SortAggregate"):
        n = len(re.findall(word, text))
        if n:
            found.append(f"{word}x{n}")
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"Window \[", line) and any("SinglePartition" in x for x in lines[i + 1:i + 4]):
            found.append("one-task window")
    found.append(f"exchanges={len(re.findall(r'Exchange ', text))} scans={len(re.findall('FileScan', text))}")
    return found


def main(argv: list[str]) -> None:
    sf = argv[0] if argv else "/root/testdata/sf0.001"
    spark = session.build("plans", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in argv[1:] or workload.QUERIES:
        print(f"{name:28s}", " ".join(features(plan_text(workload.QUERIES[name](spark, sf)))), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
