"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.session import tune
from workload.roles import forget, with_roles

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, *, text: Sequence[str] = (), micros: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register ``name``; ``sql`` may refer to roles as ``{role}``.

    Columns in ``text`` (decimals, dates) and ``micros`` (moments) are rendered the same
    way on both sides, so that no client library's conversion takes part in a comparison.
    """
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            forget()  # nothing is handed from one query to the next
            out = fn(tune(spark), sf)
            shown = {**{c: F.col(c).cast("string") for c in text},
                     **{c: F.unix_micros(F.col(c).cast("timestamp")) for c in micros}}
            return out.withColumns(shown) if shown else out

        QUERIES[name] = run
        if sql is not None:
            plain = with_roles(sql)
            swaps = [f"CAST({c} AS VARCHAR) AS {c}" for c in text] + [f"epoch_us({c}) AS {c}" for c in micros]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({plain})" if swaps else plain
        return fn
    return register
