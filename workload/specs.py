"""Table specs used by the registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.spec import ColumnInfo, TableClass, TableSpec

ORDERS_COPY = TableSpec(
    "orders", TableClass.COPY,
    columns={
        "orderno": ColumnInfo("bigint", nullable=False),
        "custno": ColumnInfo("bigint", nullable=False),
        "status": ColumnInfo("enum", nullable=True, values=("F", "O"), default="U"),
        "total": ColumnInfo("decimal", precision=12, scale=2),
        "placed_on": ColumnInfo("date"),
        "priority": ColumnInfo("varchar", length=20),
    },
    renames={"orderno": "o_orderkey", "custno": "o_custkey", "status": "o_orderstatus", "total": "o_totalprice",
             "placed_on": "o_orderdate", "priority": "o_orderpriority"},
    key=("orderno",), chunk_by="orderno")

ORDERS_MERGE = TableSpec(
    "orders", TableClass.MERGE,
    columns={
        "order_no": ColumnInfo("bigint", nullable=False),
        "cust_no": ColumnInfo("bigint", nullable=False),
        "priority": ColumnInfo("varchar", length=20),
        "total": ColumnInfo("decimal", precision=12, scale=2),
        "placed_at": ColumnInfo("datetime"),
    },
    key=("order_no",), merge_keys=("cust_no", "priority"), surrogate_pk="order_no",
    merge_exclude=lambda: F.col("total") < 20000,
    archived={"import_archived_legacy_status": "legacy_status"})

LINES_COPY = TableSpec(
    "lineitem", TableClass.COPY,
    columns={
        "l_orderkey": ColumnInfo("bigint"), "l_partkey": ColumnInfo("bigint"), "l_suppkey": ColumnInfo("bigint"),
        "l_linenumber": ColumnInfo("int"), "l_quantity": ColumnInfo("decimal", precision=8, scale=2),
        "l_extendedprice": ColumnInfo("decimal", precision=12, scale=2), "l_returnflag": ColumnInfo("char", length=1),
        "l_shipdate": ColumnInfo("datetime"),
    })

# decimal scales for digests of floating-point columns; columns of unbounded text
SCALES = {"customer": {"c_acctbal": 2}, "supplier": {"s_acctbal": 2}, "part": {"p_retailprice": 2},
          "orders": {"o_totalprice": 2}, "events": {"value": 2},
          "lineitem": {"l_quantity": 2, "l_extendedprice": 2, "l_discount": 2, "l_tax": 2}}
LARGE = {"documents": ["text"], "pages": ["html"], "benchmark": ["text"], "conversations": ["text"]}
