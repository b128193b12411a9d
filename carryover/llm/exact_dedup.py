"""Exact dedup by deterministic block naming.

Every text is cut into blocks of ``block_bytes`` bytes. All blocks of the table are sorted and
each distinct block gets an integer name; then adjacent names of a document are paired
and the pairs are named in the same way, until one name stands for the document. Names
come from comparing contents, never from a hash alone, so equal names mean equal texts.

Sorting uses ranges of (hash of the block, row), which cut even through the copies of one
block: a block that a third of all rows share is spread over many tasks. The blocks at
the edges of a range are written beside the names, and a block that two ranges share takes
the smallest of its names. The text crosses the network once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carryover.llm.batches import small_batches
from carryover.session import materialise

BLOCK_BYTES = 4096
_KEPT = ["rid", "doc_id", "pos", "blocks", "sha"]
_NAMED = "rid bigint, doc_id bigint, pos bigint, blocks bigint, sha binary, name bigint, edge_h bigint, edge_key binary"


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the distinct keys of a sorted range; tell the keys at its edges."""
    first_name = TaskContext.get().partitionId() << 40
    name, last_h, last_key, first_h = first_name, None, None, None
    tail: list[tuple[int, bytes]] = []  # the keys with the hash seen last

    def edges(found: list[tuple[int, bytes]], h: int) -> pa.RecordBatch:
        count = len(found)
        nothing = [pa.nulls(count, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*nothing, pa.array([n for n, _ in found], pa.int64()), pa.array([h] * count, pa.int64()),
                                           pa.array([k for _, k in found], pa.binary())], names=[*_KEPT, "name", "edge_h", "edge_key"])

    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        h, key = batch.column("h"), batch.column("key")
        hashes = h.to_numpy()
        fresh = np.ones(rows, bool)
        fresh[0] = last_key is None or hashes[0] != last_h or key[0].as_py() != last_key
        fresh[1:] = pc.not_equal(key.slice(1), key.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        names = name + np.cumsum(fresh)
        name, last_key = int(names[-1]), key[rows - 1].as_py()
        if first_h is None:
            first_h = hashes[0]
        moved = np.flatnonzero(np.concatenate(([hashes[0] != last_h], hashes[1:] != hashes[:-1])))
        if len(moved):
            if last_h is not None and last_h == first_h:
                yield edges(tail, int(last_h))
            if last_h != first_h and hashes[0] == first_h and moved[0] == 0 and len(moved) > 1:
                lead = np.flatnonzero(fresh[:moved[1]])
                yield edges([(int(names[i]), key[int(i)].as_py()) for i in lead], int(first_h))
            tail = []
            lead = moved[-1] + np.flatnonzero(fresh[moved[-1]:])
        else:
            lead = np.flatnonzero(fresh)
        tail += [(int(names[i]), key[int(i)].as_py()) for i in lead]
        last_h = hashes[-1]
        none = pa.nulls(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _KEPT], pa.array(names, pa.int64()), none, pa.nulls(rows, pa.binary())],
                                         names=[*_KEPT, "name", "edge_h", "edge_key"])
    if tail:
        yield edges(tail, int(last_h))


def _named(keyed: DataFrame) -> DataFrame:
    """``keyed`` (kept columns, key) with a name per distinct key, written down."""
    ranged = (keyed.withColumn("h", F.xxhash64("key")).repartitionByRange("h", "rid").sortWithinPartitions("h", "key", "rid"))
    with small_batches(keyed.sparkSession, 2000):
        both = materialise(ranged.select(*_KEPT, "h", "key").mapInArrow(_name, _NAMED), "names")
    edges = both.where(F.col("edge_h").isNotNull()).select("name", "edge_h", "edge_key").distinct()
    shared = (edges.withColumn("canon", F.min("name").over(Window.partitionBy("edge_h", "edge_key")))
              .where("name <> canon").select("name", "canon"))
    # at most two keys per range (and as many more as 64-bit hashes collide): 16 bytes each
    return (both.where(F.col("edge_h").isNull()).join(F.broadcast(shared), "name", "left")
            .select(*_KEPT, F.coalesce("canon", "name").alias("name")))


def text_names(docs: DataFrame, id_col: str, text: Column, block_bytes: int = BLOCK_BYTES, row: Column | None = None) -> DataFrame:
    """(rid, doc_id, sha, level, name): rows have equal (level, name) exactly when their texts are equal."""
    source = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).cast("binary").alias("bytes"),
                          (F.monotonically_increasing_id() if row is None else row).alias("rid"))
              .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.length("bytes") / block_bytes)).cast("bigint")))
    first = F.col("pos") == 0
    keyed = (source.select("rid", "doc_id", "blocks", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("pos"))
             .select("rid", F.when(first, F.col("doc_id")).alias("doc_id"), "pos", "blocks",
                     F.when(first, F.unhex(F.sha2("bytes", 256))).alias("sha"),
                     F.expr(f"substring(bytes, cast(pos * {block_bytes} + 1 as int), {block_bytes})").alias("key")))
    names = _named(keyed)
    most = names.agg(F.max("blocks")).first()[0] or 1
    done = [names.where("blocks = 1").withColumn("level", F.lit(0))]
    level = 0
    while most > 1:
        level, most = level + 1, -(-most // 2)
        half = F.floor(F.col("pos") / 2)
        pairs = (names.where("blocks > 1").groupBy("rid", half.alias("pos"), F.ceil(F.col("blocks") / 2).alias("blocks"))
                 .agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"),
                      F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                      F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"))
                 .withColumn("key", F.concat_ws(",", "left", "right").cast("binary")))
        names = _named(pairs)
        done.append(names.where("blocks = 1").withColumn("level", F.lit(level)))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("rid", "doc_id", "sha", "level", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, row_col: str | None = None,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Rows with equal texts form a group; the row with the largest doc_id is kept.

    * A null text equals the empty text. Texts are compared as they are, in full.
    * Rows that repeat text and doc_id form one group and one of them is kept. A null doc_id
      is smaller than any other; a group of nothing else keeps one row under a null id.
    * An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    * ``row_col`` names a bigint that no two rows share; it is passed on behind the other columns.
    """
    named = text_names(docs, id_col, F.col(text_col), block_bytes, None if row_col is None else F.col(row_col))
    # written down, so that the join below deals both sides anew and a large group can be split
    groups = materialise(named.groupBy("level", "name").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("doc_id", "rid")).alias("best")), "groups")
    return (named.join(groups, ["level", "name"])
            .select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256"), *([] if row_col is None else [F.col("rid").alias(row_col)])))
