"""Benchmark decontamination: words of documents that lie inside a window of a benchmark item.

A prefix-filtered set join in DataFrame functions only. A window is a run of item words; it
is contained in a document only if all its word shingles are, so the rarest of them is
the whole prefix that must be joined.

1. Documents are read once: every position whose shingle is one of the benchmark's gives a
   row with the words around it, and every document one row with its length. The
   shingles of the benchmark are broadcast while their number is below
   ``BROADCAST_SHINGLES``; beyond it the positions are joined by shuffle.
2. The rows found give each shingle's document frequency. A window with a shingle that no
   document has is out; the others are known by their rarest shingle.
3. A position with a window's rarest shingle is a candidate. Length and positional bounds
   (the window must fit the document around that position) come first, then the words of
   the window are compared with the document's words one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carryover.session import materialise

BROADCAST_SHINGLES = 1_000_000  # 16 bytes each
_APART = "".join(chr(c) for c in range(0x80) if not (chr(c).isdigit() or chr(c).isalpha()))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z were lowered; null gives none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.btrim(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), F.lit(_APART))
    return F.when(F.coalesce(lowered, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def _key(size: int, at: str) -> str:
    return f"xxhash64({size}, {', '.join(f'get(words, {at} + {j})' for j in range(size))})"


def _pick(sizes: list[int], which: str, value) -> str:
    return value(sizes[0]) if len(sizes) == 1 else (
        "CASE " + " ".join(f"WHEN {which} = {i} THEN {value(s)}" for i, s in enumerate(sizes)) + " END")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", *, window: int = 10, shingle: int = 4) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole. A document
    word inside any occurrence of a window is hit; an item counts when a window of it occurs.

    * Null and empty texts have no words. Items without an id or without words are ignored; the
      texts of a repeated item id are all items of that id.
    * Rows are told apart by position: repeated ids and rows give a row each; a null id keeps its row.
    * Empty tables give no rows, or rows without hits. Other columns are not looked at.
    """
    items = (benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("words"))
             .where(F.col("item").isNotNull() & (F.size("words") > 0)).distinct())
    length = F.least(F.lit(window), F.size("words"))
    windows = materialise(
        items.withColumn("len", length).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))))
        .select("item", "len", F.slice("words", F.col("at") + 1, F.col("len")).alias("words")), "windows")
    distinct = windows.select("len", "words").distinct()
    grams = (distinct.withColumn("size", F.least(F.lit(shingle), F.col("len")))
             .withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size")))))
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect()) or [shingle]  # at most ``shingle`` numbers
    key = F.expr("CASE " + " ".join(f"WHEN size = {s} THEN {_key(s, 'offset')}" for s in range(1, shingle + 1)) + " END")
    grams = materialise(grams.withColumn("key", key).select("len", "words", "size", "offset", "key"), "shingles")

    # position -1 stands for the document itself
    many = len(sizes)
    reach = window - 1
    asked = grams.select("key").distinct()
    known = asked.count()
    asked = asked.union(asked.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("key"))).select(F.col("key").alias("asked"))
    if known <= BROADCAST_SHINGLES:
        asked = F.broadcast(asked)
    places = (docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), words(F.col(text_col)).alias("words"))
              .withColumn("n", F.size("words"))
              .withColumn("i", F.explode(F.expr(f"sequence(-1, n * {many} - 1)")))
              .withColumn("pos", F.expr(f"CASE WHEN i < 0 THEN -1 ELSE i div {many} END").cast("int"))
              .withColumn("size", F.expr(f"CASE WHEN i >= 0 THEN {_pick(sizes, f'i % {many}', str)} END"))
              .withColumn("key", F.expr(f"CASE WHEN i >= 0 THEN {_pick(sizes, f'i % {many}', lambda s: _key(s, 'pos'))} END"))
              .where("i < 0 OR pos + size <= n"))
    if known <= BROADCAST_SHINGLES:
        found = places.join(asked, F.col("key").eqNullSafe(F.col("asked")))
    else:  # the rows of documents meet nothing and need no join
        found = places.where("i >= 0").join(asked, F.col("key") == F.col("asked")).unionByName(places.where("i < 0").withColumn("asked", F.col("key")))
    begin = F.greatest(F.col("pos") - reach, F.lit(0))
    found = materialise(found.select("rid", F.when(F.col("i") < 0, F.col("doc_id")).alias("doc_id"), "n", "pos", "key", begin.alias("begin"),
                                     F.when(F.col("i") >= 0, F.slice("words", begin + 1, F.col("pos") - begin + window)).alias("near")), "found")
    places = found.where("pos >= 0")

    spread = places.select("key", "rid").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    prefix = (grams.join(spread, "key").groupBy("len", "words", "size")
              .agg(F.min(F.struct("df", "key", "offset")).alias("rare"), F.count(F.lit(1)).alias("present"))
              .where("present = len - size + 1").select("len", "words", F.col("rare.key").alias("key"), F.col("rare.offset").alias("offset")))
    start = F.col("pos") - F.col("offset")
    hits = materialise(
        places.join(prefix, "key").withColumn("start", start).where("start >= 0 AND start + len <= n")
        .where(F.slice("near", F.col("start") - F.col("begin") + 1, F.col("len")) == F.col("words"))
        .select("rid", "start", "len", "words").distinct(), "hits")

    before = Window.partitionBy("rid").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("len")
    covered = (hits.select("rid", "start", "len").distinct().withColumn("past", F.coalesce(F.max(stop).over(before), F.lit(0)))
               .groupBy("rid").agg(F.sum(F.greatest(F.lit(0), stop - F.greatest("start", "past"))).alias("n_hit")))
    named = (hits.select("rid", "len", "words").distinct().join(windows.distinct(), ["len", "words"])
             .groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items")))
    return (found.where("pos < 0").select("rid", "doc_id", "n").join(covered, "rid", "left").join(named, "rid", "left")
            .select("doc_id", F.col("n").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
