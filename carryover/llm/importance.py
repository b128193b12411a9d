"""Importance resampling towards a target distribution of hashed word n-grams.

The bucket of a feature is the CRC-32 of its bytes. CRC-32 is affine over exclusive or: the
checksum of a span is the exclusive or of what each byte contributes at its distance from
the span's end, and of a constant for the span's length. So a table of contributions by
(distance, byte) turns all features of a batch into one gather and one
``bitwise_xor.reduceat``. A span longer than the table is cut into blocks from its end;
neighbouring blocks are folded pair by pair, the left one moved on over the zero bytes that
the right one stands for.

The corpus and the target are each reduced to a histogram over buckets, whose size is a
parameter; a document's weight is the sum of its features' log ratios. Drawing without
replacement by weight is taking the highest weights after a Gumbel number of the document's
own was added. Ranks come from one range-partitioned sort that is written down: a row's rank is
its place in its range plus the rows of the ranges before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carryover.llm.batches import small_batches
from carryover.llm.grams import binary_parts
from carryover.llm.spans import ALPHANUMERIC, LOWER, per_text, running_total, spans
from carryover.session import materialise

# Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
# Distances in the table of contributions; longer spans are cut into blocks of so many bytes.
BLOCK = 64
_ROW = 33  # bits of the place within a partition in monotonically_increasing_id


def _contributions() -> np.ndarray:
    """[distance from the end, byte]: what a byte adds to the register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    out = np.empty((BLOCK, 256), np.uint32)
    out[0] = step
    for distance in range(1, BLOCK):
        out[distance] = step[out[distance - 1] & 0xFF] ^ (out[distance - 1] >> 8)
    return out


TABLE = _contributions()


def _through(register: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Registers after the zero bytes that ``moved`` ([byte of the register, its value]) stands for."""
    return moved[0][register & 0xFF] ^ moved[1][(register >> 8) & 0xFF] ^ moved[2][(register >> 16) & 0xFF] ^ moved[3][register >> 24]


def _one_zero() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    return np.stack([TABLE[0][value], value, value << 8, value << 16]).astype(np.uint32)


_ZEROS = [_one_zero()]  # [k]: over 2**k zero bytes


def over_zeros(power: int) -> np.ndarray:
    """The table that moves a register over ``2**power`` zero bytes."""
    while len(_ZEROS) <= power:
        _ZEROS.append(_through(_ZEROS[-1], _ZEROS[-1]))
    return _ZEROS[power]


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of so many zero bytes."""
    kinds, place = np.unique(lengths, return_inverse=True)
    register = np.full(len(kinds), 0xFFFFFFFF, np.uint32)
    for power in range(int(kinds.max()).bit_length() if len(kinds) else 0):
        on = (kinds >> power) & 1 == 1
        register[on] = _through(register[on], over_zeros(power))
    return (register ^ np.uint32(0xFFFFFFFF))[place]


def crc32_of_spans(joined: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of spans (none empty) whose bytes stand one after the other in ``joined``."""
    if not len(lengths):
        return np.empty(0, np.uint32)
    ends = np.cumsum(lengths)
    distance = np.repeat(ends, lengths) - 1 - np.arange(len(joined))
    blocks = -(-lengths // BLOCK)
    last = ends - 1
    if blocks.max() == 1:
        register = np.bitwise_xor.reduceat(TABLE[distance, joined], ends - lengths)
        return register ^ length_constants(lengths)
    # a block begins with its span or a multiple of BLOCK bytes before the span's end
    opens = distance % BLOCK == BLOCK - 1
    opens[ends - lengths] = True
    register = np.bitwise_xor.reduceat(TABLE[distance % BLOCK, joined], np.flatnonzero(opens))
    span = np.repeat(np.arange(len(lengths)), blocks)
    behind = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(register))  # blocks between this one and its span's end
    power = BLOCK.bit_length() - 1
    while behind.any():
        left = behind & 1 == 1
        register[left] = _through(register[left], over_zeros(power))
        pair = np.ones(len(register), bool)
        pair[1:] = (span[1:] != span[:-1]) | (behind[1:] >> 1 != behind[:-1] >> 1)
        first = np.flatnonzero(pair)
        register, span, behind = np.bitwise_xor.reduceat(register, first), span[first], behind[first] >> 1
        power += 1
    assert len(register) == len(last)
    return register ^ length_constants(lengths)


def _features(column: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words per text, [(bucket, text) of every run of 1, 2 ... words])."""
    data, offsets = binary_parts(column)
    starts, ends = spans(data, offsets, ALPHANUMERIC)
    counts, text = per_text(starts, offsets)
    lengths = ends - starts
    joined = LOWER[data[ALPHANUMERIC[data]]]
    out = [((crc32_of_spans(joined, lengths) % np.uint32(buckets)).astype(np.int64), text)]
    if longest > 1:
        # every word behind one space: a run of words is a slice that leaves out the first space
        spaced = np.full(len(joined) + len(lengths), 0x20, np.uint8)
        spaced[np.arange(len(joined)) + np.repeat(np.arange(len(lengths)), lengths) + 1] = joined
        begin = running_total(lengths + 1)
        place = np.arange(len(text)) - np.repeat(running_total(counts)[:-1], counts)
        for n in range(2, longest + 1):
            first = np.flatnonzero(place + n <= np.repeat(counts, counts))
            low, size = begin[first] + 1, begin[first + n] - begin[first] - 1
            at = np.repeat(low - running_total(size)[:-1], size) + np.arange(int(size.sum()))
            out.append(((crc32_of_spans(spaced[at], size) % np.uint32(buckets)).astype(np.int64), text[first]))
    return counts, out


def _histogram(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, _ in _features(batch.column(0), longest, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return run


def feature_counts(docs: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_histogram(longest, buckets), "bucket bigint, n bigint")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed bucket shares, target over corpus."""
    all_raw, all_target = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((float(target.get(b, 0) + 1) * all_raw) / (float(raw.get(b, 0) + 1) * all_target)))
                     for b in range(buckets)], np.int64)


def _weigher(gains: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs = _features(batch.column(1), longest, len(gains))
            weight, features = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for bucket, text in runs:
                sums, edges = running_total(gains[bucket]), np.searchsorted(text, np.arange(batch.num_rows + 1))
                weight += sums[edges[1:]] - sums[edges[:-1]]
                features += np.diff(edges)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(id_col: Column, seed: int) -> Column:
    """A document's own Gumbel number in thousandths, from the SHA-256 of seed and id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", *,
                      longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words): which documents look like ``target``.

    Features are all runs of 1 to ``longest`` words; a word is a run of ASCII letters and digits
    and of characters above ASCII, A-Z lowered. Of the documents with ``least_words`` words or
    more, ``percent`` in a hundred are drawn, highest score first, ties to the smaller id.

    * Null and empty texts have no features, weight 0 and are never drawn unless ``least_words``
      is 0. Texts are read whole; a task needs memory for a small multiple of its longest text.
    * Every row gives a row. A null id draws like an empty one and ranks last among ties;
      rows that repeat id and score get different ranks, which of them gets which is open.
    * Empty ``docs`` give an empty result, an empty ``target`` the same gain formula with
      zeros. Other columns are not looked at. Only the ``buckets`` sums of each side reach the
      driver.
    """
    spark = docs.sparkSession
    with small_batches(spark, rows=2000):
        raw, wanted = ({r.bucket: r.n for r in feature_counts(df, column, longest, buckets).collect()}
                       for df, column in ((docs, text_col), (target, target_col)))
        gains = bucket_gains(raw, wanted, buckets)
        weighed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _weigher(gains, longest), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
        scored = materialise(weighed.withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed),
                                                  "_row": F.monotonically_increasing_id()}), "scored")
    # the row number, written down above, lets a cut fall between rows that are equal otherwise
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    able = scored.where(F.col("n_words") >= least_words)
    placed = materialise(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumns({"_part": F.shiftright("_at", _ROW), "_place": F.col("_at").bitwiseAND((1 << _ROW) - 1)})
    # one row per range
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    below = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_below"),
                         F.sum("_n").over(Window.partitionBy()).alias("_all"))
    drawn = F.expr(f"({percent} * _all) div 100")
    rank = F.col("_below") + F.col("_place") + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.join(below, "_part").select(*columns, F.when(rank <= drawn, rank).alias("rank"), "n_words")
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank"), "n_words")
    return ranked.unionByName(rest)
