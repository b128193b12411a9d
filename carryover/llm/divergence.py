"""How far the sources of each language lie apart in their terms, by Gustavson row accumulation.

Counts per (language, source, term) form a sparse matrix with a row per source. All pairs of
rows are compared as in Gustavson's sparse product: a row scatters its terms through the
term-major index of the other rows into one dense accumulator per peer, so that no pair of
postings is ever written out. A term that one row or both rows lack has that row's baseline
share instead of zero; the accumulators hold the baselines' differences in closed form, and
each meeting of two postings corrects the three differences it makes wrong.

Work is cut into cells of (language, bucket of terms, block of rows, block of rows). A cell
leaves one vector per row, and the vectors of a pair of blocks are added up. Buckets follow
the number of postings, so that a cell holds at least as many postings as accumulators.

Shares are whole numbers, 1 + floor(scale * (count + smoothing) / (N + smoothing * V)), and
all arithmetic on them is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carryover.llm.batches import small_batches
from carryover.llm.grams import binary_parts
from carryover.llm.spans import LETTERS, as_strings, encoded_words, per_text, running_total, spans
from carryover.session import materialise

# Rows of one side of a cell: a cell's accumulators take BLOCK * BLOCK numbers of 8 bytes.
BLOCK = 512
# Postings of a cell, at least; more where a block has more accumulators.
POSTINGS = 1 << 14


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, labels = batch.num_rows, [batch.column(i).dictionary_encode() for i in (0, 1)]
        data, offsets = binary_parts(batch.column(2))
        starts, ends = spans(data, offsets, LETTERS)
        if not len(starts):
            continue
        code, terms = encoded_words(data, starts, ends, LETTERS, lower=True)
        _, text = per_text(starts, offsets)
        first, second = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in labels)
        width = len(labels[1].dictionary)
        kinds, group = np.unique(first * width + second, return_inverse=True)
        assert rows * len(terms) < 1 << 62
        held, times = np.unique(text * len(terms) + code, return_counts=True)  # (text, term) and its occurrences
        key, place = np.unique(group[held // len(terms)] * len(terms) + held % len(terms), return_inverse=True)
        n, docs = np.bincount(place, times, len(key)).astype(np.int64), np.bincount(place, minlength=len(key))
        kind = kinds[key // len(terms)]
        yield pa.RecordBatch.from_arrays(
            [labels[0].dictionary.take(pa.array(kind // width)), labels[1].dictionary.take(pa.array(kind % width)),
             as_strings(terms).take(pa.array(key % len(terms))), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    found = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, all_counts: str, terms: str, scale: int, smoothing: int) -> str:
    """SQL of a smoothed share; decimals, as scale times a count may pass 64 bits."""
    return f"1 + ({scale}BD * ({count} + {smoothing})) div nullif({all_counts} + {smoothing} * {terms}, 0)"


def _far(sorted_shares: np.ndarray, sums: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """Sum of |share - base| over the shares, for each base."""
    below = np.searchsorted(sorted_shares, bases)
    return bases * below - sums[below] + (sums[-1] - sums[below]) - bases * (len(sorted_shares) - below)


def _rows(row: np.ndarray, share: np.ndarray, bases: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(postings per row, [row, peer]: the row's shares against the peer's baseline); ``row`` ascends."""
    edges = np.searchsorted(row, np.arange(len(bases) + 1))
    out = np.zeros((len(bases), len(other)), np.int64)
    for r in np.flatnonzero(np.diff(edges)):
        own = np.sort(share[edges[r]:edges[r + 1]])
        out[r] = _far(own, running_total(own), other)
    return edges, out


def accumulate(left: tuple, right: tuple, terms: int) -> np.ndarray:
    """[row of left, row of right]: sum of |difference of shares| over ``terms`` terms.

    A side is (term, row, share, baseline of each row); terms are numbered 0 to ``terms`` - 1.
    """
    (term, row, share, base), (r_term, r_row, r_share, r_base) = left, right
    by_row, by_peer = np.lexsort((term, row)), np.lexsort((r_term, r_row))
    term, row, share = term[by_row], row[by_row], share[by_row]
    edges, out = _rows(row, share, base, r_base)
    r_edges, back = _rows(r_row[by_peer], r_share[by_peer], r_base, base)
    out += back.T + (terms - np.diff(edges)[:, None] - np.diff(r_edges)[None, :]) * np.abs(base[:, None] - r_base[None, :])
    # the term-major index of the right side
    order = np.argsort(r_term, kind="stable")
    index = np.searchsorted(r_term[order], np.arange(terms + 1))
    peer, peer_share = r_row[order], r_share[order]
    for r in range(len(base)):
        mine = slice(edges[r], edges[r + 1])
        low = index[term[mine]]
        size = index[term[mine] + 1] - low
        met = np.repeat(low - running_total(size)[:-1], size) + np.arange(int(size.sum()))
        own, theirs, theirs_base = np.repeat(share[mine], size), peer_share[met], r_base[peer[met]]
        right_now = np.abs(own - theirs) - np.abs(own - theirs_base) - np.abs(base[r] - theirs) + np.abs(base[r] - theirs_base)
        # whole numbers; a row's corrections stay below 2**53, so their float sums are exact
        out[r] += np.bincount(peer[met], right_now, len(r_base)).astype(np.int64)
    return out


def _side(batch: pa.RecordBatch, i: int, side: str) -> tuple:
    """(term, row, share, baselines) of one side of cell ``i``; a side may hold no posting."""
    held, base = batch.column(f"{side}_held")[i], batch.column(f"{side}_base")[i].values
    columns = held.values.flatten() if held.is_valid else [pa.array([], pa.int64())] * 3
    return tuple(c.to_numpy(zero_copy_only=False) for c in (*columns, base))


def _scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            found = accumulate(_side(batch, i, "a"), _side(batch, i, "b"), batch.column("terms")[i].as_py())
            rows, peers = found.shape
            same = [pa.array([batch.column(name)[i].as_py()] * rows, kind)
                    for name, kind in (("lang", pa.string()), ("a_block", pa.int64()), ("b_block", pa.int64()))]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, peers, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(rows)), vectors], names=["lang", "a_block", "b_block", "row", "values"])


_VECTORS = "lang string, a_block bigint, b_block bigint, row bigint, values array<bigint>"


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *,
                      least_docs: int = 30, top: int = 50, scale: int = 1_000_000_000, smoothing: int = 5) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    A term is a run of ASCII letters and characters above ASCII, A-Z lowered. A language keeps
    the terms in at least ``least_docs`` of its documents. Part ``pair`` has the distance to
    each other source of the language over all kept terms, part ``term`` the ``top`` kept
    terms of the source whose share lies most above the language's. Ranks go by falling value,
    then by item in UTF-8 order.

    * Null texts, languages and sources count as ''. Texts are read whole; a task needs memory
      for a small multiple of its longest text.
    * A source without terms has its baseline for every kept term; a language that keeps no term
      gives distance 0 for every pair and no terms.
    * Each row counts as a document, repeated ones too. An empty table gives an empty result;
      other columns are not looked at.
    """
    spark = docs.sparkSession
    empty = F.lit("")
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"),
                       F.coalesce(F.col(source_col).cast("string"), empty).alias("source"), F.coalesce(text_col, empty).alias("text"))
    with small_batches(spark, rows=4000):
        counts = materialise(term_counts(docs), "counts")
    terms = materialise(counts.groupBy("lang", "term").agg(F.sum("n").alias("times"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("holders"))
                        .where(F.col("docs") >= least_docs).drop("docs"), "terms")
    sources = docs.select("lang", "source").distinct()
    # one row per language
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("times").alias("lang_n"), F.sum("holders").alias("postings"))
    none = F.lit(0).cast("bigint")
    langs = materialise(
        sources.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(kept, "lang", "left").na.fill(0, ["v", "lang_n", "postings"])
        .withColumn("slots", F.pow(F.least("sources", F.lit(BLOCK)), 2))
        .select("lang", "v", "lang_n", F.ceil(F.greatest(F.lit(1.0), F.col("postings") / F.greatest(F.col("slots"), F.lit(POSTINGS)))).alias("buckets")), "langs")
    # terms numbered within their bucket, next to the language's share
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets"))
    numbered = materialise(
        terms.join(langs, "lang").withColumn("bucket", bucket)
        .select("lang", "term", "bucket", "v", (F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("term")) - 1).cast("bigint").alias("at"),
                F.expr(_share("times", "lang_n", "v", scale, smoothing)).alias("q")), "numbered")
    held = materialise(counts.select("lang", "source", "term", "n").join(numbered.drop("v"), ["lang", "term"]), "held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("all_n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialise(
        sources.join(totals, ["lang", "source"], "left").join(langs, "lang").na.fill(0, ["all_n"]).withColumn("i", place.cast("bigint"))
        .select("lang", "source", "v", "all_n", "buckets", F.floor(F.col("i") / BLOCK).alias("block"), (F.col("i") % BLOCK).alias("row"),
                F.coalesce(F.expr(_share("0", "all_n", "v", scale, smoothing)), none).alias("base")), "groups")
    postings = materialise(
        held.join(groups.select("lang", "source", "v", "all_n", "block", "row"), ["lang", "source"])
        .withColumn("p", F.expr(_share("n", "all_n", "v", scale, smoothing))).drop("v", "all_n"), "postings")
    return _pairs(postings, numbered, groups).unionByName(_terms(postings, top))


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(postings: DataFrame, top: int) -> DataFrame:
    above = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(above, "term").where(F.col("rank") <= top)


def _pairs(postings: DataFrame, numbered: DataFrame, groups: DataFrame) -> DataFrame:
    # at most one bucket's postings of BLOCK rows, and at most BLOCK baselines, in an array
    packed = postings.groupBy("lang", "bucket", "block").agg(F.collect_list(F.struct("at", "row", "p")).alias("held"))
    bases = (groups.groupBy("lang", "buckets", "block").agg(F.array_sort(F.collect_list(F.struct("row", "base"))).alias("b"))
             .select("lang", "block", F.expr("transform(b, x -> x.base)").alias("base"), F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")))
    width = numbered.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("terms"))
    sides = materialise(bases.join(packed, ["lang", "bucket", "block"], "left").join(width, ["lang", "bucket"], "left").na.fill(0, ["terms"]), "sides")
    side = lambda s: sides.select("lang", "bucket", *["terms"] * (s == "a"), *[F.col(c).alias(f"{s}_{c}") for c in ("block", "base", "held")])
    cells = side("a").join(side("b"), ["lang", "bucket"]).where("a_block <= b_block")
    with small_batches(postings.sparkSession, rows=16):
        vectors = materialise(cells.mapInArrow(_scattered, _VECTORS), "vectors")
    met = vectors.select("lang", "a_block", "b_block", "row", F.posexplode("values").alias("peer", "value"))
    summed = met.groupBy("lang", "a_block", "b_block", "row", "peer").agg(F.sum("value").alias("value"))
    # a pair of different blocks was met once and stands for both directions; a source is no peer of itself
    both = F.array(F.struct(F.col("a_block").alias("block"), "row", F.col("b_block").alias("peer_block"), "peer"),
                   F.struct(F.col("b_block").alias("block"), F.col("peer").alias("row"), F.col("a_block").alias("peer_block"), F.col("row").alias("peer")))
    ways = F.slice(both, 1, F.when(F.col("a_block") == F.col("b_block"), 1).otherwise(2))
    turned = summed.select("lang", "value", F.inline(ways)).where("NOT (block = peer_block AND row = peer)")
    name = lambda block, row, as_: groups.select("lang", F.col("block").alias(block), F.col("row").alias(row), F.col("source").alias(as_))
    named = turned.join(name("block", "row", "source"), ["lang", "block", "row"]).join(name("peer_block", "peer", "item"), ["lang", "peer_block", "peer"])
    return _ranked(named, "pair")
