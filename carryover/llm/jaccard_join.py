"""N-gram Jaccard join: all pairs of documents whose shingle sets are similar, as groups.

Method: rare-first prefix filtering with length, positional and suffix filters, joined on
prefix shingles and verified exactly.

1. ``_cut``: every task turns its texts into shingle hashes in chunks of about
   ``CHUNK_SHINGLES``. A chunk asks for the document frequency of each of its distinct
   shingles, dealt by hash range as sorted gaps: an even, pre-aggregated exchange however
   often a shingle occurs.
2. ``_count``: a range adds up the frequencies and answers each chunk with the shingles
   that occur in two documents or more. A shingle of one document can link nothing.
3. ``_gather``: a chunk puts the answers back to its documents. A document whose rarest
   shingles (the prefix any partner must touch) are all its own is done; the others keep
   their shared shingles in rare-first order.
4. Equal sets become one class. The prefix shingles of the classes are joined in two
   steps: first every class with the smallest class of its bucket, then, only across
   the components this gave, all others that pass the filters. Buckets above
   ``BUCKET`` classes are cut into bands of set size and position; two bands meet only if
   the length and positional filters leave room for some pair of theirs. Bands are cut into
   blocks, bounded in classes and shingles, that meet block against block in memory: the
   filters say which pairs are verified, and only links that join components come back,
   so a large group of near copies never becomes a list of its pairs.
5. Links never leave a component. ``_counts`` compares every two classes of a component once,
   block against block, and adds up the links of each class, weighted by its rows.

A frequency only orders shingles, so the 48 bits kept of a hash can cost time but no
link: two different shingles of one pair agree in them once in about 10^14.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.llm import grams
from carryover.llm.batches import small_batches
from carryover.llm.exchange import groups, range_edges, rows
from carryover.llm.graph import components
from carryover.session import materialise

CHUNK_SHINGLES = 400_000
HOT = 64            # from this many documents of one chunk on, a shingle's documents stay with the chunk
BUCKET = 64         # classes per prefix shingle that are paired directly; larger buckets go in blocks
BLOCK_SHINGLES = 60_000  # shingles in a block of a large bucket or component
BLOCK_CLASSES = 1000     # classes in a block of a large bucket or component
RANGES_PER_SPLIT = 8
PARTS = 8           # hash parts of the suffix filter

_ROWS = pa.schema([("deal", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int8()), ("keys", pa.binary()), ("counts", pa.binary()),
                   ("docs", pa.binary()), ("codes", pa.binary())])
_ROWS_SQL = "deal bigint, chunk bigint, kind tinyint, keys binary, counts binary, docs binary, codes binary"
_ASK, _HOT, _META = 0, 1, 2
_SETS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                   ("own", pa.int64()), ("shared", pa.binary())])
_SETS_SQL = "rid bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint, own bigint, shared binary"


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its first shingles a partner of a set of n must touch."""
    return n - (percent * n + 99) // 100 + 1


def _cut(shingle: int, ranges: int, hot_from: int, chunk_size: int):
    def chunk_rows(chunk: int, ids: list, hashes: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        g, text = grams.ngrams(hashes, offsets, shingle, whole_when_short=True)
        order = np.argsort(g, kind="stable")
        gs, ds = g[order], text[order]
        first = np.ones(len(gs), bool)
        first[1:] = (gs[1:] != gs[:-1]) | (ds[1:] != ds[:-1])
        mine = np.zeros(len(gs), np.uint64)
        mine[order[first]] = 1
        s1 = grams.per_text_sum(grams.mix(g) * mine, text, len(ids))
        s2 = grams.per_text_sum(grams.mix(g + np.uint64(0x51ED2701)) * mine, text, len(ids))
        n = np.bincount(ds[first], minlength=len(ids)).astype(np.int64)
        base = (chunk * 65536) if len(ids) else 0
        meta = (np.arange(len(ids), dtype=np.int64) + base, np.array([i is not None for i in ids], np.uint8),
                np.array([i or 0 for i in ids], np.int64), n, s1, s2)
        out = [(chunk % ranges, chunk, _META, meta[0].tobytes(), meta[1].tobytes(), meta[2].tobytes(),
                n.tobytes() + s1.tobytes() + s2.tobytes())]
        keys, docs = gs[first] >> np.uint64(16), ds[first].astype(np.uint16)
        if not len(keys):
            return out
        lead = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(np.append(lead, len(keys)))
        keys = keys[lead]
        hot = counts >= hot_from
        if hot.any():
            out.append((chunk % ranges, chunk, _HOT, grams.pack_sorted(keys[hot]), counts[hot].astype(np.uint32).tobytes(),
                        docs[np.repeat(hot, counts)].tobytes(), b""))
        edges = range_edges(keys, 48, ranges)
        listed = np.concatenate(([0], np.cumsum(np.where(hot, 0, counts))))
        docs = docs[~np.repeat(hot, counts)]
        for r in np.flatnonzero(edges[1:] > edges[:-1]):
            a, b = edges[r], edges[r + 1]
            out.append((int(r), chunk, _ASK, grams.pack_sorted(keys[a:b]), counts[a:b].astype(np.uint32).tobytes(),
                        docs[listed[a]:listed[b]].tobytes(), b""))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        serial, held, size, ids = 0, [], 0, []

        def flush():
            nonlocal serial, held, size, ids
            hashes = np.concatenate([h for h, _ in held])
            lengths = np.concatenate([np.diff(w) for _, w in held])
            made = chunk_rows(task * 1_000_000 + serial, ids, hashes, np.concatenate(([0], np.cumsum(lengths))))
            serial, held, size, ids = serial + 1, [], 0, []
            return rows(made, _ROWS)

        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                piece = batch.slice(part, 500)
                held.append(grams.words(*grams.binary_parts(piece.column(1))))
                ids += piece.column(0).to_pylist()
                size += len(held[-1][0])
                if size >= chunk_size or len(ids) > 60_000:
                    yield flush()
        if ids:
            yield flush()

    return run


def _codes(frequency: np.ndarray) -> np.ndarray:
    """Document frequency as one byte: exact below 128, then eighths of a doubling."""
    rough = 128 + np.floor(8 * (np.log2(np.maximum(frequency, 1)) - 7))
    return np.where(frequency < 128, frequency, np.minimum(rough, 255)).astype(np.uint8)


def _count(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groups(batches, ["deal"]):
            out = [tuple(r.values()) for r in found if r["kind"] != _ASK]
            asks = [r for r in found if r["kind"] == _ASK]
            keys = [grams.unpack_sorted(r["keys"]) for r in asks]
            if keys:
                counts = [np.frombuffer(r["counts"], np.uint32) for r in asks]
                _, place = np.unique(np.concatenate(keys), return_inverse=True)
                frequency = np.bincount(place, weights=np.concatenate(counts))[place].astype(np.int64)
                at = 0
                for r, k, c in zip(asks, keys, counts):
                    df = frequency[at:at + len(k)]
                    at += len(k)
                    keep = df > 1
                    if keep.any():
                        listed = np.where(c < hot, c, 0)
                        docs = np.frombuffer(r["docs"], np.uint16)[np.repeat(keep, listed)]
                        out.append((r["deal"], r["chunk"], _ASK, grams.pack_sorted(k[keep]), c[keep].tobytes(), docs.tobytes(),
                                    _codes(df[keep]).tobytes()))
            if out:
                yield rows(out, _ROWS)

    return run


def _gather(percent: int, hot_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groups(batches, ["chunk"]):
            meta = next(r for r in found if r["kind"] == _META)
            rid, doc_id = np.frombuffer(meta["keys"], np.int64), np.frombuffer(meta["docs"], np.int64)
            has_id = np.frombuffer(meta["counts"], np.uint8).astype(bool)
            n, s1, s2 = np.frombuffer(meta["codes"], np.int64).reshape(3, -1)
            hot = {}
            for r in found:
                if r["kind"] == _HOT:
                    counts = np.frombuffer(r["counts"], np.uint32)
                    lists = np.split(np.frombuffer(r["docs"], np.uint16), np.cumsum(counts)[:-1])
                    hot = dict(zip(grams.unpack_sorted(r["keys"]).tolist(), lists))
            parts = []
            for r in found:
                if r["kind"] == _ASK:
                    k, c = grams.unpack_sorted(r["keys"]), np.frombuffer(r["counts"], np.uint32)
                    code = np.frombuffer(r["codes"], np.uint8)
                    listed = np.where(c < hot_from, c, 0)
                    parts.append((np.frombuffer(r["docs"], np.uint16), np.repeat(code, listed), np.repeat(k, listed)))
                    for i in np.flatnonzero(c >= hot_from):
                        d = hot[int(k[i])]
                        parts.append((d, np.full(len(d), code[i]), np.full(len(d), k[i])))
            if parts:
                doc, code, key = (np.concatenate(x) for x in zip(*parts))
            else:
                doc, code, key = np.empty(0, np.uint16), np.empty(0, np.uint8), np.empty(0, np.uint64)
            own = n - np.bincount(doc, minlength=len(n))
            alive = (n > 0) & (own < _prefix(n, percent))
            use = alive[doc]
            doc, code, key = doc[use], code[use], key[use]
            order = np.lexsort((key, code, doc))
            doc, key = doc[order], key[order].astype(np.int64)
            edges = np.searchsorted(doc, np.arange(len(n) + 1))
            shared = [key[edges[i]:edges[i + 1]].tobytes() if alive[i] else None for i in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(doc_id, mask=~has_id), pa.array(n), pa.array(s1), pa.array(s2), pa.array(own),
                 pa.array(shared, pa.binary())], schema=_SETS)

    return run


def shingle_sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): set size, set signature, and for those that
    may have a partner the shared shingles in rare-first order and the number of own ones."""
    spark = docs.sparkSession
    ranges = max(64, RANGES_PER_SPLIT * docs.rdd.getNumPartitions())
    asked = docs.mapInArrow(_cut(shingle, ranges, HOT, CHUNK_SHINGLES), _ROWS_SQL)
    counted = asked.repartition("deal").sortWithinPartitions("deal").mapInArrow(_count(HOT), _ROWS_SQL)
    sets = counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_gather(percent, HOT), _SETS_SQL)
    with small_batches(spark):
        return materialise(sets, "sets")


def _entries(percent: int):
    fields = [("key", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("rest", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                keys = np.frombuffer(row["shared"], np.int64)
                take = min(len(keys), int(_prefix(np.int64(row["n"]), percent)) - row["own"])
                part = keys & (PARTS - 1)
                left = np.bincount(part, minlength=PARTS) - np.cumsum(np.eye(PARTS, dtype=np.int32)[part[:take]], axis=0)
                out += [(k, row["rid"], row["n"], row["own"] + i, left[i].tolist()) for i, k in enumerate(keys[:take].tolist())]
            if out:
                yield rows(out, pa.schema(fields))

    return run


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filter for two entries that meet in their first common shingle."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    need = F.ceil((nx + ny) * percent / (100 + percent))
    length = (100 * nx >= percent * ny) & (100 * ny >= percent * nx)
    positional = F.lit(1) + F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos")) - 1 >= need
    left = F.aggregate(F.zip_with(f"{x}.rest", f"{y}.rest", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
    return length & positional & (F.lit(1) + left >= need)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar; each pair is looked at once."""
    side = lambda s: sets.select(F.col("rid").alias(s), F.col("n").alias(f"n_{s}"), F.col("shared").alias(f"set_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for row in batch.to_pylist():
                common = len(np.intersect1d(np.frombuffer(row["set_a"], np.int64), np.frombuffer(row["set_b"], np.int64), True))
                if 100 * common >= percent * (row["n_a"] + row["n_b"] - common):
                    good.append((row["a"], row["b"]))
            if good:
                yield rows(good, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(run, "a bigint, b bigint")


def _similar(found: list[dict], percent: int) -> np.ndarray:
    """Which pairs of sets are similar, all of them counted at once."""
    sets = [np.frombuffer(r["shared"], np.int64) for r in found]
    sizes, n = np.array([len(s) for s in sets]), np.array([r["n"] for r in found])
    flat = np.concatenate(sets)
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    line = np.repeat(np.arange(len(found)), sizes)
    use = often[column] > 1
    _, column = np.unique(column[use], return_inverse=True)
    line = line[use]
    n = n.astype(np.int32 if 200 * int(n.max()) < 1 << 31 else np.int64)
    common = np.zeros((len(found), len(found)), n.dtype)
    width = 1 << 11
    for start in range(0, int(column.max()) + 1 if len(column) else 0, width):  # bounded scratch space
        here = (column >= start) & (column < start + width)
        dense = np.zeros((len(found), width), np.float32)
        dense[line[here], column[here] - start] = 1
        common += (dense @ dense.T).astype(n.dtype)  # at most ``width`` each, exact
    return 100 * common >= percent * (n[:, None] + n[None, :] - common)


def _cross(found: list[dict], whole: bool) -> np.ndarray:
    """Which pairs of a cell are of different sides; all of them where a block meets itself."""
    side = np.array([r["side"] for r in found])
    return (side[:, None] != side[None, :]) | whole


def _allowed(found: list[dict], percent: int) -> np.ndarray:
    """The filters of :func:`_may_link` for all pairs of a cell."""
    n, left = (np.array([r[c] for r in found]) for c in ("n", "pos"))
    kind = np.int32 if 200 * int(n.max()) < 1 << 31 else np.int64
    n, left = n.astype(kind), (n - left).astype(kind)
    need = -(-(n[:, None] + n[None, :]) * percent // (100 + percent))
    allowed = (100 * n[:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[:, None]) & (np.minimum(left[:, None], left[None, :]) >= need)
    if allowed.any():
        rest = np.array([r["rest"] for r in found], kind)
        shared = np.ones_like(need)
        for part in rest.T:
            shared += np.minimum(part[:, None], part[None, :])
        allowed &= shared >= need
    return allowed


def _blocks(percent: int):
    """Verify the pairs of one cell of a bucket that pass the filters."""
    def cell(found: list[dict]) -> list[tuple]:
        group = np.array([r["label"] for r in found])
        open_ = np.triu(_allowed(found, percent) & _cross(found, found[0]["i"] == found[0]["j"] and found[0]["g"] == found[0]["h"]), 1)
        open_ &= group[:, None] != group[None, :]
        used = np.flatnonzero(open_.any(axis=0) | open_.any(axis=1))
        if not len(used):
            return []
        similar = _similar([found[i] for i in used], percent) & open_[np.ix_(used, used)]
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for a, b in used[np.argwhere(similar)].tolist():
            x, y = find(int(group[a])), find(int(group[b]))
            if x != y:
                root[x] = y
                out.append((found[a]["rid"], found[b]["rid"]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groups(batches, ["key", "g", "h", "i", "j"]):
            out = cell(found) if len(found) > 1 else []
            if out:
                yield rows(out, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _cells(large: DataFrame, percent: int) -> DataFrame:
    """The entries of large buckets (key, rid, n, pos, rest, label) dealt to cells (key, g, h, i, j): block i of band g against block j of band h."""
    band = F.floor(F.log(F.col("n").cast("double")) * 20) * 32 + F.least(F.lit(31), F.floor(20 * F.col("pos") / F.col("n")))
    banded = materialise(large.withColumn("band", band.cast("bigint")), "banded")
    # a few bands of a bucket for each size of set
    bands = materialise(banded.groupBy("key", "band").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)).cast("int").alias("blocks"),
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("left")), "bands")
    x, y = bands.alias("x"), bands.alias("y")
    need = F.ceil((F.col("x.lo") + F.col("y.lo")) * percent / (100 + percent))
    room = ((100 * F.col("x.hi") >= percent * F.col("y.lo")) & (100 * F.col("y.hi") >= percent * F.col("x.lo"))
            & (F.least("x.left", "y.left") >= need))
    meet = x.join(y, "key").where((F.col("x.band") <= F.col("y.band")) & room).select(
        "key", F.col("x.band").alias("g"), F.col("y.band").alias("h"), F.col("x.blocks").alias("g_blocks"), F.col("y.blocks").alias("h_blocks"))
    own = lambda blocks: F.pmod(F.xxhash64("rid", "key"), F.col(blocks)).cast("int")
    entry = ["rid", "n", "pos", "rest", "label"]

    def dealt(mine: str, theirs: str, same: bool) -> DataFrame:
        met = meet.where("g = h") if same else meet.where("g <> h")
        rows_ = banded.join(met.withColumn("band", F.col(mine)), ["key", "band"]).withColumn("own", own(f"{mine}_blocks"))
        rows_ = rows_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(f"{theirs}_blocks") - 1)))
        if same:
            place = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side")]
        else:
            place = [F.col("own" if mine == "g" else "other").alias("i"), F.col("other" if mine == "g" else "own").alias("j"), F.lit(0 if mine == "g" else 1).alias("side")]
        return rows_.select("key", "g", "h", *place, *entry)

    return dealt("g", "h", True).union(dealt("g", "h", False)).union(dealt("h", "g", False))


def _links(reps: DataFrame, percent: int) -> DataFrame:
    """Links between classes: enough of them to connect every pair that is similar."""
    entries = materialise(reps.mapInArrow(_entries(percent), "key bigint, rid bigint, n bigint, pos bigint, rest array<int>"), "prefixes")
    pivots = (entries.groupBy("key").agg(F.min_by(F.struct("rid", "n", "pos", "rest"), "rid").alias("p"), F.count(F.lit(1)).alias("m"))
              .where("m > 1").select("key", "p.*"))
    star = (entries.alias("x").join(pivots.alias("y"), "key").where((F.col("x.rid") != F.col("y.rid")) & _may_link("x", "y", percent))
            .select(F.col("y.rid").alias("a"), F.col("x.rid").alias("b")))
    first = materialise(_verify(star, reps, percent), "links")
    labels = components(first)
    named = (entries.join(labels.withColumnRenamed("node", "rid"), "rid", "left")
             .withColumn("label", F.coalesce("label", "rid")))
    buckets = (named.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
               .where("lo <> hi").drop("lo", "hi"))
    open_ = materialise(named.join(buckets, "key"), "open")
    small = open_.where(F.col("m") <= BUCKET)
    direct = (small.alias("x").join(small.alias("y"), "key")
              .where((F.col("x.rid") < F.col("y.rid")) & (F.col("x.label") != F.col("y.label")) & _may_link("x", "y", percent))
              .select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")))
    cells = _cells(open_.where(F.col("m") > BUCKET).select("key", "rid", "n", "pos", "rest", "label"), percent)
    place = ["key", "g", "h", "i", "j"]
    blocks = (cells.join(reps.select("rid", "shared"), "rid").repartition(*place).sortWithinPartitions(*place)
              .mapInArrow(_blocks(percent), "a bigint, b bigint"))
    return first.union(materialise(_verify(direct, reps, percent).union(blocks), "links"))


def _counts(reps: DataFrame, components_: DataFrame, percent: int) -> DataFrame:
    """(rep, linked): rows of other classes that a class links with. ``components_`` has (rep, weight, label)."""
    schema = pa.schema([("rep", pa.int64()), ("linked", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groups(batches, ["label", "i", "j"]):
            if len(found) > 1:
                similar = _similar(found, percent) & _cross(found, found[0]["i"] == found[0]["j"])
                np.fill_diagonal(similar, False)
                total = similar @ np.array([r["weight"] for r in found], np.int64)
                yield rows([(r["rid"], int(t)) for r, t in zip(found, total) if t], schema)

    member = materialise(reps.join(components_.withColumnRenamed("rep", "rid"), "rid"), "linked")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)).cast("int")
    size = materialise(member.groupBy("label").agg(blocks.alias("blocks")), "sizes")
    cells = (member.join(size, "label").withColumn("side", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rid", "n", "weight", "shared"))
    return (cells.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(run, "rep bigint, linked bigint")
            .groupBy("rep").agg(F.sum("linked").alias("linked")))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the components of :func:`jaccard_join` without counting their links."""
    return _joined(docs, id_col, text_col, shingle, percent, False)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs``; ``n_links`` counts the other rows it links with.

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of distinct
    ``shingle``-word shingles (a shorter text is one shingle). ``component_id`` is the
    smallest doc_id reachable over links, a row's own included.

    * Null and empty texts, and texts without words, have no shingles and link with nothing;
      their component is their own id.
    * Rows are told apart by position, not by id: repeated ids and repeated rows each give
      a row. A null id keeps its row; it is never the smallest id unless all are null.
    * An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    * Long texts count in full.
    """
    return _joined(docs, id_col, text_col, shingle, percent, True)


def _joined(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, counted: bool) -> DataFrame:
    sets = shingle_sets(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), shingle, percent)
    able = sets.where(F.col("shared").isNotNull())
    # written down, so that joins with it deal both sides anew and a large class can be split
    classes = materialise(able.groupBy("n", "s1", "s2").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    reps = materialise(able.join(classes.select("rep"), F.col("rid") == F.col("rep"), "left_semi").select("rid", "n", "own", "shared"), "representatives")
    with small_batches(docs.sparkSession):
        links = _links(reps, percent)
    labels = components(links).withColumnRenamed("node", "rep")
    groups = classes.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    groups = groups.withColumn("n_links", F.col("weight") - 1)
    if counted:
        with small_batches(docs.sparkSession):
            known = materialise(_counts(reps, labels.join(classes.select("rep", "weight"), "rep"), percent), "counts")
        groups = groups.join(known, "rep", "left").withColumn("n_links", F.col("n_links") + F.coalesce("linked", F.lit(0)))
    member = materialise(able.select("rid", "doc_id", "n", "s1", "s2").join(groups, ["n", "s1", "s2"]).select("rid", "doc_id", "label", "n_links"), "members")
    lowest = member.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = member.join(lowest, "label").select("rid", "component_id", "n_links")
    return (sets.select("rid", "doc_id", F.col("n").alias("n_shingles")).join(found, "rid", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                    *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if counted else [])))
