"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors.

A text becomes a vector of byte trigrams (lower-cased, every run of other ASCII signs one
space), weighted by TF-IDF and scaled to length one. Document frequencies are counted over
every learning row. Each language is clustered into a few centroids (spherical k-means
inside Spark, one task per language) on at most ``sample`` of its different texts, a bound that
is a parameter. Clusters start from rows drawn by their distance (k-means++); one that keeps fewer
than a twentieth of the rows is started anew inside the largest, and goes if that does not help, so
that no centroid stands for oddities. A text takes the language of the centroid with the largest cosine and is
rejected when it lies farther away than anything the language was learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.llm.grams import binary_parts
from carryover.session import materialise

DIMENSIONS = 1 << 14
GROUP_BYTES = 1 << 20  # text that is turned into vectors at once
GROUP_TEXTS = 128


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    table[0x80:] = np.arange(27, 27 + 128)
    return table


CLASS = _classes()


def _add(counts: np.ndarray, row: np.ndarray | int, data: np.ndarray, edge: np.ndarray | None) -> None:
    """Add the trigrams of ``data`` to the rows of ``counts``; ``edge`` marks the first byte of a text."""
    c = CLASS[data]
    if edge is not None:
        c[edge] *= c[edge] > 0
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    if edge is not None:
        keep |= edge
    c = c[keep]
    of = row[keep] if isinstance(row, np.ndarray) else None
    if len(c) < 3:
        return
    gram = ((c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]) * np.uint32(2654435761)
    slot = (gram >> np.uint32(32 - 14)).astype(np.int64)
    if of is None:
        counts[row] += np.bincount(slot, minlength=DIMENSIONS)
    else:
        same = of[:-2] == of[2:]
        flat = np.bincount(of[:-2][same] * DIMENSIONS + slot[same], minlength=counts.size)
        counts += flat.reshape(counts.shape)


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, trigram counts per text) for groups of texts; every text is framed by a space."""
    texts = len(offsets) - 1
    start = 0
    while start < texts:
        stop = int(np.searchsorted(offsets, offsets[start] + GROUP_BYTES, "right")) - 1
        stop = max(start + 1, min(stop, start + GROUP_TEXTS, texts))
        counts = np.zeros((stop - start, DIMENSIONS), np.float32)
        part = data[offsets[start]:offsets[stop]]
        lengths = np.diff(offsets[start:stop + 1])
        if stop == start + 1 and len(part) > GROUP_BYTES:  # one long text, piece by piece
            framed = np.concatenate((np.uint8([32]), part, np.uint8([32])))
            for at in range(0, len(framed), GROUP_BYTES):
                _add(counts, 0, framed[max(0, at - 2):at + GROUP_BYTES], None)
        else:
            row = np.repeat(np.arange(stop - start), lengths + 2)
            ends = np.cumsum(lengths + 2)
            framed = np.full(len(row), 32, np.uint8)
            inside = np.ones(len(row), bool)
            inside[ends - 1] = False
            inside[ends - lengths - 2] = False
            framed[inside] = part
            edge = np.zeros(len(row), bool)
            edge[ends - lengths - 2] = True
            _add(counts, row, framed, edge)
        yield start, counts
        start = stop


def _scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in small(batches):
        for _, counts in counted(*binary_parts(batch.column(0))):
            seen += (counts > 0).sum(axis=0)
        rows += batch.num_rows
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], names=["slot", "df"])


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, counts in counted(*binary_parts(batch.column(0))):
                vectors = _scaled(counts, idf)
                at = [np.flatnonzero(v) for v in vectors]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(start, len(at)), batch.column(2).slice(start, len(at)), pa.array([a.astype(np.int32).tobytes() for a in at]),
                     pa.array([v[a].astype(np.float32).tobytes() for v, a in zip(vectors, at)])], names=["lang", "h", "slots", "weights"])

    return run


LEAST_SHARE = 0.05  # of a language's rows that a centroid stands for


def _moved(x: np.ndarray, centres: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, rows of each) after rounds of spherical k-means; centres without rows go."""
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.array([x[near == k].sum(axis=0) for k in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1)
        centres = sums[norm > 0] / norm[norm > 0, None]
    return centres, np.bincount(np.argmax(x @ centres.T, axis=1), minlength=len(centres))


def clustered(x: np.ndarray, clusters: int, rounds: int) -> np.ndarray:
    """At most ``clusters`` centres of the rows of length one in ``x``, none for fewer than LEAST_SHARE of them."""
    draw = np.random.default_rng(len(x))
    centres = x[draw.integers(len(x))][None, :]
    while len(centres) < min(clusters, len(x)):
        far = np.maximum(1 - (x @ centres.T).max(axis=1), 0).astype(np.float64) ** 2
        if far.sum() <= 1e-12:  # nothing but copies is left
            break
        centres = np.vstack((centres, x[draw.choice(len(x), p=far / far.sum())]))
    for again in range(clusters + 1):
        centres, size = _moved(x, centres, rounds)
        small_ = size < LEAST_SHARE * len(x)
        if not small_.any():
            return centres
        if again < clusters:  # start small ones anew inside the largest
            largest = np.flatnonzero(np.argmax(x @ centres.T, axis=1) == size.argmax())
            centres[small_] = x[draw.choice(largest, int(small_.sum()))]
    while len(centres) > 1:
        size = np.bincount(np.argmax(x @ centres.T, axis=1), minlength=len(centres))
        if size.min() >= LEAST_SHARE * len(x):
            break
        centres = _moved(x, np.delete(centres, size.argmin(), axis=0), 1)[0]
    return centres


def _cluster(clusters: int, rounds: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")  # the same order, and so the same draws, wherever it runs
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, (slots, weights) in enumerate(zip(rows["slots"], rows["weights"])):
            x[i, np.frombuffer(slots, np.int32)] = np.frombuffer(weights, np.float32)
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "floor": [], "members": []})
        centres = clustered(x, clusters, rounds)
        cosine = x @ centres.T
        members = np.bincount(cosine.argmax(axis=1), minlength=len(centres))
        floor = float(cosine.max(axis=1).min())
        return pd.DataFrame({"lang": [key[0]] * len(centres), "centroid": [c.astype(np.float32).tobytes() for c in centres],
                             "floor": [floor] * len(centres), "members": members})

    return run


def drawn_texts(learn: DataFrame, sample: int) -> DataFrame:
    """(text, lang, h): of each language the ``sample`` different texts with the smallest hashes, each once."""
    hashed = learn.select("text", "lang", F.xxhash64("text").alias("h"))
    # one row per language; a sketch, with room, so that enough texts come through
    sizes = materialise(hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("of")), "languages")
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("of"))
    place = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # the hashes are chosen before any text moves; copies of a text are put together before they meet
    some = hashed.select("lang", "h").join(sizes, "lang").where(place < share).select("lang", "h").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h"))
    chosen = materialise(some.withColumn("_n", first).where(F.col("_n") <= sample).drop("_n"), "chosen")
    return hashed.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang", "h")


def fit(learn: DataFrame, *, sample: int = 600, clusters: int = 4, rounds: int = 8, slack: float = 0.25):
    """(languages of the centroids, centroids, cosine floors, idf) from (text, lang) with non-null lang."""
    df = np.zeros(DIMENSIONS, np.int64)
    rows = 0
    # at most DIMENSIONS + 1 rows
    for slot, n in learn.select("text").mapInArrow(_frequencies, "slot bigint, df bigint").groupBy("slot").agg(F.sum("df")).collect():
        if slot < 0:
            rows = n
        else:
            df[slot] = n
    idf = (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)
    fitted = (drawn_texts(learn, sample).mapInArrow(_vectors(idf), "lang string, h bigint, slots binary, weights binary").groupBy("lang")
              .applyInPandas(_cluster(clusters, rounds), "lang string, centroid binary, floor double, members bigint")).collect()
    fitted.sort(key=lambda r: (r.lang, r.centroid))
    centroids = np.array([np.frombuffer(r.centroid, np.float32) for r in fitted]).reshape(-1, DIMENSIONS)
    return [r.lang for r in fitted], centroids, np.array([r.floor * slack for r in fitted]), idf


_ADDED = ("_lang_pred", "_score", "_rejected")


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _predict(at: int, langs: list[str], centroids: np.ndarray, floors: np.ndarray, idf: np.ndarray):
    across = np.ascontiguousarray(centroids.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            data, offsets = binary_parts(batch.column(at))
            ascii_letter = np.concatenate(([0], np.cumsum((CLASS[data] > 0) & (CLASS[data] < 27))))
            letters = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
            for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                letters[i] = any(ch.isalpha() for ch in bytes(data[offsets[i]:offsets[i + 1]]).decode("utf-8", "replace"))
            best, score, near = [], [], []
            for _, counts in counted(data, offsets):
                if langs:
                    cosine = _scaled(counts, idf) @ across
                    top = cosine.argmax(axis=1)
                    best += top.tolist()
                    score += np.clip(cosine[np.arange(len(top)), top], 0, 1).tolist()
            ok = letters if langs else np.zeros(len(letters), bool)
            near = [bool(o and s > 0 and s >= floors[b]) for o, b, s in zip(ok, best, score)] if langs else [False] * len(letters)
            names = [*batch.schema.names, *_ADDED]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([langs[b] if o else "und" for o, b in zip(ok, best)] if langs else ["und"] * len(letters), pa.string()),
                 pa.array([float(s) if o else 0.0 for o, s in zip(ok, score)] if langs else [0.0] * len(letters), pa.float64()),
                 pa.array([not n for n in near], pa.bool_())], names=names)

    return run


def annotated(docs: DataFrame, learn: DataFrame, text_col: str = "text", **fitting) -> DataFrame:
    """``docs`` with _lang_pred, _score and _rejected behind its own columns, see :func:`language_id`."""
    model = fit(learn.select(F.col("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL"), **fitting)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(_ADDED, (T.StringType(), T.DoubleType(), T.BooleanType())))])
    return docs.mapInArrow(_predict(docs.columns.index(text_col), *model), schema)


def language_id(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, held_out: Column | None = None,
                **fitting) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs``.

    ``learn`` holds (text, lang); rows with a null in either are not learned from. ``score`` is the cosine to
    the nearest centroid. ``rejected`` marks texts that have no letter or lie farther from every centroid than
    the floor allows (``slack`` times the smallest cosine the language was learned from).

    * Null and empty texts and texts without a letter are ``und`` with score 0, and rejected; so is
      every text when there is nothing to learn from.
    * Every row gives a row; null and repeated ids are passed on. Texts are read whole.
    * Ties between centroids go to the language that is first in order. Other columns are not looked at.
    """
    flag = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), flag.alias("held_out"), F.col(text_col).alias("text"))
    return annotated(source, learn, **fitting).select(
        "doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
