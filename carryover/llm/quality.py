"""Quality classification by hierarchical empirical Bayes over hosts and paths.

1. A logistic classifier on hashed words and the make-up of the text gives each document
   evidence. It is fitted in one task on at most about ``sample`` labelled rows (a parameter);
   everything below covers all rows.
2. Labels are counted per path and host, together with the classifier's own verdicts on
   every document at a small ``weight``. Beta posteriors shrink a path toward its host and a host
   toward the whole corpus; how strongly is estimated from the spread between the sites.
3. A document's log-odds are its evidence plus what its path's posterior adds to the corpus's.

All counting combines before it shuffles, so a host with a third of all rows is one small row per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.llm import grams
from carryover.session import materialise

SLOTS = 1 << 18
RARE = 8  # word slots seen in fewer labelled texts stay without weight
GROUP_TEXTS, GROUP_BYTES = 128, 1 << 20
_WORDS = grams.alphanumeric()
_SIGNS = np.array([b for b in range(0x21, 0x7F) if not chr(b).isalnum()])
DENSE = 7 + len(_SIGNS)


def described(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, distinct word slot) pairs and numbers on the make-up for groups of texts."""
    data, offsets = grams.binary_parts(column)
    texts, start = len(offsets) - 1, 0
    while start < texts:
        stop = int(np.searchsorted(offsets, offsets[start] + GROUP_BYTES, "right")) - 1
        stop = max(start + 1, min(stop, start + GROUP_TEXTS, texts))
        part, edges = data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start]
        count = stop - start
        words, first = grams.words(part, edges, _WORDS)
        of = np.repeat(np.arange(count), np.diff(first))
        pairs = np.unique(of * SLOTS + (words >> np.uint64(46)).astype(np.int64))
        line, slot = pairs // SLOTS, pairs % SLOTS
        size = np.diff(edges)
        table = np.bincount(np.repeat(np.arange(count), size) * 256 + part, minlength=count * 256).reshape(count, 256)
        share = table / np.maximum(size, 1)[:, None]
        number = np.diff(first)
        dense = np.empty((count, DENSE), np.float32)
        dense[:, 0], dense[:, 1] = np.log1p(size), np.log1p(number)
        dense[:, 2] = np.bincount(line, minlength=count) / np.maximum(number, 1)
        dense[:, 3] = _WORDS[0][None, :] @ share.T
        dense[:, 4], dense[:, 5], dense[:, 6] = share[:, 48:58].sum(axis=1), share[:, 65:91].sum(axis=1), share[:, 10]
        dense[:, 7:] = np.sqrt(share[:, _SIGNS])
        yield line, slot, dense
        start = stop


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, dense = [], []
        for line, slot, numbers in described(batch.column(0)):
            edges = np.searchsorted(line, np.arange(len(numbers) + 1))
            slots += [slot[a:b].astype(np.uint32).tobytes() for a, b in zip(edges, edges[1:])]
            dense += [d.tobytes() for d in numbers]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(slots, pa.binary()), pa.array(dense, pa.binary())], names=["labels", "slots", "dense"])


def _fit(labels: int, rounds: int, decay: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["slots", "dense"])
        at = [np.frombuffer(s, np.uint32).astype(np.int64) for s in rows["slots"]]
        line, slot = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at)
        dense = np.array([np.frombuffer(d, np.float32) for d in rows["dense"]])
        mean, spread = dense.mean(axis=0), dense.std(axis=0) + 1e-3
        x = np.clip((dense - mean) / spread, -4, 4)
        common = np.bincount(slot, minlength=SLOTS) >= RARE
        line, slot = line[common[slot]], slot[common[slot]]
        out = []
        for k in range(labels):
            y = np.array([row[k] for row in rows["labels"]], float)
            use = ~np.isnan(y)
            n = max(1, use.sum())
            target = np.where(use, y, 0)
            rate = (target.sum() + 1) / (n + 2)
            weights = np.zeros(SLOTS + DENSE + 1)
            weights[-1] = np.log(rate / (1 - rate))
            first, second = np.zeros_like(weights), np.zeros_like(weights)
            for step in range(1, rounds + 1):
                z = np.bincount(line, weights=weights[slot], minlength=len(at)) + x @ weights[SLOTS:-1] + weights[-1]
                error = np.where(use, 1 / (1 + np.exp(-z)) - target, 0) / n
                slope = np.concatenate((np.bincount(slot, weights=error[line], minlength=SLOTS), x.T @ error, [error.sum()]))
                slope[:-1] += decay * weights[:-1]
                first, second = .9 * first + .1 * slope, .99 * second + .01 * slope ** 2
                weights -= .1 * (first / (1 - .9 ** step)) / (np.sqrt(second / (1 - .99 ** step)) + 1e-8)
            out.append(weights)
        return pd.DataFrame({"model": [np.concatenate([mean, spread, *out]).astype(np.float32).tobytes()]})

    return run


def _evidence(model: np.ndarray, labels: int):
    mean, spread = model[:DENSE], model[DENSE:2 * DENSE]
    weights = model[2 * DENSE:].reshape(labels, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for line, slot, dense in described(batch.column(3)):
                z = np.stack([np.bincount(line, weights=w[slot], minlength=len(dense)) for w in weights], axis=1)
                z += np.clip((dense - mean) / spread, -4, 4) @ weights[:, SLOTS:-1].T + weights[:, -1]
                found += np.clip(z, -30, 30).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "host", "path", "z"])

    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, prior: Column, low: float, high: float) -> float:
    """Rows that the prior of a site is worth, by moments: little spread between sites means a strong prior."""
    row = (sites.withColumn("off", F.pow(F.col("good") / F.col("n") - prior, 2) * F.col("n")).where("n > 0")
           .agg(F.sum("off").alias("off"), F.sum(prior * (1 - prior)).alias("pure"), F.sum(F.col("n") * prior * (1 - prior)).alias("all"))).first()
    if not row["pure"] or row["off"] is None or row["off"] <= row["pure"]:
        return high
    between = (row["off"] - row["pure"]) / max(row["all"] - row["pure"], 1e-9)  # share of the variance between sites
    return float(min(high, max(low, (1 - between) / between))) if between < 1 else low


def site_posteriors(counted: DataFrame, low: float = 1.0, high: float = 1000.0) -> tuple[DataFrame, float]:
    """((host, path, rate), corpus rate) from (host, path, n, good), shrinking path to host and host to corpus."""
    n, good = counted.agg(F.sum("n"), F.sum("good")).first()
    corpus = ((good or 0) + 1) / ((n or 0) + 2)
    hosts = counted.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    k = _strength(hosts, F.lit(corpus), low, high)
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + k * corpus) / (F.col("n") + k)).alias("host_rate"))
    paths = counted.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    kp = _strength(paths, F.col("host_rate"), low, high)
    return paths.select("host", "path", ((F.col("good") + kp * F.col("host_rate")) / (F.col("n") + kp)).alias("rate")), corpus


def quality_scores(docs: DataFrame, labels: DataFrame, label_cols: Sequence[str], host: Column, path: Column, id_col: str = "doc_id",
                   text_col: str = "text", *, sample: int = 6000, rounds: int = 150, decay: float = 1e-3, weight: float = 0.05) -> DataFrame:
    """(doc_id, host, path, p_<label> ...) for every row of ``docs``; ``labels`` has (doc_id, 0/1 label columns).

    * Null and empty texts have the evidence of an empty text. A null host or path is a site of its own.
    * A null label is not counted; labels without a document are ignored. Repeated labels of a document count
      once, as their mean; repeated rows of a document each give a row.
    * Without labels every probability is what the empty counts give, 0.5. An empty table gives an empty result.
    * Texts are read whole. Other columns are not looked at.
    """
    many = len(label_cols)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    marks = materialise(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id"))
                        .agg(F.array(*[F.avg(F.col(c).cast("double")) for c in label_cols]).alias("labels")), "labels")
    known = marks.count()
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, known))))
    shown = F.transform("labels", lambda v: F.coalesce(v, F.lit(float("nan"))))
    fitted = (source.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", shown.alias("labels"))  # about ``sample`` rows
              .mapInArrow(_examples, "labels array<double>, slots binary, dense binary").withColumn("every", F.lit(0)).groupBy("every").applyInPandas(_fit(many, rounds, decay), "model binary")).first()
    model = np.frombuffer(fitted.model, np.float32) if fitted else np.concatenate((np.zeros(DENSE), np.ones(DENSE), np.zeros(many * (SLOTS + DENSE + 1)))).astype(np.float32)
    scored = materialise(source.mapInArrow(_evidence(model, many), "doc_id bigint, host string, path string, z array<double>"), "evidence")
    marked = scored.groupBy("doc_id", "host", "path").agg(F.lit(1).alias("one")).join(marks, "doc_id").select("host", "path", "labels")
    out = scored
    for i, name in enumerate(label_cols):
        label, z = F.col("labels")[i], F.col("z")[i]
        hard = marked.where(label.isNotNull()).groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(label).alias("good"))
        soft = scored.groupBy("host", "path").agg((weight * F.count(F.lit(1))).alias("n"), (weight * F.sum(1 / (1 + F.exp(-z)))).alias("good"))
        counted = materialise(hard.union(soft).groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "sites")
        sites, corpus = site_posteriors(counted)
        rates = materialise(sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "rate"), "posteriors")
        joined = out.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left").drop("h", "q")
        odds = z + F.coalesce(_logit(F.col("rate")) - _logit(F.lit(corpus)), F.lit(0.0))
        out = joined.withColumn(f"p_{name}", 1 / (1 + F.exp(-odds))).drop("rate")
    return out.drop("z")
