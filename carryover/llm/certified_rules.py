"""Quality rules whose cutoffs are certified on labelled holdouts.

A rule turns a document's statistics into a badness from 0 to 1000 and rejects from a cutoff
on. Labelled documents are split in two by their ids. The tuning half proposes a cutoff per
stratum and rule, the one that rejects most bad documents at a price per good one. The holdout
half has to certify it: cutoffs are tested from the most lenient one down, each by the exact
binomial tail of its rejected good documents, and the first that fails ends the sequence, so
that the number of cutoffs tried costs nothing. What is certified is the rate of good
documents lost: at most ``risk`` in every stratum, shared out among the rules in use there,
with ``confidence`` for all strata and rules together (Bonferroni over stratum and rule). A
stratum with too few good documents on its holdout certifies nothing and loses nothing.

All labelled documents take part: they are reduced to counts per stratum, rule and badness,
1001 of them at most for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.llm.batches import small_batches
from carryover.llm.grams import binary_parts
from carryover.llm.spans import NOT_SPACE, bytes_in, encoded_words, per_text, spans
from carryover.session import materialise

WORST = 1000
# The characters counted as symbols.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER, _MARKS = bytes_in((0x41, 0x5A)), np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_LINE, _FIRST_BYTE = ~bytes_in((0x0A, 0x0A)), ~bytes_in((0x80, 0xBF))

# Badness, larger is worse, as SQL over the statistics of a text that has words.
RULES = {
    "symbols": "1000 * n_symbols div word_chars",
    "repeats": "1000 * n_repeat_words div n_words",
    "lines": "1000 * n_dup_lines div n_lines",
    "capitals": "1000 * n_capitals div word_chars",
    "marks": "1000 * n_marks div n_words",
    "long_words": "20 * word_chars div n_words",
    "short_words": "1000 - least(1000, 100 * word_chars div n_words)",
    "brevity": "1000 - least(1000, n_words)",
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def _ids(values: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for the different values."""
    return pa.array(values).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _total(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    out, some = np.zeros(len(offsets) - 1, np.int64), offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.add.reduceat(flags, offsets[:-1][some], dtype=np.int64)
    return out


def _repeated(code: np.ndarray, text: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Flags of the words that lie in a window of three words which their text holds twice or more."""
    covered = np.zeros(len(code), bool)
    place = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.flatnonzero(place + 3 <= np.repeat(counts, counts))
    if len(first):
        words, texts = int(code.max()) + 1, len(counts)
        window = _ids(code[first] * words + code[first + 1])
        if (int(window.max()) + 1) * words * texts >= 1 << 62:
            window, words, third = _ids(window * words + code[first + 2]), 1, 0
        else:
            third = code[first + 2]
        same = _ids((window * words + third) * texts + text[first])
        again = first[np.bincount(same)[same] >= 2]
        for shift in range(3):
            covered[again + shift] = True
    return covered


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = binary_parts(batch.column(2))
        starts, ends = spans(data, offsets, NOT_SPACE)
        counts, text = per_text(starts, offsets)
        code, _ = encoded_words(data, starts, ends, NOT_SPACE, lower=False)
        word_edges = np.concatenate(([0], np.cumsum(counts)))
        line_starts, line_ends = spans(data, offsets, _LINE)
        lines, in_text = encoded_words(data, line_starts, line_ends, _LINE, lower=False)[0], per_text(line_starts, offsets)[1]
        # between two lines stand line feeds only
        with_word = np.logical_or.reduceat(NOT_SPACE[data], line_starts) if len(line_starts) else np.empty(0, bool)
        texts = batch.num_rows
        held = np.bincount(in_text[with_word], minlength=texts)
        different = np.unique(lines[with_word] * texts + in_text[with_word]) % texts
        columns = [counts, _total(NOT_SPACE[data] & _FIRST_BYTE[data], offsets), _total(SYMBOLS[data], offsets),
                   held - np.bincount(different, minlength=texts), _total(_repeated(code, text, counts), word_edges), held,
                   _total(_UPPER[data], offsets), _total(_MARKS[data], offsets)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c.astype(np.int64)) for c in columns]],
                                         names=["doc_id", "stratum", *STATS])


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """(doc_id, stratum, statistics...) of every whole text; null counts as a text without words."""
    group = F.coalesce((F.col("lang") if stratum is None else stratum).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), group.alias("stratum"), F.col(text_col).alias("text")).mapInArrow(
        _measured, f"doc_id bigint, stratum string, {', '.join(f'{c} bigint' for c in STATS)}")


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws that each hit with probability p, for k up to n * p."""
    if k < 0:
        return 0.0
    if p >= 1:
        return float(k >= n)
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    part = total = math.exp(term)
    for i in range(k, 0, -1):
        part *= i * (1 - p) / ((n - i + 1) * p)
        total += part
        if part < total * 1e-18:
            break
    return total


def most_rejections(n: int, risk: float, level: float) -> int:
    """The largest number of hits among n that still shows a rate below ``risk``; -1 where none does."""
    low, high = -1, int(n * risk)
    while low < high:
        middle = (low + high + 1) // 2
        if tail(middle, n, risk) <= level:
            low = middle
        else:
            high = middle - 1
    return low


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate after k hits in n."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(k, n, middle) > level else (low, middle)
    return high


_CUTOFFS = "stratum string, rule string, cutoff int, good bigint, good_lost bigint, bound double, bad bigint, bad_caught bigint"


def _certifier(rules: list[str], risk: float, level: float, price: float):
    def run(counts: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((len(rules), 2, 2, WORST + 1), np.int64)  # rule, holdout, good, badness
        at = [counts["rule"].map(rules.index), counts["holdout"].astype(int), counts["good"].astype(int), counts["badness"]]
        np.add.at(table, tuple(np.asarray(a) for a in at), counts["n"].to_numpy())
        rejected = table[..., ::-1].cumsum(-1)[..., ::-1]  # by a cutoff
        proposed = {}
        for r, rule in enumerate(rules):
            worth = rejected[r, 0, 0] - price * rejected[r, 0, 1]
            worth[0] = 0  # a cutoff of 0 rejects everything
            if worth.max() > 0:
                proposed[r] = int(np.flatnonzero(worth == worth.max())[-1])
        out = []
        for r, target in proposed.items():
            lost, caught = rejected[r, 1, 1], rejected[r, 1, 0]
            allowed = most_rejections(int(lost[0]), risk / len(proposed), level)
            certified = [c for c in range(target, WORST + 1) if lost[c] <= allowed]
            if certified:
                c = certified[0]
                out.append((counts["stratum"].iloc[0], rules[r], c, lost[0], lost[c], upper_bound(int(lost[c]), int(lost[0]), level), caught[0], caught[c]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _CUTOFFS.split(", ")])

    return run


def badness(rules: Mapping[str, str]) -> Column:
    """array<struct<rule, badness>> of a text's statistics."""
    level = lambda sql: F.least(F.lit(WORST), F.coalesce(F.expr(sql), F.lit(0))).cast("int")
    return F.array(*[F.struct(F.lit(name).alias("rule"), level(sql).alias("badness")) for name, sql in rules.items()])


def certified_cutoffs(stats: DataFrame, labels: DataFrame, label_id: str = "doc_id", good_col: str = "quality", *, rules: Mapping[str, str] = RULES,
                      risk: float = 0.05, confidence: float = 0.95, price: float = 5.0) -> DataFrame:
    """(stratum, rule, cutoff, good, good_lost, bound, bad, bad_caught): certified cutoffs, figures on the holdout.

    ``stats`` are rows with words that the base rules keep. A document with contradicting labels takes no part.
    """
    mark = F.col(good_col).cast("int")
    marks = (labels.select(F.col(label_id).cast("bigint").alias("doc_id"), mark.alias("good")).where("doc_id IS NOT NULL AND good IN (0, 1)")
             .groupBy("doc_id").agg(F.min("good").alias("good"), F.max("good").alias("_most")).where("good = _most").drop("_most"))
    holdout = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    counts = (stats.join(marks, "doc_id").select("stratum", holdout.alias("holdout"), (F.col("good") == 1).alias("good"), F.inline(badness(rules)))
              .groupBy("stratum", "rule", "badness", "holdout", "good").agg(F.count(F.lit(1)).alias("n")))
    counts = materialise(counts, "rule_counts")
    tests = counts.select("stratum").distinct().count() * len(rules)
    # a group holds at most 4 * 1001 counts for each rule
    return counts.groupBy("stratum").applyInPandas(_certifier(list(rules), risk, (1 - confidence) / max(tests, 1), price), _CUTOFFS)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, stratum: Column | None = None,
                  label_id: str = "doc_id", good_col: str = "quality", rules: Mapping[str, str] = RULES, risk: float = 0.05,
                  confidence: float = 0.95, price: float = 5.0, least_words: int = 50) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules).

    A text fails the base rules with fewer than ``least_words`` words or when more than half of
    its words lie in repeated windows of three. Any other text is kept unless a certified
    rule of its stratum (null: '') rejects it. ``labels`` mark good documents with 1, bad ones with 0.

    * Null and empty texts have no words and fail the base rules. Texts are read whole; a
      task needs memory for a small multiple of its longest text.
    * Every row gives a row. Each row with a labelled id counts as a labelled document.
    * Without labels, or with too few, no rule is certified and the base rules decide alone.
    * An empty table gives an empty result; other columns of either table are not looked at.
    """
    with small_batches(docs.sparkSession, rows=2000):
        stats = materialise(text_stats(docs, id_col, text_col, stratum), "stats")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    judged = stats.where("NOT base_failed AND n_words > 0")
    cutoffs = certified_cutoffs(judged, labels, label_id, good_col, rules=rules, risk=risk, confidence=confidence, price=price)
    # one row per stratum, one entry per rule
    by_stratum = materialise(cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")), "cutoffs")
    beyond = F.filter(badness(rules), lambda x: F.coalesce(x["badness"] >= F.col("cutoffs")[x["rule"]], F.lit(False)))
    rejected = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.transform(beyond, lambda x: x["rule"]))
    return (stats.join(by_stratum, "stratum", "left").withColumn("failed_rules", rejected)
            .select("doc_id", *STATS[:5], "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules"))
