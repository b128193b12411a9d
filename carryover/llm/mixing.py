"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source gets the same expected number of copies, target / source size.
The whole part is certain. The fractional parts are rounded together: two documents
exchange mass (probability times size) at random until one of them is whole, so the
expected mass of the source never moves. A chunk of documents is folded this way to
whole decisions and one document that is still fractional; the fractional ones of the
chunks are folded again, ``CHUNK`` by ``CHUNK``, up a reduction tree to a single one per source.
The words taken from a source therefore differ from its target by less than the size of
one document. Documents are cut into chunks by hash, so a source that holds a third of all
rows is as many small groups as its size asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carryover.session import materialise

CHUNK = 128
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """(source, source_size, chunks, target) from (source, source_size, chunks).

    Weights repeat over the sources in code point order, null last. Targets share the
    total by weight; those above ``limit`` times their source stop there, smallest room
    per weight first, and the rest is shared again. One row per source is all that is sorted.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    room = (sizes.withColumn("weight", weight).withColumn("room", F.lit(float(limit)) * F.col("source_size"))
            .withColumn("ratio", F.col("room") / F.col("weight")))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    full = room.withColumn("full", left / open_weight > F.col("ratio"))
    spare = F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).over(every)
    shared = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    return (full.withColumn("target", F.when(F.col("full"), F.col("room")).otherwise(F.least("room", F.col("weight") * spare / shared)))
            .select("source", "source_size", "chunks", "target"))


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only, so that a rerun agrees."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold(units: Column, seed: Column) -> Column:
    """(rest, whole): pivot the documents of an array of (mass, tie, doc_id, size, p) one after another."""
    unit = "struct<mass:double,tie:bigint,doc_id:bigint,size:bigint,p:double>"
    start = F.struct(F.lit(None).cast(unit).alias("rest"), F.array().cast("array<struct<doc_id:bigint,size:bigint,up:int>>").alias("whole"))

    def with_p(u: Column, p: Column) -> Column:
        return F.struct(u.mass.alias("mass"), u.tie.alias("tie"), u.doc_id.alias("doc_id"), u["size"].alias("size"),
                        F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))

    def decided(u: Column, up: int) -> Column:
        return F.struct(u.doc_id.alias("doc_id"), u["size"].alias("size"), F.lit(up).alias("up"))

    def step(acc: Column, x: Column) -> Column:
        r = acc.rest
        rise = F.least(r.mass * (1 - r.p), x.mass * x.p)   # mass that may go from x to the rest
        fall = F.least(r.mass * r.p, x.mass * (1 - x.p))   # and back
        toss = F.struct((_draw(seed, r.tie, x.tie) * (rise + fall) < fall).alias("gain"))

        def settle(t: Column) -> Column:
            case = lambda rest, unit, up: F.struct(rest.alias("rest"), decided(unit, up).alias("whole"))
            return (F.when(t.gain & (r.mass * (1 - r.p) <= x.mass * x.p), case(with_p(x, x.p - r.mass * (1 - r.p) / x.mass), r, 1))
                    .when(t.gain, case(with_p(r, r.p + x.mass * x.p / r.mass), x, 0))
                    .when(r.mass * r.p <= x.mass * (1 - x.p), case(with_p(x, x.p + r.mass * r.p / x.mass), r, 0))
                    .otherwise(case(with_p(r, r.p - x.mass * (1 - x.p) / r.mass), x, 1)))

        paired = _let(_let(toss, settle), lambda s: F.struct(s.rest.alias("rest"), F.array_append(acc.whole, s.whole).alias("whole")))
        return F.when(r.isNull(), F.struct(with_p(x, x.p).alias("rest"), acc.whole.alias("whole"))).otherwise(paired)

    return F.aggregate(units, start, step)


def mix_sources(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", *,
                weights: Sequence[float] = (1,), limit: float = 3.0, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for every row of ``docs``.

    ``taken`` is ``size`` times ``copies``, the copies of the document in the mix.

    * A null source is a source of its own, ordered last. A null size counts as 0; documents of
      size 0 are in no copy. A source of total 0 has target 0.
    * Of n rows that repeat doc_id, source and size (null ids too), as many get a copy more as their n
      fractions sum up to in whole; what is left of the sum is drawn like one row. Which of them get it is open.
    * An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    units = materialise(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                    F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
                        .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"),
                                        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / CHUNK)).cast("bigint").alias("chunks"))
    goals = materialise(targets(sizes, weights, limit), "targets")
    s = goals.withColumnRenamed("source", "of")
    rate = F.least(F.lit(float(limit)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    planned = (units.join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", rate)
               .withColumn("sure", F.floor("rate")).withColumn("sum", F.col("rows") * (F.col("rate") - F.col("sure")))
               .withColumn("held", F.floor("sum")).withColumn("p", F.col("sum") - F.col("held")).drop("sum"))
    tie = F.xxhash64(F.lit(seed), "doc_id", "size")
    chunk = F.when(F.col("p") > 0, F.pmod(tie, F.col("chunks")))
    one = F.struct(F.col("size").cast("double").alias("mass"), tie.alias("tie"), "doc_id", "size", "p")
    level, most = 0, goals.agg(F.max("chunks")).first()[0] or 1
    step = (planned.where("p > 0 AND size > 0").select("source", chunk.alias("chunk"), one.alias("unit")))
    decided = []
    while True:
        folded = materialise(step.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
                             .select("source", "chunk", _fold(F.col("units"), F.lit(seed * 64 + level)).alias("f"))
                             .select("source", "chunk", "f.rest", "f.whole"), "folded")
        decided.append(folded.select("source", F.explode("whole").alias("w")).select("source", "w.*"))
        if most <= 1:
            break
        level, most = level + 1, -(-most // CHUNK)
        step = folded.select("source", F.expr(f"chunk div {CHUNK}").alias("chunk"), F.col("rest").alias("unit"))
    last = (_draw(F.lit(seed), F.lit("last"), F.col("rest.tie")) < F.col("rest.p")).cast("int")
    choices = folded.select("source", "rest.doc_id", "rest.size", last.alias("up"))
    for part in decided:
        choices = choices.union(part)
    c = choices.select(F.col("source").alias("c_source"), F.col("doc_id").alias("c_id"), F.col("size").alias("c_size"), "up")
    joined = planned.join(c, F.col("doc_id").eqNullSafe(F.col("c_id")) & F.col("source").eqNullSafe(F.col("c_source"))
                          & (F.col("size") == F.col("c_size")), "left")
    more = (F.col("row") <= F.col("held") + F.coalesce("up", F.lit(0))).cast("int")
    copies = F.when(F.col("size") > 0, F.col("sure") + more).otherwise(0).cast("bigint")
    return (joined.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))).withColumn("copies", copies)
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source"))
