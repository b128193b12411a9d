"""Rule tables applied by joins, so that a plan does not grow with the number of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.operators.skew import lookup


def prefix_join(df: DataFrame, key: str, rules: DataFrame, values: Sequence[str], *, prefix: str = "prefix", order: str | None = None) -> DataFrame:
    """``df`` with the ``values`` of the rule whose prefix starts ``key``, NULL where none does.

    Of several such rules the longest prefix wins, or with ``order`` the rule that comes first by
    that column (a tie goes to the longer prefix). Of rules with one and the same prefix the
    first by ``order``, else by their values, counts. Prefixes compare byte by byte; an empty one
    starts every key, a NULL key or prefix matches nothing.

    Every different key is cut to the lengths that some rule has, and the cuts meet the rules by
    equality: the work is keys times lengths, however many rules there are.
    """
    kept = F.struct(*([F.col(order).alias("_order")] if order else []), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    named = rules.where(F.col(prefix).isNotNull()).groupBy(F.col(prefix).cast("string").alias("_rule")).agg(F.min(kept).alias("_kept"))
    # as many entries as there are different lengths of prefixes
    lengths = rules.agg(F.sort_array(F.collect_set(F.char_length(F.col(prefix).cast("string")))).alias("l")).scalar()
    text = F.col(key).cast("string")
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), text.alias("_text")).distinct()
    cut = (keys.withColumn("_lengths", lengths).select("_key", "_text", F.explode("_lengths").alias("_length"))
           .where(F.col("_length") <= F.char_length("_text")))
    hits = cut.join(named, F.substring(F.col("_text"), F.lit(1), F.col("_length")) == F.col("_rule"))
    rank = F.struct(F.col("_kept._order").alias("o"), (-F.col("_length")).alias("l")) if order else -F.col("_length")
    best = hits.groupBy("_key").agg(F.min_by("_kept", rank).alias("_kept"))
    found = lookup(df, best, [(key, "_key")], scatter=[key])
    return found.select(*df.columns, *[F.col(f"_kept._v{i}").alias(v) for i, v in enumerate(values)])


def disposition_by_tables(settings: DataFrame, key: str, value: str, *, defaults: DataFrame, new_defaults: DataFrame, exact: DataFrame,
                          prefixes: DataFrame, always_carried: DataFrame, name: str = "disposition") -> DataFrame:
    """What happens to each setting, as ``transforms.key_disposition`` decides it, with every rule in a table.

    ``defaults`` and ``new_defaults`` have name and value, ``exact`` has name and disposition,
    ``prefixes`` has prefix, disposition and rule_no (the first matching rule counts),
    ``always_carried`` has prefix.
    """
    marked = always_carried.select("prefix").withColumn("_carried", F.lit(True))
    out = prefix_join(settings, key, marked, ["_carried"])
    out = prefix_join(out, key, prefixes.select("prefix", "rule_no", F.col("disposition").alias("_prefixed")), ["_prefixed"], order="rule_no")
    for table, column, as_ in ((defaults, "value", "_default"), (new_defaults, "value", "_new"), (exact, "disposition", "_exact")):
        one = table.groupBy(F.col("name").alias("_name")).agg(F.min(column).alias(as_))
        out = lookup(out, one, [(key, "_name")], scatter=[key])
    untouched = F.coalesce(F.col("_default") == F.col(value), F.lit(False)) & F.col("_carried").isNull()
    decided = (F.when(untouched, F.when(F.col("_new").isNotNull(), "new-default").otherwise("skipped"))
               .otherwise(F.coalesce("_exact", "_prefixed", F.lit("unknown"))))
    return out.select(*settings.columns, decided.alias(name))
