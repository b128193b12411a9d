"""Security log records in a form that is safe to read aloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = """transaction struct<request: struct<uri: string>,
  messages: array<struct<message: string, details: struct<ruleId: string, match: string>>>>"""
# Fixed value: what replaces a matched value.
REDACTED = "(value redacted)"


def triage(lines: DataFrame, line: str = "value", *, match_chars: int | None = None) -> DataFrame:
    """(rule_id, match, uri, message): one row per message of each well-formed line.

    Malformed lines are dropped, the query string is cut off the URI and the matched
    value is redacted. ``match_chars`` shortens what is shown of a match, for a terminal.
    Stateless, so the same function serves a stream.
    """
    keep = [c for c in lines.columns if c != line]
    parsed = lines.select(*keep, F.from_json(line, RECORD, {"mode": "PERMISSIVE"}).alias("_r"))
    each = parsed.where(F.col("_r.transaction").isNotNull()).select(
        *keep, F.col("_r.transaction.request.uri").alias("_uri"), F.explode("_r.transaction.messages").alias("_m"))
    match = F.regexp_replace(F.coalesce("_m.details.match", F.lit("")), r"\(Value: .*$", REDACTED)
    if match_chars is not None:
        match = F.substring(match, 1, match_chars)
    uri = F.substring_index(F.coalesce("_uri", F.lit("")), "?", 1)
    return each.select(*keep, F.coalesce("_m.details.ruleId", F.lit("?")).alias("rule_id"),
                       match.alias("match"), uri.alias("uri"),
                       F.coalesce("_m.message", F.lit("")).alias("message"))


def last_lines(lines: DataFrame, order: str, n: int = 200) -> DataFrame:
    """The last ``n`` lines by position; the limit is the feature."""
    if n < 1:
        raise ValueError("the line count must be positive")
    return lines.orderBy(F.desc(order)).limit(n)
