"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.llm.certified_rules import quality_rules
from carryover.llm.decontamination import contamination
from carryover.llm.divergence import source_divergence
from carryover.llm.exact_dedup import exact_dedup
from carryover.llm.html_extraction import extract_text
from carryover.llm.importance import importance_sample
from carryover.llm.jaccard_join import jaccard_join
from carryover.llm.kneser_ney import kneser_ney_scores
from carryover.llm.language_id import fold, language_id
from carryover.llm.license_scan import license_scan
from carryover.llm.mixing import mix_sources, word_count
from carryover.llm.quality import quality_scores
from carryover.llm.token_counts import token_counts
from carryover.session import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf: fn(reachable(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_token_counts")
def _(spark, sf):
    return token_counts(table(spark, sf, "documents"), tokenizer="word_bpe_49k.json", limit=2048)


@query("op2_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
        sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def _(spark, sf):
    return exact_dedup(table(spark, sf, "documents"))


@query("op3_jaccard_join")
def _(spark, sf):
    return jaccard_join(table(spark, sf, "documents"), shingle=4, percent=85)


@query("op4_source_mixing")
def _(spark, sf):
    return mix_sources(table(spark, sf, "documents"), word_count(F.col("text")), weights=(5, 2, 1), limit=3.0)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op8_decontamination", f"""
    WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents), b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
           FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(i) WHERE len(w) > 0),
    lengths AS (SELECT DISTINCT l FROM bw),
    dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT * FROM d, lengths), unnest(range(1, len(w) - l + 2)) t(i)),
    occ AS (SELECT DISTINCT doc_id, i, l, item_id FROM dw JOIN bw USING (l, win)),
    hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM occ, unnest(range(0, l)) t(j) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def _(spark, sf):
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op10_language_id")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return language_id(docs, docs.where(fold("doc_id", 5) != 0), held_out=fold("doc_id", 5) == 0)


@query("op9_lm_scoring")
def _(spark, sf):
    return kneser_ney_scores(table(spark, sf, "documents"), held_out=fold("doc_id", 7) == 2, order=3)


@query("op7_html_extraction")
def _(spark, sf):
    return extract_text(table(spark, sf, "pages"))


@query("op5_license_scans")
def _(spark, sf):
    return license_scan(table(spark, sf, "documents"))


@query("op6_quality_classifier")
def _(spark, sf):
    # documents carry no url: source stands for the host, lang for the path
    found = quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"), ["quality", "toxic"], F.col("source"), F.col("lang"))
    return found.withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5))


_LETTERS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op11_source_divergence", f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        {_LETTERS} AS w FROM documents),
    t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    l AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
    lv AS (SELECT lang, count(term) AS v, CAST(coalesce(sum(n), 0) AS BIGINT) AS ln FROM (SELECT DISTINCT lang FROM d) LEFT JOIN l USING (lang) GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN l USING (lang, term) GROUP BY ALL),
    g AS (SELECT lang, source, v, CAST(coalesce(sum(n), 0) AS BIGINT) AS gn FROM (SELECT DISTINCT lang, source FROM d) JOIN lv USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
    s AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn + 5 * v) AS BIGINT) AS p
          FROM g JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
    q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (ln + 5 * v) AS BIGINT) AS q FROM l JOIN lv USING (lang)),
    f AS (SELECT lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""")
def _(spark, sf):
    return source_divergence(table(spark, sf, "documents"))


@query("op12_importance_resampling", f"""
    WITH steps AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) ORDER BY b) AS t
                   FROM range(256) x(b)),
    d AS (SELECT doc_id, {_SPLIT} AS w FROM documents), b AS (SELECT {_SPLIT} AS w FROM benchmark),
    dw AS (SELECT doc_id, unnest(w) AS f FROM d), bw AS (SELECT unnest(w) AS f FROM b),
    named AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, [CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT) for i in range(octet_length(encode(f)))]),
        lambda r, c: xor(r >> 8, t[1 + xor(r & 255, c)]))) % 10000 AS bucket
        FROM (SELECT f FROM dw UNION SELECT f FROM bw), steps),
    raw AS (SELECT bucket, count(*) AS s FROM dw JOIN named USING (f) GROUP BY bucket),
    goal AS (SELECT bucket, count(*) AS t FROM bw JOIN named USING (f) GROUP BY bucket),
    gains AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE)
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE))) AS BIGINT) AS gain
        FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN raw USING (bucket) LEFT JOIN goal USING (bucket)),
    weights AS (SELECT doc_id, sum(gain) AS weight FROM dw JOIN named USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
    scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
        FROM d LEFT JOIN weights USING (doc_id)),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
    SELECT scored.*, CASE WHEN place <= 10 * able // 100 THEN place END AS rank, n_features AS n_words FROM scored LEFT JOIN ranked USING (doc_id)""")
def _(spark, sf):
    return importance_sample(table(spark, sf, "documents"), table(spark, sf, "benchmark"), longest=1, buckets=10_000, seed=2024, least_words=20, percent=10)


@query("op13_quality_rules")
def _(spark, sf):
    return quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))
