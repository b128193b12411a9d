from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from carryover.functions import charset as C


def misread(text: str) -> str:
    return "".join(chr(b) if b in C.CP1252_UNDEFINED else bytes([b]).decode("cp1252") for b in text.encode())


CASES = [  # stored, double-encoded, kept after validation
    ("é", False, "é"), (misread("é"), True, "é"), (misread("Í"), True, "Í"), (misread("a – b"), True, "a – b"),
    (misread(misread("é")), True, misread(misread("é"))), ("é " + misread("é"), False, "é " + misread("é")),
    ("日本", False, "日本"), ("\u0080", False, "\u0080"), ("1,800", False, "1,800"), ("", False, ""), (None, False, None),
]


@pytest.mark.parametrize("codegen", ["true", "false"])
def test_literals(spark, codegen):
    spark.conf.set("spark.sql.codegen.wholeStage", codegen)
    try:
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, v string")
        got = df.select("i", C.is_double_encoded(F.col("v")).alias("d"), C.validated_repair(F.col("v")).alias("r")).orderBy("i")
        assert [(r.d, r.r) for r in got.collect()] == [(d, r) for _, d, r in CASES]
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "true")


def test_repair_round_trip_of_every_latin_letter(spark):
    letters = [chr(p) for p in range(0xC0, 0x100)] + list("–—‘’“”…€™")
    df = spark.createDataFrame([(c, misread("x" + c)) for c in letters], "c string, v string")
    assert df.where(C.repair(F.col("v")) != F.concat(F.lit("x"), "c")).count() == 0


def test_partial_lane(spark):
    # one step back is lossless but leaves a marker that is not itself double-encoded
    text = misread("é " + misread("é"))
    df = spark.createDataFrame([(text,)], "body string")
    lanes = {r.lane: r.rows for r in C.charset_census(df, ["body"], "t").collect()}
    assert lanes == {"repairable": 0, "multi": 0, "partial": 1, "bad": 0}


def test_exact_spans(spark):
    df = spark.createDataFrame([("a â\u0080\u0093 b",), ("x â\u0089¤ y é",), ("â\u0080\u0093 and â\u0085",), ("plain",), (None,)], "v string")
    got = [r[0] for r in df.select(C.exact_span_repair(F.col("v"))).collect()]
    assert got == ["a – b", "x ≤ y é", "â\u0080\u0093 and â\u0085", "plain", None]


def test_character_references(spark):
    """Every name and every kind of number, whole, cut off and run together, as the standard library reads them."""
    import random
    from html import unescape
    from html.entities import html5

    from carryover.functions.text import decoded_references

    draw = random.Random(3)
    texts = ["", "&", "&&", "a&b", "&;", "&#;", "&#x;", "&#xZ;", "&#0;", "&#13;", "&#x80;&#129;&#159", "&#xD800;&#x110000;&#99999999999999999999;", "&#65 &#x41x", "&notit; &notin; &amp;amp;",
             "&eacute", "&eacuteX;", "&Eacute;&amp", "&#11;&#1;&#127;&#xfdd0;&#xffff;&#x1fffe;&#128512;", "&\u00e9;", "x" * 40 + "&" + "a" * 40 + ";", "&#00065;&#x000041;", "&gt&lt;&quot&#39;"]
    texts += [f"&{n}" for n in html5] + [f"<&{n}z>" for n in html5 if not n.endswith(";")]
    texts += [f"&#{n};" for n in range(0, 300)] + [f"&#x{n:X}" for n in (0x7FF, 0x800, 0xFFFD, 0xFFFE, 0x10000, 0x10FFFF)]
    texts += ["".join(draw.choice(["&", "#", "x", "6", "5", ";", "amp", "not", "in", " ", "lt", "é"]) for _ in range(draw.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", decoded_references(F.col("t")).alias("d")).collect()}
    bad = [(t, got[i], unescape(t)) for i, t in enumerate(texts) if got[i] != unescape(t)]
    assert not bad, bad[:10]
    assert got[-1] is None


def test_no_python_in_the_plan(spark):
    from carryover.operators.reconcile import html_asset_refs

    pages = spark.createDataFrame([(1, '<img src="${t}a&eacute;.png">')], "i int, h string")
    refs = html_asset_refs(pages, "i", "h", "${t}")
    assert [r.ref for r in refs.collect()] == ["aé.png"]
    assert "Python" not in refs._jdf.queryExecution().executedPlan().toString()
