"""Expressions on rows of our own."""

import time

import pytest
from pyspark.sql import functions as F

from siltstone.functions import figures as G
from siltstone.functions import numbers as N
from siltstone.functions import text as T
from siltstone.operators import corpus as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_split_text_keeps_all_and_stays_small():
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(120)) for i in range(5))
    chunks = C.split_text(text)
    assert all(0 < len(c) <= 512 for c in chunks)
    assert {w for c in chunks for w in c.split()} == set(text.split())
    assert C.split_text("") == C.split_text("  \n ") == C.split_text(None) == []
    assert C.split_text("a" * 1000)[0] == "a" * 512


def test_split_text_takes_time_in_proportion():
    began = time.process_time()
    chunks = C.split_text("x " * 40_000, size=60_000, overlap=20_000)
    assert time.process_time() - began < 2  # some 20 seconds where what is held was summed for each piece
    assert [len(c) for c in chunks] == [59_999, 40_000 - 1] and set("".join(chunks)) == {"x", " "}


def test_html_text_skips_scripts():
    assert C.html_text("<p>a &amp; b</p><script>x('</p>')</script><style>y</style><p>c") == "a & b\nc"
    assert C.html_text(None) is None


def test_classes(spark):
    cases = [("short", "short fragment"), ("x" * 130 + "<td>", "escaped markup"), ('"instance": ' + "y " * 80, "json / metadata"), ("us-gaap:Abc " * 20, "identifiers"), ("12,345 " * 30, "numeric table"), ("some plain words " * 10, "prose"), (None, "short fragment")]
    rows = spark.createDataFrame(cases, "text string, want string").select("want", T.classify(F.col("text")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_chunk_ids(spark):
    cid = T.chunk_id(F.lit("aapl"), F.lit(395))
    assert one(spark, cid) == "AAPL_10K_chunk_395"
    assert one(spark, T.parse_chunk_id(cid)["chunk_idx"]) == 395
    assert one(spark, T.parse_chunk_id(F.lit("nope"))) is None


@pytest.mark.parametrize(
    ("text", "raws"),
    [
        ("$26.4 billion and 14%", ["$26.4 billion", "14%"]),
        ("On September 27, 2025", ["2025"]),
        ("the 10-K, Item 7A, Form 8-K and note 3", []),
        ("1,234,567.8 shares, 5 percent", ["1,234,567.8", "5 percent"]),
        (None, []),
    ],
)
def test_figures(text, raws):
    assert [f["raw"] for f in G.figures_of(text)] == raws


def test_matching_is_not_symmetric(spark):
    rows = spark.createDataFrame([("$26.4 billion", "$26,448 million"), ("2024", "2025"), ("14%", "14")], "a string, b string")
    f = lambda c: F.get(G.extract(F.col(c)), F.lit(0))
    got = rows.select(G.matches(f("a"), f("b")).alias("ab"), G.matches(f("b"), f("a")).alias("ba")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False)]


def test_nearest_rank_rounds_half_even(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double").withColumn("g", F.lit(1))
    assert N.percentiles(rows, ["g"], "v", {"p": ("nearest", 50)}).first().p == 3.0
    assert N.percentiles(rows.where("v > 9"), ["g"], "v", {"p": ("nearest", 50)}).count() == 0


def test_classes_by_plain_rules(spark):
    import re

    long, prose = "x" * 31, "A line of words goes on and on. " * 5
    texts = [None, "", " \n\t", prose, f"\n {prose}", prose + "<TD", prose + "&LT;", prose + 'STYLE="', prose + "style=x", prose + "metaLINKS", prose + "x.XSD", prose + '"report" :', prose + '"quoted"', prose + "_CAL.xml", prose + "a.xml"]
    texts += [prose + " ".join([long] * n) for n in (2, 3)] + [prose + " ".join(["us-gaap:Revenues"] * n) for n in (2, 3)] + [prose + "a: b_c", "12 34,5 " * 30, "1é" * 80, "x" * 119, "x" * 120, prose + "C_0123abcd dei_X iso4217:U", prose + "HTTP://XBRL.x " * 3]

    def plain(text):
        bare = re.sub(r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", text or "")
        if len(bare) < T.SHORT_CHARS:
            return "short fragment"
        if re.search(T.MARKUP, bare):
            return "escaped markup"
        if re.search(T.JSON_LIKE, bare):
            return "json / metadata"
        if len(re.findall(T.IDENTIFIER, bare)) >= 3 or sum(len(w) > 30 for w in bare.split()) > 2:
            return "identifiers"
        return "numeric table" if sum(c.isalpha() for c in bare) / len(bare) < 0.4 else "prose"

    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", T.classify(F.col("text")).alias("c")).collect()
    assert {r.n: r.c for r in rows} == {n: plain(t) for n, t in enumerate(texts)}
