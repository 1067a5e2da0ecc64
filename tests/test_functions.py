"""Scalar functions against Python's own results."""

import math
import re

import pytest
from pyspark.sql import functions as F

from offerlens.functions import html, money, text


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(("given", "price"), [("$1,299.99", 1299.99), ("-5", 5.0), ("-5.25", -5.25), (".5", 0.5), ("12.", 12.0), ("+3.0 or 4", 3.0), ("v2 costs 19.99", 2.0), ("1.2.3", 1.2), ("5e3", 5.0), ("abc", 0.0), ("", 0.0)])
def test_f06_price(spark, given, price):
    assert column(spark, [given], "string", money.parse_price) == [price]


def test_f14_money(spark):
    xs = [0.125, 2.675, 1.005, 0.375, -0.125, -0.001, 1000000.125, 0.0, 99.995]
    assert column(spark, xs, "double", money.money) == [f"{x:.2f}" for x in xs]
    assert column(spark, xs, "double", money.thousands) == [f"{x:,.2f}" for x in xs]


def test_f12_buckets(spark):
    cases = [(39.99, 10.0, "green"), (40.0, 100.0, "orange"), (80.0, 100.0, "red"), (80.0, 201.0, "orange"), (100.0, 501.0, "green"), (10.0, 0.0, "green"), (50.0, 0.0, "orange"), (90.0, 0.0, "red")]
    rows = spark.createDataFrame(cases, "e double, t double, c string")
    assert rows.where(money.error_color(F.col("e"), F.col("t")) != F.col("c")).count() == 0


def test_f20_target(spark):
    got = column(spark, [0.0, 1.0, -1.0, -10.0, float("nan")], "double", money.from_target)
    for a, b in zip(got, [83.34689133440807, 235.93643891648043, 29.026610133556762, 0.0, 0.0]):
        assert math.isclose(a, b, rel_tol=1e-12, abs_tol=0)


def test_p05_ensemble(spark):
    assert spark.range(1).select(money.ensemble(F.lit(100.0), F.lit(200.0), F.lit(50.0))).first()[0] == 105.0


def test_f03_split(spark):
    given = ["aFeaturesbFeaturesc", "none", "", None, "xfeaturesy"]
    assert column(spark, given, "string", text.before_marker) == ["a", "none", "", None, "xfeaturesy"]
    assert column(spark, given, "string", text.behind_marker) == ["bFeaturesc", "", "", None, ""]


def test_f04_f13_cuts_count_code_points(spark):
    given = ["😀" * 41, "x" * 40, ""]
    assert column(spark, given, "string", text.ellipsis) == ["😀" * 40 + "...", "x" * 40, ""]


def test_f05_strip(spark):
    given = ["  a b\n\t", "　", "x"]
    assert column(spark, given, "string", text.strip) == [x.strip() for x in given]


def test_f07_to_f10_prompts(spark):
    row = spark.range(1).select(text.training_prompt(F.lit("thing"), F.lit(2.5)).alias("p")).select("p", text.test_prompt(F.col("p")).alias("t"), text.after_prefix(F.col("p")).alias("a")).first()
    assert row.p == "What does this cost to the nearest dollar?\n\nthing\n\nPrice is $2.00"
    assert row.t == "What does this cost to the nearest dollar?\n\nthing\n\nPrice is $"
    assert row.a == "2.00"
    assert column(spark, ["no number"], "string", text.after_prefix) == [None]


def test_f15_titles(spark):
    names = ["gpt_4__1_nano", "linear_regression", "it's_a_model", "", "a1b2__c", "éTÉ_ñandú", "漢a_字B", "GPTS__gpt"]
    assert column(spark, names, "string", text.display_title) == [n.replace("__", ".").replace("_", " ").title().replace("Gpt", "GPT") for n in names]


def test_f16_colors(spark):
    assert column(spark, ["\033[44m\033[37m[x] y\033[0m"], "string", text.ansi_to_html) == ['<span style="color: #ff7800">[x] y</span>']


def test_f18_f19_texts(spark):
    row = spark.range(1).select(money.alert_text(F.lit("A long description"), F.lit(1.0), F.lit(2.5), F.lit(1.5), F.lit("u")).alias("a"), money.notify_text(F.lit("m" * 300), F.lit("u")).alias("n")).first()
    assert row.a == "Deal Alert! Price=$1.00, Estimate=$2.50, Discount=$1.50 :A long des... u"
    assert row.n == "m" * 200 + "... u"


def test_j04_context_cuts_the_longer_array(spark):
    row = spark.range(1).select(money.context(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1.0))).alias("c")).first()
    assert row.c.endswith("Potentially related product:\na\nPrice is $1.00\n\n")
    assert "b\n" not in row.c.split("estimate.")[1]


def test_f01_snippet(spark):
    given = ['<p>x</p><div class="snippet summary"> <b>Big</b> &amp;lt;i&amp;gt;deal <p>now\nhere</p></div>', "plain\ntext <b>stays</b>", None, ""]
    assert column(spark, given, "string", html.snippet_text) == ["Big&lt;i&gt;dealnow here".replace("&lt;i&gt;", "<i>").replace("<i>", ""), "plain text <b>stays</b>", None, ""]


def test_f02_page(spark):
    given = ['<div class="a"><div class="content-section">One\nmore<div>two</div>\nthree</div>four</div>', "<p>no</p>", None]
    assert column(spark, given, "string", html.page_text) == ["Onetwo three", None, None]


def test_python_agrees_on_the_price_pattern():
    assert re.search(money.PRICE_PATTERN, "-5").group() == "5"


def test_references_without_a_semicolon():
    """Titles that were cut inside a reference keep it where only closed references are decoded."""
    from offerlens.functions.html import element_text

    page = "<article><h1>les&amp</h1> a &amp; b &copy; &#65; &#x42; &ampx; &no; A&B &</article>"
    assert element_text(page, "article", closed=True) == "les&amp a & b \u00a9 A B &ampx; &no; A&B &"
    assert element_text(page, "article").startswith("les& a & b")
    assert element_text("<p>none</p>", "article", closed=True) is None
