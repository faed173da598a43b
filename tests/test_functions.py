"""Scalar functions against known values."""

import pytest
from pyspark.sql import functions as F

from slidemill.functions import colors, outlines, text, units
from slidemill.operators import package


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "made, want",
    [
        (lambda: units.emu_to_px(F.lit(914400)), 96.0), (lambda: units.emu_to_pt(F.lit(12700)), 1.0), (lambda: units.angle_to_deg(F.lit(5400000)), 90.0), (lambda: units.pct_to_decimal(F.lit(50000)), 0.5),
        (lambda: units.hundredth_pt_to_pt(F.lit(1800)), 18.0), (lambda: units.pt_to_px(F.lit(72)), 96.0), (lambda: units.px_to_pt(F.lit(96.0)), 72.0), (lambda: units.js_round(F.lit(2.5)), 3), (lambda: units.js_round(F.lit(-2.5)), -2),
        (lambda: units.js_number(F.lit(72.0)), "72"), (lambda: units.js_number(F.lit(0.5)), "0.5"), (lambda: units.js_number(F.lit(100.25)), "100.25"), (lambda: units.js_number(F.lit(0.0)), "0"), (lambda: units.js_number(F.lit(10.0)), "10"),
    ],
)
def test_units(spark, made, want):
    assert value(spark, made()) == want


def test_smart_lengths(spark):
    assert value(spark, units.smart_to_px(F.lit(20000.0))) == pytest.approx(26666.6667) and value(spark, units.smart_to_px(F.lit(20001.0))) == pytest.approx(2.0999, abs=1e-3)


@pytest.mark.parametrize(
    "mods, want",
    [
        ([("shade", 50000)], "#2f528f"), ([("tint", 50000)], "#c0c9e4"), ([("lumMod", 50000)], "#203864"), ([("lumMod", 75000)], "#2f5597"), ([("lumMod", 40000), ("lumOff", 60000)], "#b4c6e7"),
        ([], "4472C4"), ([("none", 1)], "4472C4"), ([("hueMod", 100000)], "#4472c4"), ([("satMod", 0)], "#848484"),
    ],
)
def test_color_modifiers(spark, mods, want):
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("val")) for n, v in mods)) if mods else F.array().cast("array<struct<name:string,val:double>>")
    got = value(spark, colors.modified(F.lit("4472C4"), each))
    assert got["hex"] == want and got["alpha"] == 1


def test_alpha(spark):
    mods = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("val")) for n, v in (("alpha", 40000.0), ("alphaOff", 10000.0))))
    assert value(spark, colors.css(colors.modified(F.lit("4472C4"), mods))) == "rgba(68,114,196,0.500)"
    assert value(spark, colors.on_white(F.struct(F.lit("000000").alias("hex"), F.lit(0.5).alias("alpha")))) == "#808080"
    assert value(spark, colors.to_hex(colors.channels(F.lit("#abc")))) == "#aabbcc" and value(spark, colors.to_hex(colors.channels(F.lit("nonsense")))) == "#000000"


@pytest.mark.parametrize("kind, index, want", [("romanUcPeriod", 3, "IV."), ("alphaLcParenR", 26, "a)"), ("arabicParenBoth", 0, "(1)"), ("romanLcPeriod", 1993, "mcmxciv."), ("other", 4, "5."), ("alphaUcPeriod", 1, "B.")])
def test_auto_number(spark, kind, index, want):
    assert value(spark, text.auto_number(F.lit(kind), F.lit(index))) == want


def test_text(spark):
    assert value(spark, text.escape(F.lit('a<b & "c"'))) == "a&lt;b &amp; &quot;c&quot;"
    assert value(spark, text.run_html(F.lit("a  b   c"))) == "a \u00a0b \u00a0 c" and value(spark, text.run_html(F.lit("a  b\t"))) == "a  b\t"
    assert value(spark, text.dash_array(F.lit("lgDash"), F.lit(0.5))) == "8,3" and value(spark, text.border_type(F.lit("sysDot"))) == "dotted"
    for url, safe in (("https://a", True), ("mailto:a@b", True), ("javascript:x", False), ("/rel", False), (None, False)):
        assert value(spark, text.safe_link(F.lit(url).cast("string"))) is safe


@pytest.mark.parametrize(
    "base, target, want", [("ppt/slides", "../slideLayouts/slideLayout1.xml", "ppt/slideLayouts/slideLayout1.xml"), ("ppt/slides", "/ppt/media/a.png", "ppt/media/a.png"), ("ppt", "./x//y", "ppt/x/y"), ("ppt", "../../a", "a")]
)
def test_targets(spark, base, target, want):
    assert value(spark, package.resolve_target(F.lit(base), F.lit(target))) == want
    assert value(spark, package.media_path(F.lit("../media/image1.png"))) == "ppt/media/image1.png"
    assert value(spark, package.rels_path(F.lit("ppt/slides/slide1.xml"))) == "ppt/slides/_rels/slide1.xml.rels"


@pytest.mark.parametrize(
    "name, want",
    [
        ("rect", "M0,0 L72,0 L72,36 L0,36 Z"), ("textNoShape", ""), ("unknown", "M0,0 L72,0 L72,36 L0,36 Z"), ("diamond", "M36,0 L72,18 L36,36 L0,18 Z"), ("triangle", "M36,0 L72,36 L0,36 Z"),
        ("ellipse", "M72,18 A36,18 0 1,1 0,18 A36,18 0 1,1 72,18 Z"),
    ],
)
def test_preset_paths(spark, name, want):
    assert value(spark, outlines.preset_path(F.lit(name), F.lit(72.0), F.lit(36.0))) == want
