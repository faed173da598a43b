"""Colours as columns: hexadecimal strings, and the modifiers of drawing markup, folded in document order.

Nothing leaves the JVM: a value that is used more than once is bound by ``let``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import js_round


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def channels(hex: Column) -> Column:
    """A struct r, g, b (doubles, 0 to 255) of a colour of 3 or 6 digits, with or without #; black if it is neither."""
    digits = F.regexp_replace(hex, "^#", "")
    six = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    good = F.when(six.rlike("^[0-9a-fA-F]{6}$"), six).otherwise("000000")
    part = lambda i: F.conv(F.substring(good, i, 2), 16, 10).cast("double")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def to_hex(rgb: Column) -> Column:
    two = lambda c: F.lpad(F.lower(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), js_round(rgb[c]))).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), two("r"), two("g"), two("b"))


def to_linear(c: Column) -> Column:
    s = c / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def from_linear(c: Column) -> Column:
    s = F.when(c <= 0.0031308, c * 12.92).otherwise(F.lit(1.055) * F.pow(c, F.lit(1 / 2.4)) - 0.055)
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), js_round(s * 255).cast("double")))


def _each(rgb: Column, f: Callable[[Column], Column]) -> Column:
    return F.struct(*(f(rgb[c]).alias(c) for c in "rgb"))


def tint(rgb: Column, share: Column) -> Column:
    """Towards white, in linear light; a share of 1 changes nothing."""
    return _each(rgb, lambda c: from_linear(to_linear(c) * share + (F.lit(1.0) - share)))


def shade(rgb: Column, share: Column) -> Column:
    """Towards black, in linear light."""
    return _each(rgb, lambda c: from_linear(to_linear(c) * share))


def hsl(rgb: Column) -> Column:
    """A struct h (degrees), s, l."""

    def made(x: Column) -> Column:
        r, g, b = x["r"] / 255.0, x["g"] / 255.0, x["b"] / 255.0
        most, least = F.greatest(r, g, b), F.least(r, g, b)
        d = most - least
        light = (most + least) / 2.0
        sat = F.when(d == 0, 0.0).when(light > 0.5, d / (F.lit(2.0) - most - least)).otherwise(d / (most + least))
        sixth = F.when(most == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(most == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0)
        return F.struct(F.when(d == 0, 0.0).otherwise(sixth * 60.0).alias("h"), sat.alias("s"), light.alias("l"))

    return let(rgb, made)


def from_hsl(colour: Column) -> Column:
    """Channels of a struct h, s, l; hue is taken round, the others are cut to 0 .. 1."""

    def made(x: Column) -> Column:
        s, light = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), x[c])) for c in "sl")
        q = F.when(light < 0.5, light * (F.lit(1.0) + s)).otherwise(light + s - light * s)
        return F.struct((F.pmod(x["h"], F.lit(360.0)) / 360.0).alias("h"), s.alias("s"), light.alias("l"), q.alias("q"))

    def channel(x: Column, shift: float) -> Column:
        p = x["l"] * 2.0 - x["q"]
        t = F.pmod(x["h"] + shift, F.lit(1.0))
        ramp = F.when(t < 1 / 6, p + (x["q"] - p) * 6.0 * t).when(t < 0.5, x["q"]).when(t < 2 / 3, p + (x["q"] - p) * (F.lit(2 / 3) - t) * 6.0).otherwise(p)
        return js_round(F.when(x["s"] == 0, x["l"]).otherwise(ramp) * 255.0).cast("double")

    return let(made(colour), lambda x: F.struct(channel(x, 1 / 3).alias("r"), channel(x, 0.0).alias("g"), channel(x, -1 / 3).alias("b")))


def modified(hex: Column, mods: Column) -> Column:
    """A struct hex, alpha: the colour after modifiers, an array of (name, val), in their order; unknown names change nothing.

    Without a change of colour the string stays as it was given.
    """
    clear = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))

    def turned(x: Column, m: Column, val: Column) -> Column:
        """Channels after a modifier of hue, saturation or lightness; x is a struct h, s, l."""
        name = m["name"]
        h = F.when(name == "hueMod", F.pmod(x["h"] * val, F.lit(360.0))).when(name == "hueOff", F.pmod(x["h"] + m["val"].cast("double") / 60000.0, F.lit(360.0))).otherwise(x["h"])
        part = lambda c, kind: F.when(name == f"{kind}Mod", clear(x[c] * val)).when(name == f"{kind}Off", clear(x[c] + val)).otherwise(x[c])
        return from_hsl(F.struct(h.alias("h"), part("s", "sat").alias("s"), part("l", "lum").alias("l")))

    def step(now: Column, m: Column) -> Column:
        name, val = m["name"], m["val"].cast("double") / 100000.0
        in_light = let(channels(now["hex"]), lambda rgb: F.when(name == "tint", to_hex(tint(rgb, val))).otherwise(to_hex(shade(rgb, val))))
        in_hsl = let(let(hsl(channels(now["hex"])), lambda x: turned(x, m, val)), to_hex)
        new = F.when(name.isin("tint", "shade"), in_light).when(name.isin("lumMod", "lumOff", "satMod", "satOff", "hueMod", "hueOff"), in_hsl).otherwise(now["hex"])
        alpha = F.when(name == "alpha", clear(val)).when(name == "alphaOff", clear(now["alpha"] + val)).otherwise(now["alpha"])
        return F.struct(new.alias("hex"), alpha.alias("alpha"))

    return F.aggregate(mods, F.struct(hex.alias("hex"), F.lit(1.0).alias("alpha")), step)


def css(colour: Column) -> Column:
    """#hex, or rgba() where the colour of a struct hex, alpha lets something through."""

    def made(x: Column) -> Column:
        opaque = F.when(x["hex"].startswith("#"), x["hex"]).otherwise(F.concat(F.lit("#"), x["hex"]))
        clear = let(channels(x["hex"]), lambda c: F.format_string("rgba(%d,%d,%d,%.3f)", c["r"].cast("int"), c["g"].cast("int"), c["b"].cast("int"), x["alpha"]))
        return F.when(x["alpha"] >= 1, opaque).otherwise(clear)

    return let(colour, made)


def on_white(colour: Column) -> Column:
    """The colour of a struct hex, alpha laid on white."""
    laid = lambda x: let(channels(x["hex"]), lambda c: to_hex(_each(c, lambda v: v * x["alpha"] + (F.lit(1.0) - x["alpha"]) * 255.0)))
    return let(colour, laid)


def scheme(name: Column, override: Column, mapped: Column, theme: Column) -> Column:
    """The colour of a scheme's name: through the layout's override or the master's map to the theme's colours."""
    return theme[F.coalesce(override[name], mapped[name], name)]
