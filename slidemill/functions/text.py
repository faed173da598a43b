"""Text of slides: escaping, list numbers, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import js_number

#: Roman numerals and what they stand for.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def escape_attribute(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def run_html(text: Column) -> Column:
    """A run's text as HTML: of each two blanks the second does not break, unless there is a tab."""
    shown = escape(F.coalesce(text, F.lit("")))
    return F.when(F.contains(text, F.lit("\t")), shown).otherwise(F.replace(shown, F.lit("  "), F.lit("  ")))


def roman(n: Column) -> Column:
    """Classic numerals: each sign as often as it fits into what the greater ones leave."""
    signs = F.array(*(F.struct(F.lit(v).cast("long").alias("v"), F.lit(s).alias("s")) for v, s in ROMAN))
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    step = lambda a, x: F.struct((a["left"] % x["v"]).alias("left"), F.concat(a["out"], F.repeat(x["s"], (a["left"] / x["v"]).cast("int"))).alias("out"))
    return F.aggregate(signs, start, step, lambda a: a["out"])


def auto_number(kind: Column, index: Column) -> Column:
    """The label of a numbered paragraph, the first one having index 0."""
    n = (index + 1).cast("long")
    letter = lambda base: F.char(F.lit(base) + F.pmod(n - 1, F.lit(26)))
    plain = n.cast("string")
    return (
        F.when(kind == "arabicParenR", F.concat(plain, F.lit(")")))
        .when(kind == "arabicParenBoth", F.concat(F.lit("("), plain, F.lit(")")))
        .when(kind == "arabicPlain", plain)
        .when(kind == "romanUcPeriod", F.concat(roman(n), F.lit(".")))
        .when(kind == "romanLcPeriod", F.concat(F.lower(roman(n)), F.lit(".")))
        .when(kind == "alphaUcPeriod", F.concat(letter(65), F.lit(".")))
        .when(kind == "alphaLcPeriod", F.concat(letter(97), F.lit(".")))
        .when(kind == "alphaUcParenR", F.concat(letter(65), F.lit(")")))
        .when(kind == "alphaLcParenR", F.concat(letter(97), F.lit(")")))
        .otherwise(F.concat(plain, F.lit(".")))
    )


#: Dashes and gaps of line kinds, in line widths.
DASHES = {
    "dot": (1, 2), "sysDot": (1, 2), "dash": (4, 2), "sysDash": (4, 2), "lgDash": (8, 3), "dashDot": (4, 2, 1, 2), "sysDashDot": (4, 2, 1, 2),
    "lgDashDot": (8, 3, 1, 3), "lgDashDotDot": (8, 3, 1, 2, 1, 2), "sysDashDotDot": (8, 3, 1, 2, 1, 2),
}


def dash_array(kind: Column, width: Column) -> Column:
    """Dashes of a line at least 1 wide; nothing for solid ones."""
    w = F.greatest(width.cast("double"), F.lit(1.0))
    out = F.lit("")
    for name, lengths in DASHES.items():
        out = F.when(kind == name, F.concat_ws(",", *(js_number(w * k) for k in lengths))).otherwise(out)
    return out


def border_type(kind: Column) -> Column:
    return F.when(kind.isin("dot", "sysDot"), "dotted").when(kind.isin(*DASHES), "dashed").otherwise("solid")


def safe_link(url: Column) -> Column:
    """Whether an address may be linked to: absolute, of the web or of mail."""
    return F.coalesce(F.lower(F.trim(url)).rlike(r"^(https?:/*[^/\s]|mailto:)"), F.lit(False))
