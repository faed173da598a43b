"""Units: all results are doubles; lengths of documents are points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: EMU to the inch and to the point.
INCH, POINT = 914400, 12700


def emu_to_px(emu: Column) -> Column:
    return emu / F.lit(float(INCH)) * F.lit(96.0)


def emu_to_pt(emu: Column) -> Column:
    return emu / F.lit(float(POINT))


def angle_to_deg(angle: Column) -> Column:
    return angle / F.lit(60000.0)


def pct_to_decimal(pct: Column) -> Column:
    return pct / F.lit(100000.0)


def hundredth_pt_to_pt(size: Column) -> Column:
    return size / F.lit(100.0)


def pt_to_px(pt: Column) -> Column:
    return pt * F.lit(96.0) / F.lit(72.0)


def px_to_pt(px: Column) -> Column:
    """Points, to four decimals."""
    return F.round(px * F.lit(0.75), 4)


def smart_to_px(value: Column) -> Column:
    """Values beyond 20000 are EMU, others points."""
    return F.when(F.abs(value) > 20000, emu_to_px(value)).otherwise(pt_to_px(value))


def js_round(x: Column) -> Column:
    """Half rounds up, as JavaScript has it."""
    return F.floor(x + F.lit(0.5))


def js_number(x: Column) -> Column:
    """A double as JavaScript writes it, of those from 1e-6 to 1e21: no exponent, no trailing .0; null stays null."""
    return F.when(x.isNotNull(), F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", ""))
