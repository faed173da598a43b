"""Signs of symbol fonts as characters of Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of symbol fonts by their codes.
SYMBOLS = {
    "wingdings": {
        0x66: "●", 0x67: "●", 0x6C: "●", 0x6D: "○", 0x6E: "■", 0x6F: "□", 0x71: "✕", 0x72: "✓", 0x73: "☐", 0x74: "⬥", 0x75: "◆", 0x76: "❖", 0x77: "⬜",
        0x9C: "●", 0x9D: "○", 0x9E: "■", 0x9F: "□", 0xA1: "✡", 0xA7: "✺", 0xA8: "✶", 0xAA: "⇦", 0xAB: "⇨", 0xAC: "⇧", 0xAD: "⇩", 0xD5: "✉", 0xD6: "☛",
        0xD7: "☞", 0xD8: "✌", 0xE0: "→", 0xE1: "←", 0xE2: "↑", 0xE3: "↓", 0xE4: "↔", 0xE5: "↕", 0xE6: "⇒", 0xE7: "⇐", 0xE8: "⇑", 0xE9: "⇓", 0xEA: "⇔",
        0xEB: "⇕", 0xEF: "➔", 0xFB: "⚫", 0xFC: "●",
    },
    "wingdings 2": {
        0x62: "①", 0x63: "②", 0x64: "③", 0x65: "④", 0x66: "⑤", 0x67: "⑥", 0x68: "⑦", 0x69: "⑧", 0x6A: "⑨", 0x6B: "⑩", 0x98: "⬥", 0x99: "◇", 0x9E: "◉",
        0x9F: "⊙", 0xA3: "✦", 0xF0: "●", 0xF1: "○", 0xF2: "◉", 0xF3: "◎",
    },
    "wingdings 3": {0x75: "►", 0x76: "◄", 0x77: "▸", 0x78: "◂", 0x7B: "▲", 0x7C: "▼", 0x7D: "▶", 0x7E: "◀"},
    "symbol": {0xA3: "≤", 0xA9: "©", 0xAE: "®", 0xB3: "≥", 0xB7: "•", 0xC6: "…", 0xD8: "≠"},
}


def is_symbol_font(font: Column) -> Column:
    return F.coalesce(F.lower(font).isin(*SYMBOLS), F.lit(False))


def symbol(sign: Column, font: Column) -> Column:
    """The character that a symbol font shows for a sign, codes of the private area taken as their last byte; a bullet for unknown ones."""
    code = F.when(F.ascii(sign).between(0xF000, 0xF0FF), F.ascii(sign) - 0xF000).otherwise(F.ascii(sign))
    key = F.concat(F.lower(font), F.lit(":"), code.cast("string"))
    known = F.create_map(*(F.lit(x) for name, signs in SYMBOLS.items() for c, s in signs.items() for x in (f"{name}:{c}", s)))
    return F.coalesce(F.try_element_at(known, key), F.lit("•"))
