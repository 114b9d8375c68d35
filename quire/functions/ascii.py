"""Transliteration to ASCII for displays without Unicode fonts."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

from quire.functions.lazy import arrow_udf

#: Texts that stand for single characters outside the ranges below.
SPECIAL = {
    0xA0: " ", 0xA9: "(c)", 0xAE: "(r)", 0xB0: " deg", 0xB1: "+-", 0xB2: "2", 0xB3: "3", 0xB5: "mu", 0xB7: ".", 0xB9: "1",
    0xBC: "1/4", 0xBD: "1/2", 0xBE: "3/4", 0xC6: "AE", 0xD0: "D", 0xD7: "x", 0xD8: "O", 0xDE: "Th", 0xDF: "ss",
    0xE6: "ae", 0xF0: "d", 0xF7: "/", 0xF8: "o", 0xFE: "th",
    0x110: "D", 0x111: "d", 0x126: "H", 0x127: "h", 0x131: "i", 0x132: "IJ", 0x133: "ij", 0x138: "k", 0x13F: "L", 0x140: "l",
    0x141: "L", 0x142: "l", 0x149: "n", 0x14A: "N", 0x14B: "n", 0x152: "OE", 0x153: "oe", 0x166: "T", 0x167: "t",
    0x2013: "-", 0x2014: "-", 0x2018: "'", 0x2019: "'", 0x201A: ",", 0x201C: '"', 0x201D: '"', 0x2020: "*", 0x2021: "**",
    0x2022: "*", 0x2026: "...", 0x2032: "'", 0x2033: "''", 0x2122: "(tm)", 0x2190: "<-", 0x2192: "->", 0x2194: "<->",
    0x2212: "-", 0x2215: "/", 0x221A: "sqrt", 0x221E: "inf", 0x2260: "!=", 0x2264: "<=", 0x2265: ">=",
    0x200B: "", 0x200C: "", 0x200D: "", 0xFEFF: "", 0xAD: "",
}
#: Names of the Greek letters from alpha on.
GREEK = (
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma sigma tau upsilon phi chi psi omega"
).split()


@lru_cache(1)
def table() -> dict[str, str]:
    """Replacement of each character that has one; letters with marks give their base letter."""
    out = {}
    for cp in [*range(0xC0, 0x17F)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base.isascii():
            out[chr(cp)] = base
    for k, name in enumerate(GREEK):
        out[chr(0x3B1 + k)] = name
        if k != 17:  # no capital final sigma
            out[chr(0x391 + k)] = name.capitalize()
    return out | {chr(cp): t for cp, t in SPECIAL.items()}


class _Lookup(dict):
    """Replacements by code point, for str.translate; those not in the table are learnt as they come."""

    def __missing__(self, cp: int) -> str:
        self[cp] = out = chr(cp) if cp < 0x80 else table().get(chr(cp), "?")
        return out


@arrow_udf("string")
def _translated(text: pd.Series) -> pd.Series:
    lookup = _Lookup()
    return pd.Series([None if t is None else t.translate(lookup) for t in text], dtype=object)


def to_ascii(text: Column | str) -> Column:
    """ASCII stays, known characters become their replacement, others "?". One lookup for each character; texts that are ASCII already do
    not leave the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_translated(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)
