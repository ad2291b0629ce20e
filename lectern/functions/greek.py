"""Greek script: romanisation and Beta Code."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the romanisation.
LETTERS = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "ē", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "ph", "χ": "ch", "ψ": "ps", "ω": "ō", "ϝ": "w", "ϛ": "st", "ϙ": "q", "ϡ": "ss",
}
ROUGH, SMOOTH, ACUTE, GRAVE, CIRCUMFLEX, IOTA, DIAERESIS = "\u0314", "\u0313", "\u0301", "\u0300", "\u0342", "\u0345", "\u0308"
_M = "[\u0300-\u036f]*"
#: One sound: a diphthong (its second letter without diaeresis), double rho, gamma before a velar, any letter with its marks.
_SOUND = re.compile(
    rf"(?P<first>[αεουΑΕΟΥ])(?P<m1>{_M})(?P<iota>[ιΙ])(?P<m2>(?![\u0300-\u036f]*{DIAERESIS}){_M})"
    rf"|(?P<vowel>[αεηοωΑΕΗΟΩ])(?P<m3>{_M})(?P<ypsilon>[υΥ])(?P<m4>(?![\u0300-\u036f]*{DIAERESIS}){_M})"
    rf"|(?P<rho>[ρΡ][ρΡ](?=[\u0300-\u036f]*{ROUGH}){_M})|(?P<nasal>[γΓ]{_M}(?=[γκξχΓΚΞΧ]))|(?P<letter>.)(?P<marks>{_M})",
    re.DOTALL,
)


def _voiced(vowels: str, marks: str) -> str:
    if IOTA in marks:
        vowels += "i"
    if any(m in marks for m in (ACUTE, GRAVE, CIRCUMFLEX)):
        vowels += ACUTE
    return ("h" if ROUGH in marks else "") + vowels


def _sound(m: re.Match) -> str:
    if m["iota"]:
        marks, v = m["m1"] + m["m2"], m["first"].lower()
        out = _voiced(("u" if v == "υ" else LETTERS[v]) + "i", marks)
    elif m["ypsilon"]:
        out = _voiced(LETTERS[m["vowel"].lower()] + "u", m["m3"] + m["m4"])
    elif m["rho"]:
        out = "rrh"
    elif m["nasal"]:
        out = "n"
    else:
        c, marks = m["letter"].lower(), m["marks"]
        if c in "αεηιουω":
            out = _voiced(LETTERS[c], marks)
        elif c == "ρ":
            out = "rh" if ROUGH in marks else "r"
        elif c in LETTERS:
            out = LETTERS[c]
        elif c in "\u1fbd\u2019'\u02bc":
            return "\u2019"
        else:
            return m["letter"] + ("" if ROUGH in marks or SMOOTH in marks else marks)
    return out[0].upper() + out[1:] if m[0][0] != m[0][0].lower() else out


def romanise(word: str) -> str:
    """ē and ō for the long vowels, y for a lone upsilon, h for the rough breathing, an acute on the accented vowel."""
    return unicodedata.normalize("NFC", _SOUND.sub(_sound, unicodedata.normalize("NFD", word)))


# Fixed values of Beta Code.
BETA = dict(zip("abgdezhqiklmncoprstufxywv", "αβγδεζηθικλμνξοπρστυφχψωϝ", strict=True))
BETA_MARKS = {")": SMOOTH, "(": ROUGH, "/": ACUTE, "\\": GRAVE, "=": CIRCUMFLEX, "|": IOTA, "+": DIAERESIS, "&": "\u0304", "'": "\u0306"}
_BETA = re.compile(r"(?P<star>\*)?(?P<before>[()/\\=|+&]*)(?P<letter>[a-z])(?P<sigma>[123])?(?P<after>[()/\\=|+&]*)", re.IGNORECASE)


def beta_to_unicode(s: str) -> str:
    """Beta Code as Greek; marks of a capital stand before its letter, sigma before no letter is final."""

    def one(m: re.Match) -> str:
        c = BETA.get(m["letter"].lower())
        if c is None:
            return m[0]
        marks = m["before"] + m["after"]
        if c == "σ":
            rest = s[m.end() :]
            final = m["sigma"] == "2" or (m["sigma"] is None and not re.match(r"[*()/\\=|+&']*[a-z]", rest, re.IGNORECASE))
            c = "ς" if final and not m["star"] else "σ"
        order = sorted(marks, key="+)(/\\=&|".find)
        return (c.upper() if m["star"] else c) + "".join(BETA_MARKS[x] for x in order)

    return unicodedata.normalize("NFC", _BETA.sub(one, s))


def _udf(f):
    def g(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return F.pandas_udf(g, "string")


def transliterate(c: Column) -> Column:
    return _udf(romanise)(c)


def beta_code(c: Column) -> Column:
    return _udf(beta_to_unicode)(c)
