"""Repairs of scanned text, and enumerations in prefaces."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that scans put for Latin ones.
HOMOGLYPHS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ι": "i", "Μ": "M",
}
SYMBOLS = r"[■□▪●◆★†‡¤§¶|~^_<>{}\\]"
#: Latin ordinals by number, as prefaces count articles.
ORDINALS = {
    "primo": 1, "secundo": 2, "secundum": 2, "tertio": 3, "quarto": 4, "quinto": 5, "sexto": 6, "septimo": 7, "octavo": 8, "nono": 9, "decimo": 10,
    "undecimo": 11, "duodecimo": 12, "tertiodecimo": 13, "decimotertio": 13, "quartodecimo": 14, "decimoquarto": 14, "quintodecimo": 15,
    "decimoquinto": 15, "sextodecimo": 16, "decimosexto": 16, "septimodecimo": 17, "decimoseptimo": 17, "octavodecimo": 18, "decimooctavo": 18,
    "nonodecimo": 19, "decimonono": 19, "vigesimo": 20,
}
_ordinal = re.compile(r"\b(" + "|".join(sorted(ORDINALS, key=len, reverse=True)) + r")\b,?\s*", re.IGNORECASE)
REACH = 900


def homoglyphs(c: Column) -> Column:
    return F.translate(c, "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))


def repair(c: Column) -> Column:
    """Hyphens at line ends closed, symbols off, punctuation parted from the word behind it, spaces collapsed."""
    c = F.regexp_replace(homoglyphs(c), r"(?<=\p{Ll})[-¬]\s*\n\s*(?=\p{Ll})", "")
    c = F.regexp_replace(c, SYMBOLS, " ")
    c = F.regexp_replace(c, r"([,;:!?])(?=\p{L})", "$1 ")
    c = F.regexp_replace(c, r"\s+([,;:.!?])", "$1")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def noise_line(c: Column) -> Column:
    """A line with hardly a letter in it: under half letters, or a page number, or a running head in capitals."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (F.length(F.trim(c)) == 0) | (letters * 2 < F.length(F.regexp_replace(c, r"\s", ""))) | c.rlike(r"^\s*[\dIVXLC]+\s*$") | (c.rlike(r"^[\p{Lu}\s\d.,]+$") & (F.length(c) < 60))


def contaminated(c: Column, most: float = 0.08) -> Column:
    """Whether too much of a text is neither letter, space, digit nor common punctuation."""
    odd = F.length(F.regexp_replace(c, r"[\p{L}\p{M}\s\d.,;:!?'\"()\[\]-]", ""))
    return F.coalesce(odd > most * F.length(c), F.lit(False))


def plausible_title(c: Column) -> Column:
    """Three to 26 words, 200 letters at most, no digit."""
    n = F.size(F.split(F.trim(c), r"\s+"))
    return F.coalesce(n.between(3, 26) & (F.length(c) <= 200) & ~c.rlike(r"\d"), F.lit(False))


def truncated(c: Column, least: int = 60) -> Column:
    return F.coalesce((F.length(F.trim(c)) < least) | F.rtrim(c).endswith("-"), F.lit(True))


def enumeration(text: str) -> list[str]:
    """The items of the longest run primo, secundo, ... whose marks are 900 characters apart at most; of equal ones the last."""
    marks = [(ORDINALS[m[1].lower()], m.start(), m.end()) for m in _ordinal.finditer(text)]
    best: list[tuple[int, int, int]] = []
    for k, first in enumerate(marks):
        if first[0] != 1:
            continue
        run = [first]
        for m in marks[k + 1 :]:
            if m[1] - run[-1][2] > REACH:
                break
            if m[0] == len(run) + 1:
                run.append(m)
        if len(run) >= len(best):
            best = run
    ends = [m[1] for m in best[1:]]
    if best:
        stop = re.compile(r"[.?!]").search(text, best[-1][2])
        ends.append(stop.start() if stop else len(text))
    return [text[m[2] : e].strip(" ,;.\n") for m, e in zip(best, ends, strict=True)]


def enumerations(c: Column) -> Column:
    def g(s: pd.Series) -> pd.Series:
        return s.map(enumeration, na_action="ignore")

    return F.pandas_udf(g, "array<string>")(c)
