"""Snippets that map folded offsets back to the source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.unicode import MARKS, fold_text

RADIUS = 120


def fold_map(text: str) -> tuple[str, list[int]]:
    """The folded text, and for each of its characters the offset in the source; space runs collapse."""
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        f = " " if c.isspace() else MARKS.sub("", fold_text(c))
        if f == " " and out and out[-1] == " ":
            continue
        out += f
        at += [i] * len(f)
    return "".join(out), at


def snippet(text: str, query: str) -> dict:
    """before, match, after, found: the phrase if it occurs, else the first of its words that does, else the head."""
    folded, at = fold_map(text)
    wanted = fold_text(query)
    needles = [n for n in [wanted, *wanted.split(" ")] if n]
    for n in needles:
        k = folded.find(n)
        if k >= 0:
            start, end = at[k], at[k + len(n) - 1] + 1
            lo, hi = max(0, start - RADIUS), min(len(text), end + RADIUS)
            if lo > 0:
                gap = text.find(" ", lo, start)
                lo = gap + 1 if gap >= 0 else lo
            if hi < len(text):
                gap = text.rfind(" ", end, hi)
                hi = gap if gap >= 0 else hi
            mark = "…"
            return {"before": (mark if lo else "") + text[lo:start], "match": text[start:end], "after": text[end:hi] + (mark if hi < len(text) else ""), "found": True}
    head = text[: 2 * RADIUS].strip()
    return {"before": head + ("…" if len(text) > 2 * RADIUS else ""), "match": "", "after": "", "found": False}


def build_snippet(text: Column, query: str) -> Column:
    def g(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([snippet(x or "", query) for x in s], columns=["before", "match", "after", "found"])

    return F.pandas_udf(g, "before string, match string, after string, found boolean")(text)
