"""Seeded rounds of drills: the generator's 32-bit arithmetic is what makes rounds repeatable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

OPTIONS, ITEMS, HINT_FADES_AFTER = 4, 12, 3
_32 = 0xFFFFFFFF


def generator(seed: int) -> Callable[[], float]:
    """mulberry32, a published generator: floats in [0, 1)."""
    state = seed & _32

    def draw() -> float:
        nonlocal state
        state = state + 0x6D2B79F5 & _32
        x = (state ^ state >> 15) * (state | 1) & _32
        x ^= x + ((x ^ x >> 7) * (x | 61) & _32) & _32
        return ((x ^ x >> 14) & _32) / 2**32

    return draw


def picks(seed: int, size: int, most: int) -> list[int]:
    """Up to ``most`` different places under ``size``, in order, by a linear congruential generator in double arithmetic."""
    found: set[int] = set()
    while len(found) < min(most, size):
        seed = int(float(seed) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        found.add(int(seed / 0x7FFFFFFF * size))
    return sorted(found)


def shuffled(values: list, draw: Callable[[], float]) -> list:
    """Fisher-Yates from the end."""
    out = list(values)
    for k in reversed(range(1, len(out))):
        at = int(draw() * (k + 1))
        out[k], out[at] = out[at], out[k]
    return out


def distractors(pool: list[str], answer: str, n: int, draw: Callable[[], float]) -> list[str]:
    """Up to n wrong answers: first of similar length and the same initial, then of similar length, then any."""
    rest = [p for p in pool if p != answer]
    close = [p for p in rest if abs(len(p) - len(answer)) <= 2]
    alike = [p for p in close if p[:1].lower() == answer[:1].lower()]
    got: dict[str, None] = {}
    for tier in (alike, close, rest):
        got |= dict.fromkeys(shuffled(tier, draw)) if len(got) < n else {}
    return list(got)[:n]


def make_round(words: list[dict], kind: str, seed: int, count: int = ITEMS) -> list[dict]:
    """Items of one round; words have id, gloss and (for "decode") translit. Fewer than four words give no round."""
    draw = generator(seed)
    shown = "translit" if kind == "decode" else "gloss"
    words = [w for w in words if w.get("gloss") and w.get(shown)]
    if len(words) < OPTIONS:
        return []
    pool = [w[shown] for w in words]
    items = []
    for w in shuffled(words, draw)[:count]:
        options = shuffled([w[shown], *distractors(pool, w[shown], OPTIONS - 1, draw)], draw)
        items.append({"item": f"{kind}:{w['id']}", "options": options, "answer": options.index(w[shown])})
    return items


def rounds(words: DataFrame, kind: str, seed: int) -> DataFrame:
    """A round for each group (lang) of (lang, pos, id, gloss, translit); a group is a core list of a few hundred words."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        got = make_round(pdf.astype(object).where(pdf.notna(), None).to_dict("records"), kind, seed)
        return pd.DataFrame([{"lang": pdf["lang"].iloc[0], "n": k, **i} for k, i in enumerate(got)], columns=["lang", "n", "item", "options", "answer"])

    return words.groupBy("lang").applyInPandas(one, "lang string, n int, item string, options array<string>, answer int")


def hint_shown(answers: list[tuple[bool, bool]]) -> bool:
    """False after three right answers without the hint in a row at the end of (correct, hinted)."""
    streak = 0
    for correct, hinted in reversed(answers):
        if not correct or hinted:
            break
        streak += 1
    return streak < HINT_FADES_AFTER


def hints(answers: Iterator[tuple[bool, bool]]) -> bool:
    return hint_shown(list(answers))
