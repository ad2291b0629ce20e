"""The lossless tokenizer: tokens tile the text, with kinds and offsets (in code points)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.unicode import ELISION, loose_text
from lectern.shipping import map_arrow

_LETTERS = {"grc": "\u0370-\u03ff\u1f00-\u1fff\u0300-\u036f", "la": "A-Za-z\u00c0-\u024f\u0300-\u036f"}
_LETTERS["it"] = _LETTERS["la"]


def _pattern(lang: str) -> re.Pattern:
    letters = _LETTERS.get(lang, _LETTERS["la"])
    mark = f"[{ELISION}]?" if lang in ("grc", "it") else ""
    return re.compile(rf"(?P<space>[\s\ufeff]+)|(?P<word>[{letters}]+{mark})|(?P<number>[0-9]+)|(?P<one>.)", re.DOTALL)


_patterns = {lang: _pattern(lang) for lang in ("grc", "la", "it")}


def tokenize(text: str, lang: str) -> Iterator[tuple[str, int, int, str, str]]:
    """(kind, start, end, surface, key); key is the loose key of words, else empty."""
    for m in _patterns.get(lang, _patterns["la"]).finditer(text):
        kind, s = m.lastgroup, m[0]
        if kind == "one":
            kind = "punct" if unicodedata.category(s)[0] in "PS" else "other"
        yield kind, m.start(), m.end(), s, loose_text(s, lang) if kind == "word" else ""


_SCHEMA = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("key", pa.string())])


def _tokens(batches: Iterator[pa.RecordBatch], words_only: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, text, lang in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            found = (t for t in tokenize(text or "", lang or "la") if not words_only or t[0] == "word")
            rows += [(i, n, *t) for n, t in enumerate(found)]
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def tokens(df: DataFrame, words_only: bool = False) -> DataFrame:
    """(id, pos, kind, start, end, surface, key) of (id, text, lang); a task works on its own rows, nothing is shuffled."""
    rows = df.select(F.col("id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return map_arrow(rows, lambda it: _tokens(it, words_only), "id long, pos int, kind string, start int, end int, surface string, key string")
