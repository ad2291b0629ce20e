"""Folding, tokens and snippets as Catalyst expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's \s has it.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
NOT_WORD = r"[^\p{L}\p{N}]+"


#: Latin letters with marks, U+00C0-024F, as their base letters where these are one: what most texts need.
_LATIN = {c: d for c in map(chr, range(0xA0, 0x250)) if c.lower() == c and len(d := "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")) == 1 and d != c}
#: Other characters, and those of the range above whose decomposition is longer: these go by Unicode's tables.
_OTHER = "[" + "".join(c for c in map(chr, range(0xA0, 0x250)) if c not in _LATIN and unicodedata.normalize("NFKD", c) != c and c.lower() == c) + "\u0250-\U0010ffff]"


def decomposed(c: Column) -> Column:
    """Compatibility decomposition (NFKD) of any text, by the Unicode tables that come with Spark."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(True))


def fold(c: Column) -> Column:
    """Lower case, ligatures spelled out, compatibility decomposition, combining marks off, spaces collapsed and trimmed.

    Queries and texts go through the same fold, in the JVM. Text that is Latin takes a table; other text is decomposed by
    ``decomposed``. Folding twice is folding once but for a ligature under a mark, as U+01FD, which the second one spells out.
    """
    c = F.lower(c)
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ß", "ss")):
        c = F.replace(c, F.lit(a), F.lit(b))
    latin = F.translate(c, "".join(_LATIN), "".join(_LATIN.values()))
    any_ = F.regexp_replace(decomposed(c), "[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(F.when(c.rlike(_OTHER), any_).otherwise(latin), SPACE, " "))


def fold_search(c: Column) -> Column:
    """``fold`` with final sigma as sigma."""
    return F.translate(fold(c), "ς", "σ")


#: Letters whose upper case is longer than they are, and their simple one: that of ß is U+1E9E, most others have none.
_LONG = {c: "\u1e9e" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1}


def upper(c: Column) -> Column:
    """Upper case a letter for a letter, as DuckDB has it: a text keeps its length, where ``F.upper`` makes SS of ß."""
    long = "".join(_LONG)
    runs = F.regexp_extract_all(c, F.lit(f"[{long}]|[^{long}]+"), F.lit(0))
    simple = F.transform(runs, lambda s: F.when(s.rlike(f"[{long}]"), F.translate(s, long, "".join(_LONG.values()))).otherwise(F.upper(s)))
    return F.when(c.rlike(f"[{long}]"), F.array_join(simple, "")).otherwise(F.upper(c))


def word_tokens(folded: Column) -> Column:
    """Runs of letters and digits of folded text."""
    return F.filter(F.split(folded, NOT_WORD), lambda t: t != "")


def snippet_around(text: Column, folded: Column, query: str, before: int = 70, after: int = 90, head: int = 160) -> Column:
    """Text around the first hit, found by proportion as folding can change lengths; the head of the text without a hit."""
    at = F.locate(query, folded) - 1
    n = F.length(text)
    approx = F.floor(at / F.length(folded) * n + 0.5).cast("int")
    start = F.greatest(F.lit(0), approx - before)
    end = F.least(n, approx + len(query) + after)
    mark = lambda cond: F.when(cond, "…").otherwise("")
    hit = F.concat(mark(start > 0), F.trim(F.substring(text, start + 1, end - start)), mark(end < n))
    return F.when(at < 0, F.concat(F.trim(F.substring(text, 1, head)), mark(n > head))).otherwise(hit)


def sentences(c: Column) -> Column:
    """Split behind . ; · ! ? and a space, or at newlines."""
    # a lambda of one parameter: F.trim itself would take the position as the characters to trim
    return F.filter(F.transform(F.split(c, r"(?<=[.;·!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def any_marker(c: Column, markers: list[str]) -> Column:
    """The markers that occur in the lower-cased text; those with < or > are compared as they are."""
    hit = lambda m: F.contains(c if set(m) & set("<>") else F.lower(c), F.lit(m if set(m) & set("<>") else m.lower()))
    return F.array_compact(F.array(*(F.when(hit(m), F.lit(m)) for m in markers)))


def citation_like(gloss: Column, abbreviation: str = r"[A-Z][A-Za-z]*\.", share: float = 0.7) -> Column:
    """Whether abbreviations cover more than ``share`` of the text."""
    found = F.regexp_extract_all(gloss, F.lit(f"({abbreviation})"))
    covered = F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x))
    return F.coalesce(covered > share * F.length(gloss), F.lit(False))
