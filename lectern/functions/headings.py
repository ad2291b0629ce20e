"""Structural headings: what a line of a printed page announces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that announce a numbered part, by kind, in the order they are tried; those that stand alone; and those
# that begin a paragraph.
NUMBERED = {
    "lemma": ["lem", "lemma"], "def": ["def", "definition"], "law": ["lex", "law"], "corol": ["corol", "corollarium", "corollary"], "rule": ["rule"],
    "phaenomenon": ["phænomenon", "phaenomenon", "phænomena", "phaenomena"], "hypoth": ["hypothesis"],
}
PROPOSITION, SORTS = ["pro", "prop", "proposition"], ["theor", "theorema", "theorem", "prob", "problema", "problem"]
ALONE = {
    "hypotheses-group": ["hypotheses"], "scholium-like": ["scholium", "scholium generale", "general scholium", "schol", "idem aliter", "example", "exemplum"], "hypoth": ["hypothesis"],
}
BEGINNINGS = {"corol": ["cor", "corol", "corollarium"], "hypoth": ["hypoth"], "case": ["cas"]}
ROMAN = "[ivxlcdm]+"


def _words(line: Column) -> Column:
    """Lower-case words of a line, points taken off their ends."""
    return F.filter(F.transform(F.split(F.lower(F.trim(line)), r"\s+"), lambda w: F.rtrim(w, F.lit("."))), lambda w: w != "")


def heading(line: Column) -> Column:
    """struct<kind, number> of a centred line: a kind's word and a roman numeral, or a word that stands alone; else null."""
    w = _words(line)
    number = F.upper(F.get(w, F.lit(1)))
    numeral = lambda k: F.coalesce(F.get(w, F.lit(k)).rlike(f"^{ROMAN}$"), F.lit(False))
    of = lambda words, k=0: F.get(w, F.lit(k)).isin(*words)
    kind = F.when((F.size(w) == 4) & of(PROPOSITION) & numeral(1) & of(SORTS, 2) & numeral(3), "prop")
    for name, words in NUMBERED.items():
        kind = kind.when((F.size(w) == 2) & of(words) & numeral(1), name)
    text = F.array_join(w, " ")
    alone = None
    for name, words in ALONE.items():
        alone = F.when(text.isin(*words), name) if alone is None else alone.when(text.isin(*words), name)
    alone = alone.when(of(["definitio"]), "def")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), number.alias("number"))).when(alone.isNotNull(), F.struct(alone.alias("kind"), F.lit(None).cast("string").alias("number")))


def beginning(paragraph: Column) -> Column:
    """struct<kind, number> where a paragraph begins with a marker and its number, as "Cor. 2. ", else null."""
    first = F.split(paragraph, r"\s+", 3)
    word, number = F.rtrim(F.lower(F.get(first, F.lit(0))), F.lit(".")), F.rtrim(F.get(first, F.lit(1)), F.lit("."))
    kind = None
    for name, words in BEGINNINGS.items():
        hit = word.isin(*words) & F.lower(number).rlike(f"^{ROMAN}$" if name == "hypoth" else "^[ivxlcdm0-9]+$")
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return F.when(kind.isNotNull() & (F.size(first) > 2), F.struct(kind.alias("kind"), number.alias("number")))


def bare_numeral(head: Column) -> Column:
    """Whether a heading is nothing but a Greek numeral of three letters at most, signs and points aside; an empty one is."""
    bare = F.regexp_replace(head, "[.\\s\u0384\u1fbd']", "")
    return F.coalesce((F.length(bare) <= 3) & bare.rlike("^[\u0370-\u03ff\u1f00-\u1fff]*$"), F.lit(False))
