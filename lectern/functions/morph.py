"""Morphological tags in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags and their words, in the order in which a description names their kinds.
KINDS: list[tuple[str, dict[str, str]]] = [
    ("tense", {"pres": "present", "impf": "imperfect", "fut": "future", "aor": "aorist", "perf": "perfect", "plup": "pluperfect", "futperf": "future perfect", "past": "past", "cond": "conditional"}),
    ("mood", {"ind": "indicative", "subj": "subjunctive", "opt": "optative", "imp": "imperative", "inf": "infinitive", "ptcp": "participle", "gerund": "gerund", "gdv": "gerundive", "sup": "supine"}),
    ("voice", {"act": "active", "mid": "middle", "pass": "passive", "mp": "middle/passive", "dep": "deponent"}),
    ("case", {"nom": "nominative", "gen": "genitive", "dat": "dative", "acc": "accusative", "abl": "ablative", "voc": "vocative", "loc": "locative"}),
    ("number", {"sg": "singular", "pl": "plural", "du": "dual"}),
    ("gender", {"m": "masculine", "f": "feminine", "n": "neuter", "c": "common"}),
    ("degree", {"comp": "comparative", "superl": "superlative"}),
]
POS = {"noun": "noun", "verb": "verb", "adj": "adjective", "adv": "adverb", "pron": "pronoun", "prep": "preposition", "conj": "conjunction", "part": "particle", "num": "numeral", "art": "article", "name": "name", "interj": "interjection"}
PERSONS = {"1": "1st person", "2": "2nd person", "3": "3rd person"}
_WORDS = {t: w for _, words in KINDS for t, w in words.items()}


def _table(words: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in words.items() for x in kv))


def describe(morph: Column) -> Column:
    """"perfect participle middle/passive, nominative singular neuter" of "verb ptcp perf mp nom sg n".

    The part of speech comes first and is left out where other tags follow. Person takes the number behind it; the nominal
    part (case, number, gender) follows a comma after a verbal one. Unknown tags are echoed at the end.
    """
    tags = F.split(F.trim(morph), r"\s+")
    rest = F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0)))
    words, persons = _table(_WORDS), _table(PERSONS)
    of = lambda kind: F.transform(F.filter(rest, lambda t: t.isin(*dict(KINDS)[kind])), lambda t: words[t])
    person = F.transform(F.filter(rest, lambda t: t.isin(*PERSONS)), lambda t: persons[t])
    finite = F.size(person) > 0
    empty = F.array().cast("array<string>")
    verbal = F.concat(of("tense"), of("mood"), of("voice"), person, F.when(finite, of("number")).otherwise(empty))
    nominal = F.concat(of("case"), F.when(finite, empty).otherwise(of("number")), of("gender"), of("degree"))
    other = F.filter(rest, lambda t: ~t.isin(*_WORDS) & ~t.isin(*PERSONS))
    groups = F.filter(F.array(F.array_join(verbal, " "), F.array_join(F.concat(nominal, other), " ")), lambda g: g != "")
    return F.when(F.size(groups) == 0, F.coalesce(_table(POS)[tags[0]], tags[0])).otherwise(F.array_join(groups, ", "))


def short(morph: Column) -> Column:
    """Tags without the part of speech, joined by points."""
    tags = F.split(F.trim(morph), r"\s+")
    return F.array_join(F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0))), ".")


def unknown_tags(morph: Column) -> Column:
    """Tags outside the closed vocabulary."""
    return F.array_except(F.split(F.trim(morph), r"\s+"), F.array(*map(F.lit, [*POS, *_WORDS, *PERSONS])))


def combinations(tag: Column, most: int = 24) -> Column:
    """"nom/acc sg m/n" as its combinations, axis by axis; null beyond ``most``."""
    axes = F.split(F.trim(tag), r"\s+")
    start = F.array(F.lit("")).cast("array<string>")
    cross = lambda acc, axis: F.flatten(F.transform(acc, lambda a: F.transform(F.split(axis, "/"), lambda t: F.trim(F.concat_ws(" ", a, t)))))
    n = F.aggregate(axes, F.lit(1), lambda n, axis: n * F.size(F.split(axis, "/")))
    return F.when(n <= most, F.aggregate(axes, start, cross))
