"""Dictionary tags to the lexicon's tag vocabulary, glosses, and fixed tables of lexicon building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dictionary tags and the lexicon's.
CASES = {"nominative": "nom", "genitive": "gen", "dative": "dat", "accusative": "acc", "ablative": "abl", "vocative": "voc", "locative": "loc"}
NUMBERS = {"plural": "pl", "singular": "sg"}
GENDERS = {"masculine": "m", "feminine": "f", "neuter": "n"}
PERSONS = {"first-person": "1", "second-person": "2", "third-person": "3"}
POS = {
    "noun": "noun", "proper": "name", "verb": "verb", "adj": "adj", "adv": "adv", "particle": "adv", "pron": "pron", "pronoun": "pron", "determiner": "pron", "prep": "prep",
    "preposition": "prep", "conj": "conj", "conjunction": "conj", "num": "num", "numeral": "num", "interj": "interj", "interjection": "interj",
}
SKIPPED_POS = ["root", "suffix", "prefix", "circumfix", "infix", "interfix", "character", "punct", "punctuation", "symbol", "phrase"]
UNUSED_VERB = ["potential", "aorist", "sigmatic", "preterite", "conditional", "conditional-ii", "clitic", "romanization", "multiword-construction"]
CASE_PRIOR = ["nom", "acc", "gen", "dat", "abl", "voc", "loc"]
NUMBER_PRIOR = ["sg", "pl", "du"]
MOOD_PRIOR = ["inf", "ind", "ptcp", "gdv", "subj", "imp", "ger", "sup"]
TENSE_PRIOR = ["pres", "perf", "impf", "fut", "plup", "futperf"]
ITALIAN = {
    "feminine": "f", "masculine": "m", "singular": "sg", "plural": "pl", "first-person": "1", "second-person": "2", "third-person": "3", "present": "pres", "imperfect": "impf",
    "future": "fut", "historic": "perf", "subjunctive": "subj", "indicative": "ind", "imperative": "imp", "infinitive": "inf", "participle": "ptcp", "gerund": "ger",
    "comparative": "comp", "superlative": "sup", "invariable": "indecl",
}
#: Order of an Italian cell's tags by kind; a participle begins with its mood.
ITALIAN_ORDER = [["pres", "impf", "fut", "perf"], ["ind", "subj", "imp", "inf", "ger"], ["1", "2", "3"], ["sg", "pl"], ["m", "f"], ["comp", "sup"], ["indecl"]]
#: Elided and clipped Italian forms, and the words they stand for.
ELISIONS = {
    "l'": ["lo", "la"], "d'": ["di"], "c'": ["ci"], "ch'": ["che"], "m'": ["mi"], "n'": ["ne"], "s'": ["si", "se"], "t'": ["ti"], "v'": ["vi"], "un'": ["una"],
    "quell'": ["quello", "quella"], "com'": ["come"], "ov'": ["ove"], "dov'": ["dove"], "perch'": ["perché"], "quand'": ["quando"], "sanz'": ["sanza"], "mentr'": ["mentre"],
    "altr'": ["altro", "altra", "altri"], "ogn'": ["ogni"], "a'": ["ai"], "de'": ["dei"], "ne'": ["nei"], "que'": ["quei"], "cu'": ["cui"], "fe'": ["fece"], "i'": ["io"],
    "sa'": ["sai"], "se'": ["sei"], "so'": ["sono"], "vo'": ["voglio"], "ell'": ["ella"], "ond'": ["onde"], "ciascun'": ["ciascuna"], "e'": ["egli"],
}

# Words of glosses that only point to another lemma.
KINDS_OF_FORM = ["alternative", "apocopic", "dialectal", "obsolete", "archaic", "rare", "poetic"]
DEGREES = ["comparative", "superlative"]
POINTERS = [
    *(f"{kind}{what} of " for kind in ["", *(k + " " for k in KINDS_OF_FORM)] for what in ("form", "spelling")),
    "misspelling of ", *(f"{d} degree of " for d in DEGREES),
]


def _has(tags: Column, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.array_contains(tags, n)
    return out


def _pick(tags: Column, table: dict[str, str]) -> Column:
    """What the first entry of a table that occurs stands for."""
    return F.coalesce(*(F.when(_has(tags, k), F.lit(v)) for k, v in table.items()))


def _join(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def pos_of(pos: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in POS.items() for x in kv))[pos], F.lit("other"))


def nominal(tags: Column, gender: Column) -> Column:
    """"gen sg m" of a noun's cell, singular where no number is named; null without a case."""
    case = _pick(tags, CASES)
    return F.when(case.isNotNull(), _join(case, F.coalesce(_pick(tags, NUMBERS), F.lit("sg")), gender))


def adjectival(tags: Column, degree: Column) -> Column:
    """The readings of an adjective's cell, one for each gender it names; none without a case."""
    case, number = _pick(tags, CASES), F.coalesce(_pick(tags, NUMBERS), F.lit("sg"))
    d = F.when(degree == "comparative", "comp").when(degree == "superlative", "sup")
    genders = F.array_compact(F.array(*(F.when(_has(tags, k), F.lit(v)) for k, v in GENDERS.items())))
    each = F.transform(genders, lambda g: _join(case, number, g, d))
    return F.when(case.isNull(), F.array().cast("array<string>")).when(F.size(genders) == 0, F.array(_join(case, number, d))).otherwise(each)


def verbal(tags: Column) -> Column:
    """"pres ind act 3 sg" of a verb's cell; null for cells that have no place in the vocabulary."""
    t = F.array_except(tags, F.array(*map(F.lit, UNUSED_VERB)))
    voice = F.when(_has(t, "passive"), "pass").otherwise("act")
    case = _pick(t, CASES)
    plain = lambda futperf: F.when(_has(t, "perfect") & _has(t, "future") & F.lit(futperf), "futperf").when(_has(t, "perfect"), "perf").when(_has(t, "future"), "fut").otherwise("pres")
    mood = F.when(_has(t, "imperative"), "imp").when(_has(t, "subjunctive"), "subj").when(_has(t, "indicative"), "ind")
    tense = (
        F.when(mood == "imp", F.when(_has(t, "future"), "fut").otherwise("pres")).when(_has(t, "perfect", "future"), "futperf").when(_has(t, "pluperfect"), "plup")
        .when(_has(t, "perfect"), "perf").when(_has(t, "future"), "fut").when(_has(t, "imperfect"), "impf").otherwise("pres")
    )
    person, number = _pick(t, PERSONS), _pick(t, NUMBERS)
    finite = F.when(mood.isNotNull() & person.isNotNull() & number.isNotNull(), _join(tense, mood, voice, person, number))
    ptcp = F.when(_has(t, "future", "passive"), "gdv nom sg m").otherwise(F.concat(F.lit("ptcp "), plain(False), F.lit(" "), voice, F.lit(" nom sg m")))
    return (
        F.when(_has(t, "gerund"), _join(F.lit("ger"), case)).when(_has(t, "supine"), _join(F.lit("sup"), case))
        .when(_has(t, "infinitive"), _join(plain(True), F.lit("inf"), voice)).when(_has(t, "participle"), ptcp).otherwise(finite)
    )


# Greek dictionary tags by kind, in the order a cell names them.
GREEK_TENSES = {"aorist": "aor", "present": "pres", "imperfect": "impf", "future": "fut", "perfect": "perf", "pluperfect": "plup"}
GREEK_MOODS = {"indicative": "ind", "subjunctive": "subj", "optative": "opt", "imperative": "imp", "infinitive": "inf", "participle": "ptcp"}
GREEK_OTHERS = [PERSONS, CASES, {"singular": "sg", "dual": "du", "plural": "pl"}, GENDERS, {"comparative": "comp", "superlative": "sup"}]


def greek_combo(tags: Column) -> Column:
    """"aor ind act 3 sg" of a Greek cell: its first tense and mood, its voice (middle and passive together are "mp"), and all else in order."""
    of = lambda table: F.array_compact(F.transform(tags, lambda t: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[t]))
    first = lambda table: F.slice(of(table), 1, 1)
    voice = (
        F.when(_has(tags, "middle", "passive"), "mp").when(_has(tags, "active"), "act").when(_has(tags, "middle"), "mid").when(_has(tags, "passive"), "pass")
    )
    return F.array_join(F.array_distinct(F.concat(first(GREEK_TENSES), first(GREEK_MOODS), F.array_compact(F.array(voice)), *map(of, GREEK_OTHERS))), " ")


def sort_key(morph: Column) -> Column:
    """Order of readings of one lexeme, as a struct: cells with a case first, by number and case, then verbs by mood and tense.

    What a list of priors doesn't have counts as singular, and comes last for mood and tense.
    """
    tags = F.split(morph, " ")
    place = lambda names: F.array_max(F.transform(tags, lambda t: F.array_position(F.array(*map(F.lit, names)), t)))
    last = lambda names: F.coalesce(F.nullif(place(names), F.lit(0)), F.lit(len(names) + 1))
    case = place(CASE_PRIOR)
    nominal, none = case > 0, F.lit(0).cast("long")
    return F.struct(
        (~nominal).alias("verbal"), F.when(nominal, F.greatest(place(NUMBER_PRIOR) - 1, none)).otherwise(none).alias("number"), case.alias("case"),
        F.when(nominal, none).otherwise(last(MOOD_PRIOR)).alias("mood"), F.when(nominal, none).otherwise(last(TENSE_PRIOR)).alias("tense"),
    )


def lemma_gender(forms: Column) -> Column:
    """The first gender of the first canonical form (array of struct<form, tags>) that names one."""
    g = F.transform(F.filter(forms, lambda f: F.array_contains(f["tags"], "canonical")), lambda f: _pick(f["tags"], GENDERS))
    return F.get(F.array_compact(g), F.lit(0))


def italian(tags: Column) -> Column:
    """An Italian cell's tags in canonical order; tags outside the table are dropped."""
    mapped = F.array_distinct(F.array_compact(F.transform(tags, lambda t: F.create_map(*(F.lit(x) for kv in ITALIAN.items() for x in kv))[t])))
    kinds = [["ptcp"], *ITALIAN_ORDER]
    return F.array_join(F.flatten(F.array(*(F.array_intersect(mapped, F.array(*map(F.lit, k))) for k in kinds))), " ")


def clean_gloss(gloss: Column) -> Column:
    """A gloss without the qualifier in brackets before it."""
    g = F.coalesce(gloss, F.lit(""))
    end = F.locate(")", g)
    return F.trim(F.when(F.startswith(g, F.lit("(")) & (end > 0), F.substring(g, end + 1, F.length(g))).otherwise(g))


def form_of(gloss: Column) -> Column:
    """The lemma that a gloss only points to ("alternative form of X"), else null."""
    text = F.array_join(F.filter(F.split(clean_gloss(gloss), r"\s+"), lambda w: w != ""), " ")
    low = F.lower(text)
    phrase = F.get(F.filter(F.array(*map(F.lit, POINTERS)), lambda p: F.startswith(low, p) & (F.length(low) > F.length(p))), F.lit(0))
    lemma = F.substring(text, F.length(phrase) + 1, F.length(text))
    lemma = F.when(F.contains(phrase, F.lit("degree")) & F.endswith(lemma, F.lit(":")), F.substring(lemma, 1, F.length(lemma) - 1)).otherwise(lemma)
    note = F.substring_index(lemma, "(", -1)
    bracketed = F.endswith(lemma, F.lit(")")) & F.contains(lemma, F.lit("(")) & (F.locate(")", note) == F.length(note))
    return F.trim(F.when(bracketed, F.substring(lemma, 1, F.length(lemma) - F.length(note) - 1)).otherwise(lemma))


def valid_lemma(lemma: Column) -> Column:
    """A word of Latin letters, apostrophes and inner hyphens, thirty at most."""
    return F.coalesce(lemma.rlike(r"^[A-Za-zĀ-ſƀ-ɏÆŒæœ'’-]{1,30}$") & ~lemma.startswith("-") & ~lemma.endswith("-"), F.lit(False))


def elisions(spark: SparkSession) -> DataFrame:
    """(form, words): the table above, 35 rows."""
    return spark.createDataFrame(list(ELISIONS.items()), "form string, words array<string>")
