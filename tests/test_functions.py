import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import drills, greek, html, labels, morph, ocr, snippet, tags, text, tokenizer, unicode
from lectern.functions.reference import parse_reference


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string").orderBy("k").select(*columns).collect()]


FOLDS = [("pœna", "poena"), ("cælum", "caelum"), ("grātiā", "gratia"), ("Weiß", "weiss"), ("  quinque   \n viis  ", "quinque viis"), ("Prōœmium  cælī", "prooemium caeli"), ("Ἀθηναῖος", "αθηναιος")]


def test_fold(spark):
    got = values(spark, [(a, None) for a, _ in FOLDS], text.fold(F.col("a")), unicode.fold_exact(F.col("a")), text.fold(text.fold(F.col("a"))))
    assert [g[0] for g in got] == [b for _, b in FOLDS] == [g[1] for g in got]
    assert all(g[0] == g[2] for g in got)


#: Ligatures under a mark: one fold takes the mark off, a second one spells the ligature out.
UNDER_MARKS = {"Ǽ": "æ", "ǽ": "æ", "Ǣ": "æ", "ǣ": "æ"}


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(max_codepoint=0x3FF, exclude_characters="".join(UNDER_MARKS))))
def test_fold_text_idempotent(s):
    assert unicode.fold_text(unicode.fold_text(s)) == unicode.fold_text(s)


def test_fold_of_ligatures_under_marks():
    assert {c: unicode.fold_text(c) for c in UNDER_MARKS} == UNDER_MARKS


def test_fold_agrees_with_the_exact_one(spark):
    """Hangul, typographic ligatures, fractions, full-width letters, spacing and combining marks, and every letter of the first blocks."""
    odd = ["한국 사람", "the ﬁnal word", "½ ＡＢＣ Ⅳ ㎏", "a\u0301 e\u0308\u0301", "ŉ ŀ ǆ Ǆ ſ", "\u2003x\ufeff\u00a0y ", "ΛΌΓΟΣ λόγος", "𝔘𝔫𝔦 𝟙", "ß æ œ Æ", "İi ı", "e\u0345"]
    odd += ["".join(map(chr, range(k, k + 64))) for k in range(0xA0, 0x600, 64)]
    got = values(spark, [(s, None) for s in odd], text.fold(F.col("a")))
    assert [g for (g,) in got] == [unicode.fold_text(s) for s in odd]


def test_sanitiser_takes_any_markup():
    for s in ("<![foo bar", "a<![foo bar>b<b>c", "<![CDATA[x]]>y", "<!", "<![", "&#", "<a href='javascript:x'>z"):
        assert "<!" not in html.sanitise(s).replace("&lt;!", "")
    assert html.sanitise("a<![foo bar>b<b>c") == "ab<b>c</b>"


def test_tokens_of_folded(spark):
    got = values(spark, [("Deum esse, quinque viis", None), (", .", None)], text.word_tokens(text.fold(F.col("a"))))
    assert [g[0] for g in got] == [["deum", "esse", "quinque", "viis"], []]


def test_keys(spark):
    rows = [("ΛΟΓΟΣ", "grc"), ("λόγος", "grc"), ("jam", "la"), ("pœna", "la"), ("vīvā", "la"), ("δ᾽", "grc"), ("dell’", "it")]
    got = values(spark, rows, unicode.loose_key(F.col("a"), F.col("b")), unicode.fold_key(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == ["λογος", "λόγος", "iam", "poena", "viva", "δ", "dell'"]
    assert [g[1] for g in got] == ["λογοσ", "λογοσ", "iam", "poena", "uiua", "δ", "dell"]


@pytest.mark.parametrize(("s", "lang", "want"), [
    ("δ᾽ ἄρα", "grc", ["word", "space", "word"]), ("l'amore", "it", ["word", "word"]), ("quid'st", "la", ["word", "punct", "word"]), ("a1 2,", "la", ["word", "number", "space", "number", "punct"]),
])
def test_tokenizer(s, lang, want):
    assert [t[0] for t in tokenizer.tokenize(s, lang)] == want


@settings(max_examples=100, deadline=None)
@given(st.text(), st.sampled_from(["grc", "la", "it"]))
def test_tokens_tile_the_text(s, lang):
    got = list(tokenizer.tokenize(s, lang))
    assert "".join(t[3] for t in got) == s
    assert [t[1] for t in got] == [0, *(t[2] for t in got)][: len(got)]


def test_token_table(spark):
    df = spark.createDataFrame([(1, "l'amore 3", "it"), (2, None, None)], "id long, text string, lang string")
    assert [tuple(r) for r in tokenizer.tokens(df, words_only=True).collect()] == [(1, 0, "word", 0, 2, "l'", "l'"), (1, 1, "word", 2, 7, "amore", "amore")]


def test_shards(spark):
    got = values(spark, [("grc:noun:λόγος", None), ("la:noun:volo#2", None), ("la:noun:", None)], unicode.shard_candidates(F.col("a")))
    assert [g[0] for g in got] == [["λογο", "λογ", "λο", "λ", "_"], ["volo", "vol", "vo", "v", "_"], ["_"]]


REFERENCES = [
    ("I q 2 a 3", "I q. 2 a. 3"), ("I q. 2 a. 3", "I q. 2 a. 3"), ("I-II 94 2", "I-II q. 94 a. 2"), ("II-II q.23 a.1", "II-II q. 23 a. 1"), ("III 1 1", "III q. 1 a. 1"),
    ("1 2 3", "I q. 2 a. 3"), ("2 5", "II-II q. 5"), ("prima 2 3", "I q. 2 a. 3"), ("I q 2", "I q. 2"), ("prima secundae 4", "I-II q. 4"), ("11 2", None), ("virtue", None), ("", None), ("I q 0", None), (None, None), ("iv 2", None),
]


def test_references(spark):
    got = values(spark, [(a, None) for a, _ in REFERENCES], parse_reference(F.col("a"))["citation"])
    assert [g[0] for g in got] == [b for _, b in REFERENCES]


def test_labels(spark):
    rows = [(str(n), None) for n in (1, 4, 9, 14, 40, 90, 400, 1994, 3999, 0, -3)]
    n = F.col("a").cast("int")
    got = values(spark, rows, labels.roman(n), labels.roman_to_int(labels.roman(n)))
    assert [g[0] for g in got] == ["I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", "MMMCMXCIX", "0", "-3"]
    assert [g[1] for g in got] == [1, 4, 9, 14, 40, 90, 400, 1994, 3999, None, None]
    kinds = [("book-3", "Book"), ("elements-book-1-prop-4", "Proposition"), ("book-6-ch-121A", "Chapter"), ("act-1-scene-2", "Scene"), ("act-1", "Act"), ("inferno-canto-3", "Canto"), ("sec-9", None), ("archimedes-book-1-ch-1", None)]
    assert [g[0] for g in values(spark, [(a, None) for a, _ in kinds], labels.kind_label(F.col("a")))] == [b for _, b in kinds]
    stages = [(300, "I"), (999, "I"), (1000, "II"), (4999, "III"), (10000, "V")]
    assert [g[0] for g in values(spark, [(str(a), None) for a, _ in stages], labels.stage_for_pool(F.col("a").cast("int")))] == [b for _, b in stages]
    assert values(spark, [("la:noun:volo#2", None)], labels.lexeme_lemma(F.col("a"))) == [("volo",)]


def test_greek():
    assert [greek.romanise(w) for w in ("ῥήτωρ", "ἄγγελος", "υἱός", "ἀϋπνία", "Ὅμηρος")] == ["rhḗtōr", "ángelos", "huiós", "aypnía", "Hómēros"]
    assert [greek.beta_to_unicode(w) for w in ("kate/bhn", "*peiraia=", "th=|", "lo/gos", "*)aqhnai=os")] == ["κατέβην", "Πειραιᾶ", "τῇ", "λόγος", "Ἀθηναῖος"]


def test_morphology(spark):
    got = values(spark, [("verb ptcp perf mp nom sg n", None), ("verb ind pres act 3 sg", None), ("noun gen pl f", None), ("adv", None), ("noun xx", None)], morph.describe(F.col("a")), morph.unknown_tags(F.col("a")))
    assert [g[0] for g in got] == ["perfect participle middle/passive, nominative singular neuter", "present indicative active 3rd person singular", "genitive plural feminine", "adverb", "xx"]
    assert got[-1][1] == ["xx"]
    assert sorted(values(spark, [("nom/acc sg m/n", None)], morph.combinations(F.col("a")))[0][0]) == ["acc sg m", "acc sg n", "nom sg m", "nom sg n"]


def test_snippets():
    got = snippet.snippet("lex ponit pœnam culpae debitam", "poenam")
    assert got["match"] == "pœnam" and got["found"]
    assert snippet.snippet("some text", "zzzznotfound") == {"before": "some text", "match": "", "after": "", "found": False}
    long = "word " * 100 + "Grātia plena " + "tail " * 100
    got = snippet.snippet(long, "gratia plena")
    assert got["match"] == "Grātia plena" and got["before"].startswith("…word") and got["after"].endswith("…")


def test_drills():
    words = [{"id": f"w{k}", "gloss": "g" * (k % 4 + 1) + str(k), "translit": None} for k in range(9)]
    a, b = drills.make_round(words, "match", 5), drills.make_round(words, "match", 5)
    assert a == b != drills.make_round(words, "match", 6)
    assert all(len(set(i["options"])) == 4 and i["options"][i["answer"]] for i in a) and len(a) == 9
    assert drills.make_round(words[:3], "match", 5) == [] == drills.make_round(words, "decode", 5)
    draw = drills.generator(1)
    assert [round(draw(), 6) for _ in range(2)] == [0.627074, 0.002736]
    assert drills.hint_shown([(True, False)] * 2) and not drills.hint_shown([(False, False), *[(True, False)] * 3]) and drills.hint_shown([(True, False)] * 3 + [(True, True)])


def test_sanitiser(spark):
    dirty = '<p onclick="x">a<script>alert(1)</script><b>b<a href="javascript:x" title="t">c</a><img src=x>d & e'
    assert html.sanitise(dirty) == "<p>a<b>b<a>c</a>d &amp; e</b></p>"
    assert values(spark, [(dirty, None), (html.sanitise(dirty), None)], html.unsafe(F.col("a"))) == [(True,), (False,)]


def test_ocr(spark):
    got = values(spark, [("quae-\nstio prima ,est;sic ■ Аrs", None), ("XIV", None), ("LIBER I. CAP", None), ("Deus est bonum.", None)], ocr.repair(F.col("a")), ocr.noise_line(F.col("a")))
    assert got[0][0] == "quaestio prima, est; sic Ars"
    assert [g[1] for g in got] == [False, True, True, False]
    titles = values(spark, [("Utrum Deus sit", None), ("Utrum 3 sint", None), ("Deus", None)], ocr.plausible_title(F.col("a")), ocr.truncated(F.col("a"), 10))
    assert titles == [(True, False), (False, False), (False, True)]


def test_enumerations(spark):
    s = "Et primo, dicendum. Circa hoc quaeruntur tria: primo, utrum X; secundo, utrum Y; tertio, an Z. Finis."
    assert ocr.enumeration(s) == ["utrum X", "utrum Y", "an Z"]
    assert ocr.enumeration("nihil") == []
    assert values(spark, [(s, None)], ocr.enumerations(F.col("a"))) == [(["utrum X", "utrum Y", "an Z"],)]


@pytest.mark.parametrize("late", [
    ["tertiodecimo", "quartodecimo", "quintodecimo", "sextodecimo", "septimodecimo", "octavodecimo", "nonodecimo"],
    ["decimotertio", "decimoquarto", "decimoquinto", "decimosexto", "decimoseptimo", "decimooctavo", "decimonono"],
])
def test_long_enumerations(late):
    first = ["Primo", "secundum", "tertio", "quarto", "quinto", "sexto", "septimo", "octavo", "nono", "decimo", "undecimo", "duodecimo"]
    names = [*first, *late, "vigesimo"]
    text = "Quaeruntur viginti. " + "; ".join(f"{w}, utrum X{k}" for k, w in enumerate(names)) + ". Ad primum."
    assert ocr.enumeration(text) == [f"utrum X{k}" for k in range(20)]


CELLS = [
    (["genitive", "singular"], "gen sg m", ["gen sg"], None), (["feminine", "masculine", "plural", "vocative"], "voc pl m", ["voc pl m", "voc pl f"], None), (["ablative"], "abl sg m", ["abl sg"], None),
    (["present", "active", "indicative", "third-person", "singular"], None, [], "pres ind act 3 sg"), (["future", "perfect", "indicative", "first-person", "plural"], None, [], "futperf ind act 1 pl"),
    (["perfect", "passive", "participle"], None, [], "ptcp perf pass nom sg m"), (["future", "passive", "participle"], None, [], "gdv nom sg m"), (["perfect", "infinitive"], None, [], "perf inf act"),
    (["gerund", "ablative"], "abl sg m", ["abl sg"], "ger abl"), (["imperative", "future", "second-person", "singular"], None, [], "fut imp act 2 sg"), (["indicative", "sigmatic"], None, [], None),
]


def test_cells(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CELLS)], "k int, t array<string>").orderBy("k")
    t = F.col("t")
    got = df.select(tags.nominal(t, F.lit("m")).alias("n"), tags.adjectival(t, F.lit(None).cast("string")).alias("a"), tags.verbal(t).alias("v")).collect()
    assert [(r.n, r.a) for r in got] == [(c[1], c[2]) for c in CELLS]
    assert [r.v for r in got][3:] == [c[3] for c in CELLS][3:]


def test_tag_orders_and_glosses(spark):
    morphs = ["nom sg m", "gen sg m", "loc", "nom pl f", "acc pl m", "abl du", "pres inf act", "fut inf", "perf ind act 3 pl", "impf subj act 3 sg", "sup", "adv"]
    keys = [k for (k,) in values(spark, [(m, None) for m in morphs], tags.sort_key(F.col("a")))]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    it = spark.createDataFrame([(["plural", "participle", "feminine", "present"],), (["singular", "third-person", "historic", "indicative", "odd"],)], "t array<string>")
    assert [r[0] for r in it.select(tags.italian(F.col("t"))).collect()] == ["ptcp pres pl f", "perf ind 3 sg"]
    rows = [("(poetic) to burn", None), ("alternative form of amo (obsolete)", None), ("Misspelling of volo", None), ("comparative degree of bonus:", None), (None, None)]
    got = values(spark, rows, tags.clean_gloss(F.col("a")), tags.form_of(F.col("a")))
    assert [g[0] for g in got][0] == "to burn" and [g[1] for g in got] == [None, "amo", "volo", "bonus", None]
    assert values(spark, [("amō", None), ("-que", None), ("a b", None), ("x" * 31, None)], tags.valid_lemma(F.col("a"))) == [(True,), (False,), (False,), (False,)]
    assert tags.elisions(spark).count() == 35


def test_sentences_keep_their_digits(spark):
    """A sentence that begins or ends with the digits of its own place, one that is this digit, and spaces at the ends."""
    rows = [("0 a. 1. 2 b 2;  c 3! 44 d 4? 5 e", None), (" x y ", None), ("", None), (None, None)]
    got = values(spark, rows, text.sentences(F.col("a")))
    assert got == [(["0 a.", "1.", "2 b 2;", "c 3!", "44 d 4?", "5 e"],), (["x y"],), ([],), (None,)]


def test_upper_keeps_lengths(spark):
    """As DuckDB's upper: letters whose full upper case is longer have their simple one, or none."""
    rows = ["Größe", "ß", "ungäß\nie", "ŉ ǰ ﬁ ΐ", "ᾳ ᾼ ᾠ", "plain ǆ", "", None]
    got = [g[0] for g in values(spark, [(r, None) for r in rows], text.upper(F.col("a")))]
    assert got == [duckdb.execute("SELECT upper(?)", [r]).fetchone()[0] for r in rows]
    assert got[0] == "GRÖ\u1e9eE"
