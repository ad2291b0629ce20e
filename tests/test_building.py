import duckdb
from pyspark.sql import functions as F

from lectern import catalog
from lectern.functions import drills, headings, labels, tags
from lectern.operators import course, lexicon, library, quality
from lectern.sources import corpus


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + schema).orderBy("k").select(*columns).collect()]


def test_division_labels(spark):
    rows = [
        ("book-3", "III", None, None, 0), ("book-1-ch-121A", "121A", None, "On Genus", 0), ("archimedes-sphere-cylinder-book-1", "1", None, None, 0), ("book-2-sec-M4", "M4", None, None, 0),
        ("preface", None, None, None, 0), ("defs", None, "Heading", "Definitions", 3), ("x", None, "Heading", "Title", 0), ("paradiso-canto-5", "5", None, None, 0),
    ]
    c = [F.col(x) for x in ("id", "n", "h", "t", "kids")]
    got = one(spark, rows, "id string, n string, h string, t string, kids int", labels.short_label(*c), labels.full_label(labels.short_label(*c), F.col("t")))
    assert [g[0] for g in got] == ["Book III", "Chapter 121A", "§ 1", "Metre 4", "Praefatio", "Definitions", "Heading", "Canto 5"]
    assert got[1][1] == "Chapter 121A · On Genus" and got[0][1] == "Book III"


def test_unit_labels(spark):
    stop = "struct<id:string,label:string,number:string,top:string,top_label:string>"
    ch = lambda n, top="b1": (f"c{n}", f"Chapter {n}", str(n), top, "Book I")
    whole = ("b2", "Book II", "II", "b2", "Book II")
    rows = [(False, ch(1), ch(3)), (False, whole, whole), (True, ch(9), whole), (False, ch(2), ch(2)), (False, whole, ("b4", "Book IV", "IV", "b4", "Book IV"))]
    got = one(spark, rows, f"m boolean, a {stop}, b {stop}", labels.unit_label(F.col("m"), F.col("a"), F.col("b")))
    assert [g[0] for g in got] == ["Book I · Chapter 1–3", "Book II", "Book I Chapter 9 – Book II", "Book I · Chapter 2", "Book II–IV"]


def test_replies_and_crumbs(spark):
    rows = [(1, False), (20, False), (21, False), (None, False), (3, True), (None, True)]
    got = one(spark, rows, "n int, en boolean", labels.reply_label(F.col("n"), F.col("en")), labels.articulus_label(F.col("n"), F.col("en")))
    assert [g[0] for g in got] == ["Ad primum", "Ad vicesimum", "Ad XXI", "Ad obiectiones", "Reply to Objection 3", "Reply to the Objections"]
    assert [g[1] for g in got] == ["Articulus I", "Articulus XX", "Articulus XXI", "Articulus unicus", "Article III", "Only Article"]
    got = one(spark, [("Prima Pars", None), ("Supplementum", "I")], "p string, app string", labels.crumb(F.col("p"), F.lit(2), F.lit(None).cast("int"), F.col("app"), F.lit(1), F.lit(False)))
    assert [g[0] for g in got] == ["PRIMA PARS · QUAESTIO II · ARTICULUS UNICUS", "SUPPLEMENTUM · APPENDIX I · QUAESTIO I · ARTICULUS UNICUS"]


def test_numbers_of_works(spark):
    rows = [("x urn:cts:greekLit:tlg0012.tlg001.perseus-grc2", "Homer (0012) - Iliad (001).xml"), ("none", "Homer (12) - Iliad (001).xml"), (None, "Homer (0012) - Iliad (books) (001).xml.bak")]
    got = one(spark, rows, "a string, b string", labels.catalogue_numbers(F.col("a")), labels.file_numbers(F.col("b")))
    assert [(g[0] and tuple(g[0]), g[1] and tuple(g[1])) for g in got] == [(("0012", "001"), ("0012", "001")), (None, None), (None, None)]


def test_headings(spark):
    lines = ["LEMMA II.", "Lem. xiv", "Prop. III. Theor. II.", "PROPOSITION IV. PROBLEM I", "Idem  aliter.", "GENERAL SCHOLIUM.", "Hypotheses.", "Definitio Fluidi.", "RULE", "Phænomena I", "Prop. III", "Chapter I", "", None]
    got = one(spark, [(x,) for x in lines], "s string", headings.heading(F.col("s")))
    assert [g[0] and tuple(g[0]) for g in got] == [
        ("lemma", "II"), ("lemma", "XIV"), ("prop", "III"), ("prop", "IV"), ("scholium-like", None), ("scholium-like", None), ("hypotheses-group", None), ("def", None), None, ("phaenomenon", "I"), None, None, None, None,
    ]
    got = one(spark, [("Cor. 2. Hinc",), ("Corol. IV et",), ("Hypoth. 2. x",), ("Cas. I. Si",), ("Cor. 2.",), ("Corpus 2 x",)], "s string", headings.beginning(F.col("s"))["kind"])
    assert [g[0] for g in got] == ["corol", "corol", None, "case", None, None]
    got = one(spark, [("ϛ΄.",), ("ή.",), ("",), ("PROBLEMA",), ("αβγδ",), (None,)], "s string", headings.bare_numeral(F.col("s")))
    assert [g[0] for g in got] == [True, True, True, False, False, False]


def test_greek_combo(spark):
    rows = [(["aorist", "indicative", "middle", "passive", "first-person", "plural"],), (["neuter", "dative", "dual", "superlative"],), ([],)]
    assert [g[0] for g in one(spark, rows, "t array<string>", tags.greek_combo(F.col("t")))] == ["aor ind mp 1 pl", "dat du n sup", ""]


def test_dictionary_lookups(spark):
    e = spark.createDataFrame([("amo", "a1", "verb", True, 0), ("amo", "a2", "noun", False, 1), ("iam", "i1", "adv", False, 0), ("iam", "i2", "adv", True, 1)], "headword string, entry string, class string, main boolean, at int")
    lemmas = spark.createDataFrame([("amor", "verb"), ("amor", None), ("iam", "noun"), ("nil", "adv")], "lemma string, wanted string")
    spellings = F.array(F.col("lemma"), F.expr("left(lemma, length(lemma) - 1)"), F.concat(F.expr("left(lemma, length(lemma) - 1)"), F.lit("")))
    got = lexicon.lookup_all(lemmas, F.array_distinct(spellings), e.withColumn("headword", F.regexp_replace("headword", "o$", "o")))
    assert sorted(map(tuple, got.collect())) == sorted([("amor", "a1", 0), ("amor", "a1", 0), ("amor", "a2", 1), ("iam", "i1", 0), ("iam", "i2", 1)])
    wanted = spark.createDataFrame([("amo", "noun"), ("amo", "prep"), ("iam", "noun"), ("iam", "adv"), ("x", "adv")], "headword string, pos string")
    assert sorted(map(tuple, lexicon.pick_headword(wanted, e).collect())) == [("amo", "noun", "a2"), ("amo", "prep", "a1"), ("iam", "adv", "i1"), ("iam", "noun", "i2")]


def test_accounting_and_order(spark):
    long = "x" * 20 + " a paragraph that is long enough to be looked for in the output of its work " + "y" * 20
    p = spark.createDataFrame([("w", 1, long), ("w", 2, "short"), ("v", 3, long), ("w", 4, "RUNNING TITLE " * 4), ("w", 5, "Note: " + long)], "work string, id int, text string")
    out = spark.createDataFrame([("w", "before " + long.replace(" ", "\n ") + " after"), ("v", "other")], "work string, text string")
    got = {r.id: r.verdict for r in quality.probe_accounting(p, out, [("RUNNING TITLE " * 4).strip()], ["Note:"]).collect()}
    assert got == {1: "found", 2: "short", 3: "missing", 4: "allowed", 5: "allowed"}
    rows = spark.createDataFrame([("a", 0, 1), ("a", 1, 3), ("a", 2, 2), ("b", 0, 1), ("b", 1, 2)], "g string, at int, n int")
    assert {r.g: r.reordered for r in quality.reordered(rows, "g", "at", "n").collect()} == {"a": 1, "b": 0}
    assert {r.g: r.contiguous for r in quality.contiguous(rows, "g", "n").collect()} == {"a": True, "b": True}


def test_probe_accounting_of_sharp_s(spark, tmp_path):
    """A line of 39 characters in capitals is still short, one of 40 isn't."""
    line = "In enßie beachein schenber en erlichzu."
    docs = [(5, f"{line}\n{line}x\n{line[:-3]}ŉǰ"), (6, line), (10, None)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'de' AS lang", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, catalog.queries()["probe_accounting"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(catalog.oracle_sql()["probe_accounting"]).fetchall())
    assert got == [(5, 0, "short"), (5, 1, "missing"), (5, 2, "short"), (6, 0, "short")]


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<TEI><entryFree id='n1' key='amo' type='hapax'><sense>love</sense><sense> like </sense></entryFree><entryFree id='n2' key='amo' type='main'><sense>x</sense></entryFree><entryFree id='n3'/></TEI>")
    e = corpus.read_dictionary(spark, str(tmp_path / "d.xml"))
    assert sorted((r.headword, r.entry, r.main, tuple(r.senses)) for r in e.collect()) == [("amo", "n1", False, ("love", "like")), ("amo", "n2", True, ("x",))]
    assert [tuple(r) for r in corpus.headwords(e).collect()] == [("amo", "n2")]


def test_ladder(spark, sf, tmp_path):
    """Every unit once, sections of a work in order, coverage and pool as the single operators have them; written and read again."""
    rungs = catalog.queries()["ladder_build"](spark, sf)
    corpus.write_ladder(rungs, str(tmp_path / "ladder"))
    back = corpus.read_ladder(spark, str(tmp_path / "ladder"), "en")
    got = back.collect()
    assert [r.pos for r in got] == list(range(len(got))) and len({(r.work, r.unit) for r in got}) == len(got)
    turns = {r.conv_id for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").collect()}
    assert {r.work for r in got} == turns
    last = {}
    for r in got:
        assert r.section >= last.get(r.work, 0) and 0 <= r.cov3 <= r.cov1 <= 1
        last[r.work] = r.section
    pools = [r.pool for r in got]
    assert pools == sorted(pools) and pools[0] >= 30
    found = course.check_ladder(back).collect()
    assert {r.check for r in found} <= {"cliff"} and {r.level for r in found} <= {"warn", "error"}
    worse = spark.createDataFrame([("en", 0, 9, 0.9), ("en", 1, 8, 0.9), ("en", 2, 9, 0.9), ("en", 3, 9, 0.5)], "lang string, pos int, pool int, cov3 double")
    assert sorted((r.level, r.check, r.message) for r in course.check_ladder(worse).collect()) == [("error", "cliff", "en 3"), ("error", "pool", "en 1")]


def test_shard_names(spark):
    names = ["aux", "con", "ab", "_", "lpt1", "zz"]
    stem = lexicon.shard_stem(F.col("s"))
    got = one(spark, [(x,) for x in names], "s string", stem, lexicon.shard_prefix(stem))
    assert [g[1] for g in got] == names and got[0][0] != "aux" and got[2][0] == "ab"


def test_orders(spark):
    a = spark.createDataFrame([("Plato", -427), ("Anon", None), ("Homer", -750), ("Zeno", -427)], "name string, year int")
    assert [r.name for r in library.by_year(a, "year", "name").collect()] == ["Homer", "Plato", "Zeno", "Anon"]


def test_sampler():
    assert drills.picks(42, 3, 5) == [0, 1, 2]
    got = drills.picks(42, 1000, 5)
    assert len(got) == 5 and got == sorted(set(got)) and got == drills.picks(42, 1000, 5)
