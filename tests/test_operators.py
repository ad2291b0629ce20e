import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import course, evidence, lexicon, lexis, library, quality, search


def stops(spark, work, rows):
    return spark.createDataFrame([(work, k, t, w) for k, (t, w) in enumerate(rows)], "work string, pos int, top string, words long")


def packed(spark, rows):
    got = {r.pos: r.unit for r in course.pack_units(stops(spark, "w", rows)).collect()}
    sizes = collections.Counter(got.values())
    return [sizes[k] for k in sorted(sizes)]


def test_unit_packing(spark):
    assert packed(spark, [("b1", 600), ("b1", 600), ("b1", 600), ("b1", 1500), ("b2", 900), ("b2", 100)]) == [3, 1, 2]
    assert packed(spark, [(f"t{k}", 50) for k in range(40)]) == [16, 16, 8]
    assert packed(spark, [("a", 5000), ("a", 5000)]) == [1, 1]


def test_sections(spark):
    rows = stops(spark, "w", [("b1", 600), ("b1", 600), ("b1", 600), ("b1", 1500), ("b2", 900), ("b2", 100)])
    u = course.units(course.pack_units(rows), rows)
    got = course.sections(u, "work", "unit", "top", "mixed").orderBy("unit").collect()
    assert [(r.top, r.mixed, r.section) for r in got] == [("b1", False, 0), ("b1", False, 0), ("b2", False, 1)]


def test_core_words(spark):
    counts = spark.createDataFrame([("la", "roma", 5), ("la", "a", 3), ("la", "b", 2)], "lang string, lemma string, n long")
    got = lexis.core_words(counts, spark.createDataFrame([("la", "roma")], "lang string, lemma string"), "lang", "lemma", 1).collect()
    assert [(r.lemma, r.share) for r in got] == [("a", 0.3)]


def test_forecast(spark):
    tokens = spark.createDataFrame([("t", k) for k in ("amo", "roma", "puella", "xyzzy")], "id string, key string")
    classes = spark.createDataFrame([("amo", "known"), ("roma", "known"), ("puella", "met")], "key string, class string")
    r = lexis.forecast(tokens, classes, ["id"], "key").first()
    assert (r.tokens, r.unrec, r.coverage) == (4, 1, 2.5 / 4)


def test_division_and_work_coverage(spark):
    tokens = spark.createDataFrame([("t", "amat"), ("t", "puellam")], "id string, key string")
    lexicon_ = spark.createDataFrame([("amat", "amo", True), ("puellam", "puella", False)], "key string, lexeme string, known boolean")
    r = lexis.division_coverage(tokens, lexicon_, ["id"], "key").first()
    assert (r.tokens, r.known_tokens, r.lexemes, r.known_lexemes) == (2, 1, 2, 1)
    tokens = spark.createDataFrame([("w", "a"), ("w", "b"), ("w", "c"), ("w", "zz")], "id string, key string")
    lexicon_ = spark.createDataFrame([("a", "a", True), ("b", "b", True), ("c", "c", False)], "key string, lexeme string, known boolean")
    assert lexis.work_coverage(tokens, lexicon_, ["id"], "key").first().known_tokens == 2


def test_familiarity(spark):
    rows = [
        (None, 0, 0, 0, 10, None, "new"), ("known", 0, 0, 0, 10, None, "known"), ("ignored", 0, 0, 0, 10, None, "known"), ("seen", 4, 2, 0, 100, None, "likely-familiar"),
        ("seen", 4, 1, 0, 100, None, "met"), ("seen", 3, 3, 0, 100, None, "met"), ("seen", 5, 3, 1, 100, 99, "met"), ("seen", 5, 3, 1, 100, 50, "likely-familiar"), ("seen", 0, 0, 2, 100, 100, "met"),
    ]
    df = spark.createDataFrame(rows, "status string, enc int, days int, looks int, seen int, looked int, want string")
    hours = lambda c: F.timestamp_seconds(F.col(c) * 3600)
    got = df.select("want", lexis.familiarity(F.col("status"), F.col("enc"), F.col("days"), F.col("looks"), hours("seen"), hours("looked")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize("auto", [0, 2, 6])
def test_status_machine(spark, auto):
    rng = random.Random(auto)
    log = [(1, k, f"2024-01-{rng.randint(1, 9):02d} {rng.randint(0, 23):02d}:00:00", n, rng.choice(["lookup", "encounter", "encounter"]), rng.randrange(2)) for n in range(120) for k in [rng.randrange(4)]]
    df = spark.createDataFrame(log, "user_id long, k int, t string, event_id long, trigger string, division int").withColumn("at", F.to_timestamp("t")).drop("t")
    want = {}
    for k in range(4):
        status, met, looked = "new", set(), 0
        for _, _, t, _, trigger, division in sorted((x for x in log if x[1] == k), key=lambda x: (x[2], x[3])):
            if trigger == "lookup":
                looked += 1
                status = {"new": "seen", "known": "recognizing"}.get(status, status)
            elif (division, t[:10]) not in met:
                met.add((division, t[:10]))
                if auto and len(met) >= auto and status != "known":
                    status = "known"
        want[k] = (status, len(met), looked)
    got = {r.k: (r.status, r.encounters, r.lookups) for r in evidence.fold_status(df, auto).collect()}
    assert got == want


def test_path(spark):
    units = spark.createDataFrame([(f"d{k}", k, "I", 100) for k in range(5)], "unit string, pos int, stage string, words long")
    progress = spark.createDataFrame([(1, "d1", 1, "2024-01-01"), (1, "d4", 1, None)], "user_id long, unit string, seen long, f string").withColumn("finished_at", F.to_timestamp("f"))
    got = {r.unit: r.state for r in evidence.path_state(progress, units).collect()}
    assert got == {"d0": "later", "d1": "done", "d2": "next", "d3": "later", "d4": "started"}


def test_verdict(spark):
    df = spark.createDataFrame([(12, True, True, True), (12, True, False, True), (9, True, True, True), (12, True, None, True), (12, None, None, None)], "stops int, a boolean, b boolean, c boolean")
    got = [r[0] for r in df.select(evidence.verdict([F.col("a"), F.col("b"), F.col("c")], F.col("stops"))).collect()]
    assert got == ["ready-to-advance", "stay", "insufficient-data", "insufficient-data", "insufficient-data"]


def test_search_ranks(spark):
    df = spark.createDataFrame([(1, "quinque viis deum"), (2, "viis quinque"), (3, "quinque"), (4, "nihil")], "id int, folded string")
    ranks = {r.id: r["rank"] for r in search.search(df, "Quinque viis", [F.col("id")]).collect()}
    assert ranks == {1: 0, 2: 1, 3: 2}
    assert {r.id: r["rank"] for r in search.search(df, "QUINQUE", [F.col("id")]).collect()} == {1: 0, 2: 0, 3: 0}
    assert search.search(df, " ,. ", [F.col("id")]).count() == 0


def test_search_folds_query_and_text_alike(spark):
    df = spark.createDataFrame([(1, "한국 사람"), (2, "the ﬁnal word"), (3, "½ cup"), (4, "ΛΌΓΟΣ")], "id int, text string").withColumn("folded", text.fold(F.col("text")))
    hits = lambda q: [r.id for r in search.search(df, q, [F.col("id")]).collect()]
    assert [hits(q) for q in ("한국", "final", "ﬁnal", "1⁄2 cup", "λόγος")] == [[1], [2], [2], [3], [4]]


def test_readings(spark):
    forms = spark.createDataFrame([(0, "λόγος", "λογοσ", "L1"), (1, "λογός", "λογοσ", "L2")], "pos int, key string, folded string, lexeme string")
    tokens = spark.createDataFrame([("λόγος", "λογοσ"), ("λογος", "λογοσ"), ("και", "και")], "k string, f string")
    got = {r.k: (r.lexeme, r.tier) for r in lexis.readings(tokens, forms, "k", "f").collect()}
    assert got == {"λόγος": ("L1", 1), "λογος": ("L1", 2), "και": (None, None)}


def test_edition(spark):
    df = spark.createDataFrame([("en", None), ("en", "X"), ("la", "X"), ("en", "")], "lang string, tr string")
    flags = df.select(*(library.in_edition(e, F.col("lang"), F.col("tr")).alias(e) for e in ("all", "en", "original"))).collect()
    assert [tuple(r) for r in flags] == [(True, True, True), (True, True, False), (True, False, True), (True, True, True)]
    assert all(r.en or r.original for r in flags)


def test_codec(spark):
    rows = [("w", 0, 0, "amat", "amo", "verb 3 sg", 1.0), ("w", 0, 1, "amat", "amo2", "verb 3 sg", 0.8), ("w", 1, 0, "amo", "amo", "verb 1 sg", 1.0)]
    df = spark.createDataFrame(rows, "work string, pos int, rank int, key string, lexeme string, morph string, conf double")
    e = lexicon.encode(df)
    codes = {c.key: c.codes for c in e.first().codes}
    assert codes == {"amat": [0, 0, 100, 1, 0, 80], "amo": [0, 1, 100]}
    assert sorted(tuple(r) for r in lexicon.decode(e).select(*df.columns).collect()) == rows


def test_shards(spark):
    e = spark.createDataFrame([("a", 1), ("ab", 1), ("abc", 90), ("abcd", 90), ("abce", 90), ("zz", 5), ("", 1)], "key string, n int")
    got = {r.key: r.shard for r in lexicon.choose_shards(e, F.col("key"), F.col("n"), 200).collect()}
    assert got == {"a": "a", "ab": "ab", "abc": "abc", "abcd": "abcd", "abce": "abce", "zz": "zz", "": "_"}
    ids = spark.createDataFrame([("abce",), ("abq",), ("q",)], "plain string").withColumn("id", F.col("plain"))
    shards = spark.createDataFrame([("ab",), ("abce",), ("_",)], "shard string")
    assert {r.id: r.shard for r in lexicon.longest_prefix(ids, shards, "plain").collect()} == {"abce": "abce", "abq": "ab", "q": "_"}


def test_gloss_resolution(spark):
    e = spark.createDataFrame([("a", None, "b"), ("b", None, "c"), ("c", "gloss", None), ("x", None, "y"), ("y", None, "x"), ("z", None, "gone")], "entry string, gloss string, target string")
    got = {r.entry: (r.gloss, r.hops) for r in lexicon.resolve_glosses(e).collect()}
    assert got == {"a": ("gloss", 2), "b": ("gloss", 1), "c": ("gloss", 0), "x": (None, None), "y": (None, None), "z": (None, None)}


@pytest.mark.parametrize("least", [0.5, 0.7, 1.0])
def test_title_matches_against_brute_force(spark, least):
    rng = random.Random(5)
    words = ["the", *(f"word{k}" for k in range(9)), "common"]
    texts = lambda n: [(k, " ".join(rng.sample(words, rng.randint(1, 5)) + ["common"] * (rng.random() < 0.8))) for k in range(n)]
    wanted, titles = texts(25), texts(30)
    keys = lambda t: {w for w in t.split(" ") if len(w) > 2 and w != "the"}
    want = {}
    for i, t in wanted:
        k = keys(t)
        best = max(((len(k & keys(u)) / len(k), -j) for j, u in titles), default=None) if k else None
        if best and best[0] >= least:
            want[i] = (-best[1], round(best[0], 9))
    w, t = (spark.createDataFrame(x, "id int, text string") for x in (wanted, titles))
    assert {r.wanted: (r.title, round(r.share, 9)) for r in search.title_matches(w, t, ["the"], least).collect()} == want


def test_titles(spark):
    a = spark.createDataFrame([("q1", 2), ("q1", 3), ("q2", 1)], "group string, number int")
    lists = spark.createDataFrame([("q1", ["x", "utrum Y", "an Z"])], "group string, items array<string>")
    got = {(r.group, r.number): (r.title, r.reason) for r in quality.assign_titles(a, lists).collect()}
    assert got == {("q1", 2): ("utrum Y", None), ("q1", 3): ("an Z", None), ("q2", 1): (None, "no list")}


def test_greedy_order():
    counts = [("w1", "A", 0, "core", 8), ("w1", "A", 0, "x", 2), ("w1", "A", 1, "core", 9), ("w2", "B", 0, "x", 5), ("w2", "B", 0, "core", 5)]
    order = course.greedy_order(counts, {"core"}, set())
    assert order == [("w1", 0), ("w1", 1), ("w2", 0)]
    assert sorted(order) == sorted({(c[0], c[2]) for c in counts})


def brute_order(counts, core, names):
    """Every candidate scored anew at each step."""
    sections, author = collections.defaultdict(collections.Counter), {}
    for work, who, section, lemma, n in counts:
        sections[work, section][lemma] += n
        author[work] = who
    met, out, last, run = collections.Counter({c: 3 for c in core}), [], None, 0
    while len(out) < len(sections):
        best = None
        for work in author:
            rest = sorted(s for w, s in sections if w == work and (w, s) not in out)
            if not rest:
                continue
            c = sections[work, rest[0]]
            words = max(1, c.total())
            known = sum(n for k, n in c.items() if k is not None and (k in names or met[k] >= 3))
            new = sum(1 for k in c if k is not None and k not in names and not met[k])
            cost = min(0.12, 0.03 * run) if author[work] and author[work] == last else 0.0
            key = (-round(known / words - cost, 12), round(new / words * 100, 12), work)
            best = min(best or (key, rest[0]), (key, rest[0]))
        work, section = best[0][2], best[1]
        out.append((work, section))
        met.update(sections[work, section])
        run = run + 1 if author[work] and author[work] == last else 1
        last = author[work]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_greedy_order_against_brute_force(seed):
    rng = random.Random(seed)
    counts = [(f"w{w}", "AB "[w % 3].strip(), s, rng.choice([None, *"abcdefghij"]), rng.randint(1, 4)) for w in range(7) for s in range(rng.randint(1, 5)) for _ in range(rng.randint(1, 8))]
    assert course.greedy_order(counts, set("ab"), set("cd")) == brute_order(counts, set("ab"), set("cd"))


@pytest.mark.parametrize("seed", range(3))
def test_greedy_of_tables_against_brute_force(spark, seed):
    """Languages side by side, one of them null; core and names of one language only; lemmas that one section has."""
    rng = random.Random(seed)
    rows = [
        (lang, f"w{w}", "AB "[w % 3].strip(), s, rng.choice([None, *"abcdefghij", f"{w}-{s}-{n}"]), rng.randint(1, 4))
        for lang in ("la", "grc", None) for w in range(7) for s in range(rng.randint(1, 5)) for n in range(rng.randint(1, 8))
    ]
    df = spark.createDataFrame(rows, "lang string, work string, author string, section int, lemma string, n long")
    core, names = (spark.createDataFrame([("la", k) for k in some], "lang string, lemma string") for some in ("ab", "cd"))
    got = collections.defaultdict(list)
    for r in sorted(course.greedy(df.repartition(3), core, names).collect(), key=lambda r: r.place):
        got[r.lang].append((r.work, r.section))
    for lang in ("la", "grc", None):
        of = [r[1:] for r in rows if r[0] == lang]
        assert got[lang] == brute_order(of, *((set("ab"), set("cd")) if lang == "la" else (set(), set())))


def test_greedy_order_of_many_works():
    """Each step is a few changes, not a look at every work: 6,000 works of 3 sections, 1.6 million counts."""
    rng = random.Random(1)
    counts = [(w, "AB"[w % 2], s, k, 1) for w in range(6000) for s in range(3) for k in {int(rng.paretovariate(0.4)) % 200_000 for _ in range(100)}]
    began = time.process_time()
    order = course.greedy_order(counts, set(), set())
    assert time.process_time() - began < 45
    assert len(set(order)) == 18_000 and all(order.index((w, 0)) < order.index((w, 1)) < order.index((w, 2)) for w in range(50))


def test_easy_sentences(spark):
    """A verb is needed, names stand for core words, a text counts once, six candidates a work, three taken, ties by text."""
    core = spark.createDataFrame([("la", "a", 1), ("la", "b", 2), ("la", "c", 3), ("la", "v", 4)], "lang string, key string, rank int")
    names, verbs = (spark.createDataFrame([("la", k)], "lang string, key string") for k in "nv")
    texts = [("w1", ["a a v", "a b c", "n a v", "x a v", "a v", "b b v", "c c v", "a b v", "a c v", "a v a a a a a a a a", "b a v"]), ("w2", ["a a v", "v v v v v v v v v v"])]
    rows = [("la", w, k, t, t.split(" ")) for w, some in texts for k, t in enumerate(some)]
    got = course.easy_sentences(spark.createDataFrame(rows, "lang string, work string, pos int, text string, words array<string>"), core, names, verbs)
    assert sorted((r.work, r.text, round(r.score, 3)) for r in got.collect()) == [("w1", "a a v", 2.0), ("w1", "a b v", 2.333), ("w1", "a c v", 2.667)]


def test_sibling_id(spark):
    df = spark.createDataFrame([("iliad-grc",), ("inferno-it",), ("summa-en",), ("summa",)], "w string")
    assert [r[0] for r in df.select(course.sibling_id(F.col("w"))).collect()] == ["iliad-en", "inferno-en", "summa-en-en", "summa-en"]


def test_running_coverage_invariants(spark):
    rng = random.Random(1)
    counts = spark.createDataFrame([("c", p, f"l{rng.randrange(12)}", rng.randint(1, 3)) for p in range(20) for _ in range(1)], "course string, pos int, lemma string, n long")
    none = spark.createDataFrame([], "course string, lemma string")
    got = course.running_coverage(counts, none, none, "course", "pos", "lemma").orderBy("pos").collect()
    assert all(r.cov1 >= r.cov3 for r in got)
    pools = [r.pool for r in course.pool(counts, none, none, "course", "pos", "lemma").orderBy("pos").collect()]
    assert pools == sorted(pools)


def test_merge_absent_strict(spark):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "id int, t string")
    assert sorted(tuple(r) for r in quality.merge_absent(a, b, ["id"], "second").collect()) == [(1, "x", None), (2, "z", "second")]
    with pytest.raises(Exception, match="1"):
        quality.merge_absent(a, b, ["id"], "second", strict=True).collect()
