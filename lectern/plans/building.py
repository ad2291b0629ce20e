"""Queries over the building of a library: labels, headings, catalogue numbers, dictionary lookups, checks of what was built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import headings, labels, tags
from lectern.functions.drills import picks
from lectern.functions.text import upper
from lectern.operators import course, lexicon, library, quality
from lectern.sources import sql
from lectern.sources.tables import passages, table

QUERIES, SQL = {}, {}


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


def _pick(names: list[str], at: str) -> str:
    return f"{names}[(({at}) % {len(names)} + 1)::INT]"


def _of(names: list[str], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))


IDS = ["book-%", "actio-2-book-%", "elements-prop1-%", "book-1-ch-%", "act-1-scene-%", "act-%", "inferno-canto-%", "sonnet-%", "book-2-lemma-%", "problem-%", "speech-%", "actio-%", "book-1-sec-P%", "book-1-sec-M%", "preface-%"]
SHORT = ["Book", "Book", "Proposition", "Chapter", "Scene", "Act", "Canto", "Sonnet", "Lemma", "Problem", "Speech", "Actio", "Prose", "Metre", "§"]


@query(f"""WITH d AS (SELECT p_partkey, p_size, {_pick(SHORT, 'p_partkey')} AS kind, p_partkey % 4 = 0 AS bare, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS heading, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS title, p_partkey % 8 = 0 AS grp FROM part),
    s AS (SELECT *, CASE WHEN bare AND kind NOT IN ('Prose', 'Metre') THEN coalesce(CASE WHEN grp THEN title END, heading, 'Praefatio') ELSE kind || ' ' || p_size END AS short FROM d)
    SELECT p_partkey, short, short || coalesce(' · ' || title, '') AS "full" FROM s""")
def division_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as divisions of all id shapes, some without a number, heading or title."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(
        "p_partkey", F.replace(_of(IDS, k), F.lit("%"), F.col("p_size").cast("string")).alias("id"), F.when(k % 4 > 0, F.col("p_size").cast("string")).alias("number"),
        F.when(k % 3 > 0, F.col("p_type")).alias("heading"), F.when(k % 5 > 0, F.col("p_brand")).alias("title"), F.when(k % 8 == 0, 2).otherwise(0).alias("children"),
    )
    short = labels.short_label(F.col("id"), F.col("number"), F.col("heading"), F.col("title"), F.col("children"))
    return d.withColumn("short", short).select("p_partkey", "short", labels.full_label(F.col("short"), F.col("title")).alias("full"))


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 119 + 1 AS q, nullif(o_custkey % 13, 0) AS a, o_orderkey % 2 = 1 AS en, CASE o_orderkey % 7 WHEN 0 THEN 'I' WHEN 1 THEN 'II' END AS app FROM orders),
    l AS (SELECT *, CASE WHEN en THEN CASE WHEN a IS NULL THEN 'Only Article' ELSE 'Article ' || {sql.roman('a')} END ELSE CASE WHEN a IS NULL THEN 'Articulus unicus' ELSE 'Articulus ' || {sql.roman('a')} END END AS articulus,
      CASE WHEN app IS NULL THEN 'Quaestio ' || {sql.roman('q')} ELSE 'Appendix ' || app || ' · Quaestio ' || {sql.roman('q % 3 + 1')} END AS question FROM o)
    SELECT o_orderkey, articulus, question, 'PRIMA PARS · ' || upper(CASE WHEN en THEN replace(question, 'Quaestio', 'Question') ELSE question END) || ' · ' || upper(articulus) AS crumb,
      CASE WHEN en THEN coalesce('Reply to Objection ' || a, 'Reply to the Objections') WHEN a IS NULL THEN 'Ad obiectiones' ELSE 'Ad ' || {labels.REPLIES}[a] END AS reply FROM l""")
def reader_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles: what stands above them and before their replies, in Latin and English."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (k % 119 + 1).alias("q"), F.nullif(F.col("o_custkey") % 13, F.lit(0)).alias("a"), (k % 2 == 1).alias("en"), F.when(k % 7 == 0, "I").when(k % 7 == 1, "II").alias("app"),
    )
    q, a, en, app = (F.col(c) for c in ("q", "a", "en", "app"))
    return o.select(
        "o_orderkey", labels.articulus_label(a, en).alias("articulus"), labels.question_label(q, app, q % 3 + 1).alias("question"),
        labels.crumb(F.lit("Prima Pars"), q, a, app, q % 3 + 1, en).alias("crumb"), labels.reply_label(a, en).alias("reply"),
    )


LINES = ["LEMMA %", "Prop. %. Theor. I.", "Def. %.", "LAW %", "Corol. %.", "RULE %.", "Phænomenon %", "HYPOTHESIS %.", "Hypotheses.", "Scholium Generale.", "Hypothesis.", "Definitio Fluidi.", "Cor. %. text", "Chapter %", ""]
KINDS = ["lemma", "prop", "def", "law", "corol", "rule", "phaenomenon", "hypoth", "hypotheses-group", "scholium-like", "hypoth", "def", None, None, None]
_KINDS = "[" + ", ".join("NULL" if k is None else f"'{k}'" for k in KINDS) + "]"


@query(f"""WITH l AS (SELECT p_partkey, p_partkey % {len(LINES)} AS ix, {sql.roman('p_size')} AS n FROM part)
    SELECT p_partkey, ({_KINDS})[ix + 1] AS kind, CASE WHEN ix < 8 THEN n END AS number, CASE WHEN ix = 12 THEN 'corol' END AS begins FROM l""")
def heading_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.replace(_of(LINES, F.col("p_partkey")), F.lit("%"), labels.roman(F.col("p_size")))
    p = table(spark, sf_dir, "part").select("p_partkey", line.alias("line")).withColumn("h", headings.heading(F.col("line")))
    return p.select("p_partkey", F.col("h.kind").alias("kind"), F.col("h.number").alias("number"), headings.beginning(F.col("line"))["kind"].alias("begins"))


@query("""WITH c AS (SELECT c_custkey, lpad(c_nationkey::VARCHAR, 4, '0') AS a, lpad((c_custkey % 40)::VARCHAR, 3, '0') AS w, c_custkey % 3 AS k FROM customer)
    SELECT c_custkey, CASE WHEN k > 0 THEN a END AS urn_author, CASE WHEN k > 0 THEN w END AS urn_work, CASE WHEN k < 2 THEN a END AS file_author, CASE WHEN k < 2 THEN w END AS file_work,
      'data/w' || c_nationkey || '/about.json' AS path FROM c JOIN customer USING (c_custkey)""")
def catalogue_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of texts and file names, some of which have none; paths of a work's files."""
    k = F.col("c_custkey") % 3
    a, w = F.lpad(F.col("c_nationkey").cast("string"), 4, "0"), F.lpad((F.col("c_custkey") % 40).cast("string"), 3, "0")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.when(k > 0, F.concat(F.lit("see urn:cts:greekLit:tlg"), a, F.lit(".tlg"), w, F.lit(".x"))).otherwise("no urn:cts:greekLit here").alias("text"),
        F.concat(F.col("c_name"), F.lit(" ("), a, F.lit(") - Title ("), w, F.when(k < 2, ").xml").otherwise(").txt")).alias("file"),
    )
    c = c.withColumn("u", labels.catalogue_numbers(F.col("text"))).withColumn("f", labels.file_numbers(F.col("file")))
    path = labels.asset_path(F.lit("data/"), F.concat(F.lit("w"), F.col("c_nationkey").cast("string")), F.lit("/about.json"))
    return c.select("c_custkey", F.col("u.author").alias("urn_author"), F.col("u.work").alias("urn_work"), F.col("f.author").alias("file_author"), F.col("f.work").alias("file_work"), path.alias("path"))


CELLS = [["aorist", "indicative", "active", "third-person", "singular"], ["middle", "passive", "present", "participle", "genitive", "plural", "feminine"], ["comparative", "dual"], ["passive", "perfect", "aorist"], ["odd"]]
COMBOS = ["aor ind act 3 sg", "pres ptcp mp gen pl f", "du comp", "perf pass", ""]


@query(f"SELECT p_partkey, {_pick(COMBOS, 'p_partkey')} AS combo FROM part")
def greek_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*(F.array(*map(F.lit, c)) for c in CELLS))
    return table(spark, sf_dir, "part").select("p_partkey", tags.greek_combo(F.element_at(cells, (F.col("p_partkey") % len(CELLS) + 1).cast("int"))).alias("combo"))


_ENTRIES = "e AS (SELECT split_part(p_name, ' ', 2) AS headword, p_partkey AS entry, p_type AS class, p_size > 40 AS main FROM part)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(headword, entry, class, main, at): parts as dictionary entries, their second word the headword."""
    p = table(spark, sf_dir, "part")
    return p.select(F.element_at(F.split("p_name", " "), 2).alias("headword"), F.col("p_partkey").alias("entry"), F.col("p_type").alias("class"), (F.col("p_size") > 40).alias("main"), F.col("p_partkey").alias("at"))


_WANTED = "w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS lemma, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NONE' ELSE p_type END AS wanted FROM part)"


@query(f"""WITH {_ENTRIES}, {_WANTED}, h AS (SELECT lemma, wanted, entry, coalesce(class = wanted, false) AS fits FROM w JOIN e ON headword = lemma),
    a AS (SELECT *, max(fits::INT) OVER (PARTITION BY lemma, wanted) AS hits FROM h) SELECT lemma, count(*) AS n, sum(entry)::BIGINT AS entries FROM a WHERE fits OR hits = 0 GROUP BY lemma""")
def class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a headword by class; a spelling that no entry has is tried first."""
    size, p = F.col("p_size"), table(spark, sf_dir, "part")
    wanted = F.when(size % 4 == 0, None).when(size % 4 == 1, "NONE").otherwise(F.col("p_type"))
    lemmas = p.select(F.element_at(F.split("p_name", " "), 2).alias("lemma"), wanted.alias("wanted")).distinct()
    got = lexicon.lookup_all(lemmas, F.array(F.concat("lemma", F.lit("j")), F.col("lemma")), entries(spark, sf_dir).drop("main"))
    return got.groupBy("lemma").agg(F.count(F.lit(1)).alias("n"), F.sum("entry").alias("entries"))


@query(f"""WITH {_ENTRIES}, w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS headword, p_type AS pos FROM part UNION SELECT split_part(p_name, ' ', 2), 'NONE' FROM part)
    SELECT headword, pos, first(entry ORDER BY NOT (class = pos), CASE WHEN class = pos THEN false ELSE NOT main END, entry) AS entry FROM w JOIN e USING (headword) GROUP BY headword, pos""")
def headword_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    wanted = e.select("headword", F.col("class").alias("pos")).unionByName(e.select("headword", F.lit("NONE").alias("pos"))).distinct()
    return lexicon.pick_headword(wanted, e)


@query(f"""WITH {_ENTRIES}, k AS (SELECT headword FROM e WHERE class = 'ECONOMY' UNION SELECT headword FROM e WHERE main), c AS (SELECT DISTINCT headword AS key, class AS signature FROM e),
    n AS (SELECT headword AS key, count(*) AS n FROM e GROUP BY 1)
    SELECT signature, sum(n)::BIGINT AS weight FROM c JOIN n USING (key) WHERE key IN (SELECT headword FROM k) GROUP BY signature""")
def gated_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback analyses of headwords that one of two dictionaries knows, and the weight of what they look like."""
    e = entries(spark, sf_dir)
    known = lexicon.gated(e, e.where("class = 'ECONOMY'").select("headword"), e.where("main").select("headword"), "headword")
    counts = e.groupBy(F.col("headword").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return lexicon.signature_weights(known.select(F.col("headword").alias("key"), F.col("class").alias("signature")), counts)


@query("""WITH w AS (SELECT c_custkey AS work, c_nationkey AS author, c_custkey % 7 AS number FROM customer), o AS (SELECT * FROM w WHERE work % 10 = 0),
    k AS (SELECT work, CASE WHEN work % 20 = 0 THEN NULL WHEN work % 10 = 0 THEN 3 ELSE author END AS author, CASE WHEN work % 20 = 0 THEN NULL WHEN work % 10 = 0 THEN 2 ELSE number END AS number FROM w)
    SELECT k.work, s_suppkey AS file FROM k JOIN supplier ON s_nationkey = k.author AND s_suppkey % 7 = k.number""")
def work_file_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as works, suppliers as files; every tenth work has an override, every twentieth none to match."""
    works = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work"), F.col("c_nationkey").cast("long").alias("author"), (F.col("c_custkey") % 7).alias("number"))
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").cast("long").alias("author"), (F.col("s_suppkey") % 7).alias("number"))
    there = F.col("work") % 20 > 0
    fixed = works.where("work % 10 = 0").select("work", F.when(there, 3).cast("long").alias("author"), F.when(there, 2).cast("long").alias("number"))
    return lexicon.work_files(works, files, fixed)


@query("""WITH r AS (SELECT o_custkey AS work, o_orderpriority AS lexeme, o_orderkey % 50 AS key, o_orderkey % 3 AS rank FROM orders)
    SELECT work, lexeme, count(DISTINCT key) AS forms FROM r WHERE rank = 0 GROUP BY work, lexeme""")
def lexeme_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return lexicon.form_counts(o.select(F.col("o_custkey").alias("work"), F.col("o_orderpriority").alias("lexeme"), (F.col("o_orderkey") % 50).alias("key"), (F.col("o_orderkey") % 3).alias("rank")))


_POS, _TAGS = ["ECONOMY", "STANDARD", "PROMO"], ["widget", "bolt"]


@query(f"""WITH r AS (SELECT p_brand AS key, 'L' || (p_size % 12) AS lexeme, p_type || ' ' || split_part(p_name, ' ', 2) AS morph, p_size / 45.0 AS conf FROM part),
    x AS (SELECT 'L' || (c_nationkey % 11) AS lexeme, {_pick(_POS + ['ODD'], 'c_nationkey % 11')} AS pos, CASE WHEN c_nationkey % 11 <> 4 THEN 'g' END AS gloss FROM customer GROUP BY c_nationkey % 11),
    f AS (SELECT 'duplicate reading' AS "check" FROM r GROUP BY key, lexeme, morph HAVING count(*) > 1 UNION ALL SELECT 'unknown lexeme' FROM r WHERE lexeme NOT IN (SELECT lexeme FROM x)
      UNION ALL SELECT 'class of tags' FROM r WHERE split_part(morph, ' ', 1) NOT IN {tuple(_POS)} UNION ALL SELECT 'unknown tag' FROM r WHERE split_part(morph, ' ', 2) NOT IN {tuple(_TAGS)}
      UNION ALL SELECT 'confidence' FROM r WHERE conf <= 0 OR conf > 1 UNION ALL SELECT 'no gloss' FROM x WHERE gloss IS NULL UNION ALL SELECT 'class of lexeme' FROM x WHERE pos = 'ODD'
      UNION ALL SELECT 'not in its shard' FROM (SELECT DISTINCT lexeme FROM r) WHERE lexeme IN ('L0', 'L10', 'L11'))
    SELECT 'error' AS level, "check", count(*) AS n FROM f GROUP BY "check" """)
def bundle_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as readings, customers' nations as lexemes; all rules of a bundle."""
    p = table(spark, sf_dir, "part")
    size, nation = F.col("p_size"), F.col("c_nationkey") % 11
    lexeme = lambda n: F.concat(F.lit("L"), n.cast("int").cast("string"))
    readings = p.select(F.col("p_brand").alias("key"), lexeme(size % 12).alias("lexeme"), F.concat_ws(" ", "p_type", F.element_at(F.split("p_name", " "), 2)).alias("morph"), (size / 45.0).alias("conf"))
    lexemes = table(spark, sf_dir, "customer").select(nation.alias("n")).distinct().select(lexeme(F.col("n")).alias("lexeme"), _of([*_POS, "ODD"], F.col("n")).alias("pos"), F.when(F.col("n") != 4, "g").alias("gloss"))
    shards = lexemes.select("lexeme").where("lexeme not in ('L0', 'L10')")
    return quality.summary(quality.bundle_findings(readings, lexemes, shards, _POS, _TAGS))


@query("""SELECT 'n' || n_nationkey AS work, -1 AS pos, 'prooemium' AS id, 'Proœmium' AS label, '/prooemium' AS path FROM nation WHERE n_regionkey < 2
    UNION ALL SELECT 'n' || c_nationkey, c_custkey::INT, 'c' || c_custkey, c_name, '/part/c' || c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2 OR n_regionkey = 2)
    EXCEPT SELECT 'n' || n_nationkey, -1, 'prooemium', 'Proœmium', '/prooemium' FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)""")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as works with their customers as parts; those of two regions are Latin, of a third Greek, others not available."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") < 2, "la").when(F.col("n_regionkey") == 2, "grc").otherwise("xx").alias("lang"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = c.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("work"), "lang", F.col("c_custkey").cast("int").alias("pos"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"),
    )
    return library.top_level(library.available(parts, n.where("lang <> 'xx'"), ["la", "grc", "it"]))


@query("""WITH w AS (SELECT DISTINCT source || CASE doc_id // 7 % 4 WHEN 0 THEN '-grc' WHEN 1 THEN '-la' WHEN 2 THEN '-it' ELSE '-en' END AS work FROM documents)
    SELECT a.work, b.work AS sibling FROM w a JOIN w b ON b.work = regexp_replace(a.work, '-(grc|la|it)$', '') || '-en'""")
def english_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    w = d.select(F.concat("source", _of(["-grc", "-la", "-it", "-en"], F.floor(F.col("doc_id") / 7))).alias("work")).distinct()
    return w.withColumn("sibling", course.sibling_id(F.col("work"))).join(w.withColumnRenamed("work", "sibling"), "sibling", "left_semi")


@query(f"""WITH {sql.PASSAGES}, pl AS (SELECT work_id, pos, trim(regexp_replace(CASE WHEN work_id % 5 = 0 THEN upper(text) ELSE text END, '\\s+', ' ', 'g')) AS t FROM passages),
    o AS (SELECT work_id, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' ORDER BY pos) AS whole FROM passages GROUP BY work_id)
    SELECT pl.work_id AS work, pos AS id, CASE WHEN length(t) < 40 THEN 'short' WHEN t LIKE 'The%' THEN 'allowed'
      WHEN contains(whole, substr(t, greatest(0, length(t) // 2 - 30)::INT + 1, 60)) THEN 'found' ELSE 'missing' END AS verdict FROM pl JOIN o USING (work_id)""")
def probe_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against their documents; those of every fifth document are in capitals, and so not found."""
    p = passages(spark, sf_dir).select(F.col("work_id").alias("work"), "pos", "text")
    out = p.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t")).select("work", F.array_join("t.text", " ").alias("text"))
    lines = p.select("work", F.col("pos").alias("id"), F.when(F.col("work") % 5 == 0, upper(F.col("text"))).otherwise(F.col("text")).alias("text"))
    return quality.probe_accounting(lines, out, ["no such line"], ["The"])


MARKERS = ["&", "<", "[", "The", "ee"]


@query(f"""WITH m AS (SELECT source, unnest({MARKERS}) AS marker, text FROM documents)
    SELECT source, marker, sum((length(text) - length(replace(text, marker, ''))) // length(marker))::BIGINT AS n FROM m GROUP BY source, marker HAVING sum((length(text) - length(replace(text, marker, ''))) // length(marker)) > 0""")
def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.marker_counts(table(spark, sf_dir, "documents").select("source", "text"), "source", MARKERS)


@query(f"""WITH {sql.PASSAGES}, r AS (SELECT work_id, pos, length(text) AS n FROM passages), b AS (SELECT work_id, n < max(n) OVER (PARTITION BY work_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM r)
    SELECT work_id, count(*) FILTER (back) AS reordered FROM b GROUP BY work_id""")
def reordered_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of a document are shorter than one before them."""
    p = passages(spark, sf_dir).select("work_id", "pos", F.length("text").alias("n"))
    return quality.reordered(p, "work_id", "pos", "n")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS actual FROM orders GROUP BY 1) SELECT c_custkey AS key, c_nationkey::BIGINT AS expected, coalesce(actual, 0) AS actual,
    CASE WHEN coalesce(actual, 0) < c_nationkey THEN 'error' WHEN coalesce(actual, 0) > c_nationkey THEN 'warn' ELSE 'ok' END AS verdict FROM customer LEFT JOIN a ON k = c_custkey""")
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("expected"))
    return quality.expected(truth, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("""WITH f AS (SELECT conv_id, min(turn) AS start FROM conversations WHERE text LIKE 'Th%' AND turn > 0 GROUP BY conv_id)
    SELECT CASE WHEN turn >= start THEN conv_id + 1000000 ELSE conv_id END AS div, turn AS pos, text FROM conversations LEFT JOIN f USING (conv_id)""")
def misplaced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation from the first later one that begins with Th on belong to another."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("div"), F.col("turn").alias("pos"), "text")
    later = c.where("pos > 0")
    incipits = c.select("div").distinct().select("div", F.lit("Th").alias("incipit"), (F.col("div") + 1_000_000).alias("right"))
    whole = library.split_misplaced(later, incipits)
    return whole.unionByName(c.where("pos = 0"))


@query("""WITH RECURSIVE g(k, s) AS (SELECT 0, 42::BIGINT UNION ALL SELECT k + 1, ((s::DOUBLE * 1103515245 + 12345)::HUGEINT & 2147483647)::BIGINT FROM g WHERE k < 30),
    d AS (SELECT floor(s::DOUBLE / 2147483647 * (SELECT count(*) FROM customer))::BIGINT AS place, min(k) AS k FROM g WHERE k > 0 GROUP BY 1)
    SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT place FROM d ORDER BY k LIMIT 20)""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty customers by the seeded sampler; the places are the sample's size in number, whatever the table's."""
    c = table(spark, sf_dir, "customer")
    places = spark.createDataFrame([(k,) for k in picks(42, c.count(), 20)], "c_custkey long")
    return c.join(F.broadcast(places), "c_custkey", "left_semi").select("c_custkey", "c_name")
