"""Queries over lexicon building. Parts are entries (name as lemma, type as class, size as senses), words of documents are forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import fold
from lectern.operators import lexicon
from lectern.sources import sql, tables
from lectern.sources.tables import table

QUERIES, SQL = {}, {}


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("entry"), F.col("p_brand").alias("lemma"), F.col("p_type").alias("pos"), F.col("p_size").alias("senses"), F.col("p_retailprice").alias("price"))


@query("""SELECT p_partkey AS entry, p_brand AS lemma, p_type AS pos, p_type || ':' || p_brand || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS lexeme_id
    FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part)""")
def homograph_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return lexicon.homographs(e, ["pos", "lemma"], "senses", "entry", "lemma").select("entry", "lemma", "pos", "lexeme_id")


@query("""SELECT l_partkey AS entry, sum(c)::BIGINT AS weight FROM (SELECT l_orderkey AS key, l_partkey FROM lineitem) JOIN (SELECT o_orderkey AS key, count(*) AS c FROM orders GROUP BY 1) USING (key) GROUP BY 1""")
def entry_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a key, its lines the candidate rows."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("entry"))
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return lexicon.entry_weights(c, n)


@query("""SELECT l_orderkey AS key, l_linenumber AS lexeme, l_shipmode AS morph, rank::INT AS rank, conf FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_returnflag || l_linestatus || l_linenumber) - 1 AS rank,
    CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 THEN 0.9 ELSE 0.8 END::DOUBLE AS conf FROM lineitem)""")
def reading_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its readings: heavier first, then by tags."""
    r = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("lexeme"), F.col("l_quantity").alias("w"), F.concat("l_returnflag", "l_linestatus").alias("morph"),
        F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("sortkey"),
    )
    return lexicon.best_first(r, "key", "w", "sortkey").select("key", "lexeme", "morph", "rank", "conf")


@query("""WITH r AS (SELECT l_orderkey AS key, l_suppkey AS lexeme, l_returnflag AS morph, max(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM lineitem GROUP BY 1, 2, 3),
    s AS (SELECT *, CASE WHEN score < 1 THEN 0.6 WHEN count(*) OVER (PARTITION BY key) = 1 THEN 1.0 ELSE 0.8 END::DOUBLE AS conf, (row_number() OVER (PARTITION BY key ORDER BY score DESC, lexeme, morph) - 1)::INT AS rank FROM r)
    SELECT * FROM s WHERE rank < 6""")
def scored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("lexeme"), F.col("l_returnflag").alias("morph"), (F.col("l_linestatus") == "O").alias("exact"), (F.col("l_discount") > 0.05).alias("direct")
    )
    return lexicon.scored(li, "key", "lexeme", "morph")


@query("""SELECT key, analysis, n, rank::INT AS rank FROM (SELECT l_suppkey AS key, l_partkey AS analysis, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS rank
    FROM lineitem GROUP BY 1, 2) WHERE rank <= 15""")
def top_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("analysis"))
    return lexicon.top_analyses(li, "key", "analysis")


@query("""SELECT p_type AS pos, p_brand AS lemma, arg_min(p_name, p_partkey) AS gloss FROM part WHERE p_name <> '' GROUP BY 1, 2""")
def gloss_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select(F.col("p_type").alias("pos"), F.col("p_brand").alias("lemma"), F.col("p_name").alias("gloss"), "p_partkey")
    return lexicon.first_gloss(e, ["pos", "lemma"], "gloss", "p_partkey")


@query("""WITH b AS (SELECT p_brand AS lemma, arg_min(p_partkey, (-p_size, p_partkey)) AS target, count(*) AS k FROM part WHERE p_size > 45 GROUP BY 1)
    SELECT p_partkey AS stub, target, CASE WHEN target IS NULL THEN 'synthetic' WHEN k = 1 THEN 'only' ELSE 'most senses' END AS kind FROM part LEFT JOIN b ON b.lemma = part.p_brand WHERE p_size <= 5""")
def form_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts are stubs of their brand, large ones the entries."""
    e = entries(spark, sf_dir)
    return lexicon.form_targets(e.where("senses <= 5").select(F.col("entry").alias("stub"), "lemma"), e.where("senses > 45").select("entry", "lemma", "senses"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS entry, CASE WHEN p_size > 30 THEN p_name END AS gloss, CASE WHEN p_size <= 30 THEN p_partkey // 2 END AS target FROM part),
    r AS (SELECT entry, gloss, target, 0 AS hops FROM e UNION ALL SELECT r.entry, e.gloss, e.target, hops + 1 FROM r JOIN e ON e.entry = r.target WHERE r.gloss IS NULL AND hops < 4)
    SELECT e.entry, g.gloss, g.hops FROM e LEFT JOIN (SELECT entry, gloss, hops FROM r WHERE gloss IS NOT NULL) g ON g.entry = e.entry""")
def gloss_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts up to size 30 are forms of the part of half their number."""
    p = table(spark, sf_dir, "part")
    big = F.col("p_size") > 30
    return lexicon.resolve_glosses(p.select(F.col("p_partkey").alias("entry"), F.when(big, F.col("p_name")).alias("gloss"), F.when(~big, F.floor(F.col("p_partkey") / 2)).alias("target")))


def word_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.vocabulary(spark, sf_dir).select("key").distinct()


_KEYS = f"{sql.TOKENS}, keys AS (SELECT DISTINCT key FROM tokens)"


@query(f"""WITH {sql.TOKENS}, keys AS (SELECT DISTINCT key FROM tokens WHERE lang = 'fr'), e AS (SELECT key, min(work_id) AS entry FROM tokens WHERE lang <> 'fr' GROUP BY key),
    v AS (SELECT key, unnest([key, translate(key, 'v', 'u'), translate(key, 'u', 'v')]) AS form, unnest([0, 1, 2]) AS p FROM keys),
    d AS (SELECT v.key, arg_min(e.entry, p) AS entry FROM v JOIN e ON e.key = v.form GROUP BY 1),
    c AS (SELECT key, CASE WHEN ends_with(key, 'que') AND length(key) > 5 THEN 'que' WHEN ends_with(key, 'ne') AND length(key) > 4 THEN 'ne' WHEN ends_with(key, 've') AND length(key) > 4 THEN 've' END AS s FROM keys WHERE key NOT IN (SELECT key FROM d)),
    b AS (SELECT key, s, left(key, length(key) - length(s)) AS base FROM c WHERE s IS NOT NULL),
    w AS (SELECT key, s, unnest([base, translate(base, 'v', 'u'), translate(base, 'u', 'v')]) AS form, unnest([0, 1, 2]) AS p FROM b)
    SELECT key, entry, NULL AS stripped FROM d UNION ALL SELECT w.key, arg_min(e.entry, p), any_value(s) FROM w JOIN e ON e.key = w.form GROUP BY w.key""")
def fallback_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French words in the lexicon of the other languages, by spelling, then without an enclitic."""
    t = tables.tokens(spark, sf_dir)
    e = t.where("lang != 'fr'").groupBy("key").agg(F.min("work_id").alias("entry"))
    return lexicon.pool(t.where("lang = 'fr'").select("key").distinct(), e)


@query(f"""WITH {_KEYS}, w AS (SELECT key FROM keys UNION SELECT string_split(lower(p_type), ' ')[1] FROM part WHERE p_size = 1),
    f AS (SELECT p_partkey AS entry, lower(p_name) AS head, unnest(list_concat([lower(p_name)], string_split(lower(p_type), ' '))) AS k FROM part)
    SELECT DISTINCT entry, head FROM f WHERE k IN (SELECT key FROM w)""")
def extract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that have a word of the corpus in their name or type: the dictionary extract a corpus needs."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), F.lower("p_name").alias("head"), F.split(F.lower("p_type"), " ").alias("forms"))
    wanted = word_keys(spark, sf_dir).unionByName(table(spark, sf_dir, "part").where("p_size = 1").select(F.element_at(F.split(F.lower("p_type"), " "), 1).alias("key")))
    return lexicon.semi_filter(p, wanted, "head", "forms").select("entry", "head")


@query(f"""WITH {_KEYS}, s2 AS (SELECT left(key, 2) AS p, count(*) * 40 AS s FROM keys WHERE length(key) >= 2 GROUP BY 1), s3 AS (SELECT left(key, 3) AS p, count(*) * 40 AS s FROM keys WHERE length(key) >= 3 GROUP BY 1)
    SELECT key, CASE WHEN length(key) < 2 THEN key WHEN s2.s <= 9000 OR length(key) < 3 THEN left(key, 2) WHEN s3.s <= 9000 OR length(key) < 4 THEN left(key, 3) ELSE left(key, 4) END AS shard
    FROM keys LEFT JOIN s2 ON s2.p = left(key, 2) AND length(key) >= 2 LEFT JOIN s3 ON s3.p = left(key, 3) AND length(key) >= 3""")
def shard_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.choose_shards(word_keys(spark, sf_dir), F.col("key"), F.lit(40), 9000)


@query(f"""WITH {_KEYS}, sh AS (SELECT DISTINCT left(key, 1 + length(key) % 4) AS p FROM keys WHERE length(key) BETWEEN 4 AND 6),
    c AS (SELECT k.key, p FROM keys k JOIN sh ON p = left(k.key, length(p)) AND length(p) <= length(k.key))
    SELECT k.key AS id, arg_max(c.p, length(c.p)) AS shard FROM keys k LEFT JOIN c ON c.key = k.key GROUP BY k.key""")
def longest_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = word_keys(spark, sf_dir)
    shards = k.where(F.length("key").between(4, 6)).select(F.expr("left(key, 1 + length(key) % 4)").alias("shard"))
    return lexicon.longest_prefix(k.select(F.col("key").alias("id"), F.col("key").alias("plain")), shards, "plain")


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as works, orders as keys, lines as readings."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("pos"), (F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")) - 1).alias("rank"), F.col("o_orderkey").cast("string").alias("key"),
        F.concat(F.lit("la:noun:"), F.col("l_suppkey").cast("string")).alias("lexeme"), F.concat("l_returnflag", F.lit(" "), "l_linestatus").alias("morph"), F.round(F.col("l_discount") + 0.5, 2).alias("conf"),
    )


_BUNDLE = """bundle AS (SELECT o_custkey AS work, o_orderkey AS pos, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1)::INT AS rank, o_orderkey::VARCHAR AS key,
    'la:noun:' || l_suppkey AS lexeme, l_returnflag || ' ' || l_linestatus AS morph, round(l_discount + 0.5, 2) AS conf FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"WITH {_BUNDLE} SELECT * FROM bundle")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle, encoded and decoded."""
    return lexicon.decode(lexicon.encode(bundle(spark, sf_dir)))


@query(f"WITH {_BUNDLE} SELECT work, count(DISTINCT lexeme) AS lexemes, count(DISTINCT morph) AS morphs, count(DISTINCT key) AS keys FROM bundle GROUP BY work")
def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lexicon.encode(bundle(spark, sf_dir))
    return e.select("work", F.size("lexemes").cast("long").alias("lexemes"), F.size("morphs").cast("long").alias("morphs"), F.size("codes").cast("long").alias("keys"))


@query(f"""WITH {sql.TOKENS}, t AS (SELECT work_id AS id, key, row_number() OVER () AS r FROM tokens), x AS (SELECT id, CASE key WHEN 'del' THEN ['de', 'el'] WHEN 'au' THEN ['a', 'le'] WHEN 'zum' THEN ['zu', 'dem'] ELSE [key] END AS w FROM t)
    SELECT id, key, count(*) AS n FROM (SELECT id, unnest(w) AS key FROM x) GROUP BY id, key""")
def elision_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table of contracted forms, applied to running words."""
    forms = spark.createDataFrame([("del", ["de", "el"]), ("au", ["a", "le"]), ("zum", ["zu", "dem"])], "form string, words array<string>")
    t = tables.tokens(spark, sf_dir).select(F.col("work_id").alias("id"), F.lit(0).alias("pos"), "key")
    return lexicon.elisions(t, forms).groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT lang, count(*) AS works, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS authors, round(sum(CASE WHEN n_chars > 1000 THEN n_chars ELSE 0 END) / sum(n_chars), 6) AS long_share FROM documents GROUP BY lang""")
def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("works"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("authors"),
        F.round(F.sum(F.when(F.col("n_chars") > 1000, F.col("n_chars")).otherwise(0)) / F.sum("n_chars"), 6).alias("long_share"),
    )
