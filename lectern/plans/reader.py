"""Queries of a reader's screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.ocr import contaminated, noise_line, repair
from lectern.operators import reader
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


@query("SELECT n_nationkey AS part, n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 = 2 AND r_regionkey = 1")
def part_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("part"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 4).alias("code"), F.col("n_regionkey").cast("string").alias("lang"))
    return reader.part_by_code(n, F.lit(2), "1").select("part", "name")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS q, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS a FROM lineitem),
    w AS (SELECT DISTINCT o_orderkey AS q, CASE o_custkey % 3 WHEN 0 THEN 'u' WHEN 1 THEN '2' ELSE 'x' END AS param FROM orders)
    SELECT w.q, param, EXISTS (SELECT 1 FROM a WHERE a.q = w.q AND ((param = 'u' AND a.a IS NULL) OR a.a = TRY_CAST(param AS INT))) AS found FROM w""")
def article_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("a"))
    p = F.element_at(F.array(F.lit("u"), F.lit("2"), F.lit("x")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return reader.find_article(a, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), p.alias("param")).distinct())


@query(f"WITH {sql.TOKENS} SELECT DISTINCT lang, key AS lemma, CASE WHEN length(key) > 8 THEN 'seen' ELSE 'known' END AS status FROM tokens WHERE lang = 'fr' AND contains(key, 'eau') AND length(key) > 8")
def vocabulary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.tokens(spark, sf_dir).select("lang", F.col("key").alias("lemma")).distinct().withColumn("status", F.when(F.length("lemma") > 8, "seen").otherwise("known"))
    return reader.vocabulary(w, "seen", "fr", "EAU")


@query("""WITH i AS (SELECT DISTINCT o_custkey AS work, (o_orderkey % 50) || CASE WHEN o_orderstatus = 'O' THEN '' ELSE lower(o_orderstatus) END AS id FROM orders)
    SELECT work, id, row_number() OVER (PARTITION BY work ORDER BY regexp_extract(id, '^(\\d+)', 1)::INT, regexp_extract(id, '^\\d*(.*)$', 1), id) AS place FROM i""")
def letter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ident = F.concat((F.col("o_orderkey") % 50).cast("string"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.lower("o_orderstatus")))
    return reader.letter_order(o.select(F.col("o_custkey").alias("work"), ident.alias("id")).distinct(), "work", "id")


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN true WHEN user_id % 3 = 1 THEN value < 10 OR event_type = 'view' ELSE false END AS highlight FROM events""")
def highlight_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.evidence(spark, sf_dir)
    mode = F.element_at(F.array(F.lit("all"), F.lit("new"), F.lit("none")), (F.col("user_id") % 3 + 1).cast("int"))
    status = F.when(F.col("type") == "view", None).when(F.col("value") < 10, "new").otherwise("seen")
    return e.select("event_id", reader.highlight(mode, status).alias("highlight"))


@query("""SELECT c_custkey AS reader, CASE WHEN c_acctbal > 0 AND c_nationkey < 5 THEN c_nationkey * 2 ELSE 99 END AS hints, CASE WHEN c_acctbal > 0 AND c_nationkey < 5 THEN 'p' || c_nationkey ELSE 'own' END AS marks FROM customer""")
def effective_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer with a balance follows the path; the first five nations are its stages."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("reader"), F.col("c_nationkey").alias("stage"), (F.col("c_acctbal") > 0).alias("following"), F.lit(99).alias("hints"), F.lit("own").alias("marks"))
    p = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("stage"), (F.col("n_nationkey") * 2).alias("hints"), F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("marks"))
    return reader.effective(c, p)


@query("""WITH k AS (SELECT DISTINCT p_brand AS key FROM part), w AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) ELSE p_brand || 'x' END AS wanted FROM part),
    l AS (SELECT lower(key) AS low, min(key) AS loose FROM k GROUP BY 1)
    SELECT wanted, coalesce(k.key, l.loose) AS key, CASE WHEN k.key IS NOT NULL THEN 'exact' WHEN l.loose IS NOT NULL THEN 'case' ELSE 'missing' END AS how FROM w LEFT JOIN k ON k.key = w.wanted LEFT JOIN l ON l.low = lower(w.wanted)""")
def selection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    w = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, F.upper("p_brand")).otherwise(F.concat("p_brand", F.lit("x")))
    return reader.selection(p.select(w.alias("wanted")).distinct(), p.select(F.col("p_brand").alias("key")).distinct())


@query("""WITH w AS (SELECT DISTINCT 'old ' || lower(c_mktsegment) || CASE WHEN c_nationkey < 5 THEN '' ELSE ' n' || c_nationkey END AS wanted FROM customer),
    r AS (SELECT DISTINCT lower(c_mktsegment) || CASE WHEN c_nationkey < 9 THEN '' ELSE ' n' || c_nationkey END AS name FROM customer WHERE c_nationkey BETWEEN 8 AND 12), p AS (SELECT name, row_number() OVER (ORDER BY name) AS pos FROM r),
    m AS (SELECT wanted, min(pos) AS id FROM w JOIN p ON contains(' ' || wanted || ' ', ' ' || name || ' ') OR contains(' ' || name || ' ', ' ' || wanted || ' ')
          OR (string_split(wanted, ' ')[-1] = string_split(name, ' ')[-1] AND length(string_split(name, ' ')[-1]) > 3) GROUP BY wanted) SELECT w.wanted, id FROM w LEFT JOIN m ON m.wanted = w.wanted""")
def author_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments, some with a nation behind them, as names of a curriculum and of a registry."""
    c = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("s"), F.col("c_nationkey").alias("k"))
    behind = lambda least: F.when(F.col("k") < least, "").otherwise(F.concat(F.lit(" n"), F.col("k").cast("string")))
    r = c.where("k BETWEEN 8 AND 12").select(F.concat("s", behind(9)).alias("name")).distinct().selectExpr("row_number() OVER (ORDER BY name) AS pos", "name")
    w = c.select(F.concat(F.lit("old "), "s", behind(5)).alias("wanted")).distinct()
    return reader.author_match(w, r.select(F.col("pos").alias("id"), "pos", "name"))


@query("""SELECT l_orderkey AS work, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS there, CASE WHEN count(*) FILTER (l_returnflag = 'N') = count(*) THEN 'present' WHEN count(*) FILTER (l_returnflag = 'N') > 0 THEN 'partial' ELSE 'missing' END AS bucket
    FROM lineitem GROUP BY 1""")
def presence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.presence(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work"), (F.col("l_returnflag") == "N").alias("found")), "work", "found")


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 6) AS auto, 'new' AS mark, true AS gloss FROM events""")
def settings_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties stand for stored settings; only one of the three fields is there."""
    e = table(spark, sf_dir, "events").select("event_id", F.replace("props", F.lit('"k"'), F.lit('"auto"')).alias("raw"))
    return reader.parsed_rows(e, "raw").drop("raw")


@query()
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.passages(spark, sf_dir)
    return p.select("work_id", "pos", noise_line(F.col("text")).alias("noise"), contaminated(F.col("text")).alias("contaminated"), repair(F.col("text")).alias("text"))
