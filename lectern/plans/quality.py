"""Queries over import checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import any_marker, citation_like, fold, word_tokens
from lectern.operators import quality
from lectern.sources import sql, tables
from lectern.sources.tables import table

QUERIES, SQL = {}, {}
MARKERS = ["license", "http", "<p", "copyright"]


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


@query(f"""WITH {sql.TOKENS}, c AS (SELECT conv_id, turn, unnest({sql.words(sql.fold('text'))}) AS key FROM conversations)
    SELECT key, count(*) AS n, min((conv_id, turn))[1] AS conv_id, min((conv_id, turn))[2] AS turn FROM c WHERE key NOT IN (SELECT key FROM tokens) GROUP BY key""")
def residual_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations that no document has."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(word_tokens(fold(F.col("text")))).alias("key"))
    r = quality.residual_words(c, tables.tokens(spark, sf_dir), "key", ["conv_id", "turn"])
    return r.select("key", "n", "first.conv_id", "first.turn")


_PLAIN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_PROBE = f"regexp_replace(substring({_PLAIN}, floor((length({_PLAIN}) - 60) / 2)::INT + 1, 60), '^\\S*\\s+', '')"


@query(f"""WITH p AS (SELECT item_id AS id, {_PROBE} AS probe FROM benchmark WHERE length(text) >= 40)
    SELECT id, EXISTS (SELECT 1 FROM documents WHERE contains(' ' || {_PLAIN}, ' ' || probe)) AS found FROM p WHERE len(string_split(probe, ' ')) > 3""")
def text_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the middle of each benchmark item turns up in some document."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return quality.accounting(b, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("""SELECT doc_id AS id, 'labels' AS source FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
    UNION ALL SELECT l_orderkey, 'lineitem' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def referential_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents that aren't English, and lines of orders that aren't open."""
    a = quality.violations(table(spark, sf_dir, "labels"), "doc_id", table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")
    b = quality.violations(table(spark, sf_dir, "lineitem"), "l_orderkey", table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), "o_orderkey")
    return a.select(F.col("doc_id").alias("id"), F.lit("labels").alias("source")).unionByName(b.select(F.col("l_orderkey").alias("id"), F.lit("lineitem").alias("source")))


_HAS = "CASE WHEN contains({0}, '{1}') THEN '{1}' END"


@query(f"""WITH m AS (SELECT doc_id, list_filter([{_HAS.format('lower(text)', 'license')}, {_HAS.format('lower(text)', 'http')}, {_HAS.format('text', '<p')}, {_HAS.format('lower(text)', 'copyright')}], lambda x: x IS NOT NULL) AS k FROM documents)
    SELECT doc_id, array_to_string(k, ',') AS markers FROM m WHERE len(k) > 0""")
def forbidden_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", any_marker(F.col("text"), MARKERS).alias("k")).where(F.size("k") > 0)
    return d.select("doc_id", F.array_join("k", ",").alias("markers"))


@query("""SELECT 'ERROR' AS level, 'empty' AS "check", count(*) AS n FROM documents WHERE trim(text) = '' HAVING count(*) > 0
    UNION ALL SELECT 'WARN', 'short', count(*) FROM documents WHERE length(text) < 100 HAVING count(*) > 0
    UNION ALL SELECT 'ERROR', 'length', count(*) FROM documents WHERE length(text) <> n_chars HAVING count(*) > 0
    UNION ALL SELECT 'WARN', 'leak', count(*) FROM documents WHERE contains(lower(text), 'license') HAVING count(*) > 0
    UNION ALL SELECT 'ERROR', 'duplicate', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) HAVING count(*) > 0""")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    who = F.col("doc_id")
    copies = d.groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return quality.summary(quality.findings([
        (d.where(F.trim("text") == ""), "ERROR", "empty", who), (d.where(F.length("text") < 100), "WARN", "short", who),
        (d.where(F.length("text") != F.col("n_chars")), "ERROR", "length", who), (d.where(F.contains(F.lower("text"), F.lit("license"))), "WARN", "leak", who),
        (copies, "ERROR", "duplicate", F.col("m")),
    ]))


@query("""SELECT conv_id, count(*) AS rows, bool_and(n = turn + CASE WHEN lo = 0 THEN 1 ELSE 0 END) AS contiguous
    FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS lo, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id""")
def contiguous_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are numbered from zero or one without a gap."""
    c = table(spark, sf_dir, "conversations").withColumn("lo", F.min("turn").over(Window.partitionBy("conv_id")))
    c = c.select("conv_id", (F.col("turn") + F.when(F.col("lo") == 0, 1).otherwise(0)).alias("number"))
    return quality.contiguous(c, "conv_id", "number")


@query("""WITH a AS (SELECT o_orderkey % 1000 AS k, count(*) AS n_in FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT l_orderkey % 1000 AS k, count(*) AS n_out FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'A' GROUP BY 1),
    j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM a FULL JOIN b ON a.k = b.k)
    SELECT *, CASE WHEN n_in = n_out THEN 'ok' WHEN n_out = 0 THEN 'missing' WHEN n_in = 0 THEN 'extra' WHEN n_out > n_in THEN 'duplicate' ELSE 'partial' END AS verdict FROM j""")
def source_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select((F.col("o_orderkey") % 1000).alias("k"))
    b = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_returnflag <> 'A'").select((F.col("l_orderkey") % 1000).alias("k"))
    return quality.missing_duplicate(a, b, ["k"])


@query("""SELECT conv_id, turn, text, witness FROM (SELECT conv_id, turn, text, NULL AS witness FROM conversations WHERE role = 'user'
    UNION ALL SELECT conv_id, turn, text, 'second' FROM conversations WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM conversations WHERE role = 'user'))""")
def lacuna_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first witness with the user's turns only; the second fills what it lacks."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    return quality.merge_absent(c.where("role = 'user'").drop("role"), c.drop("role"), ["conv_id", "turn"], "second")


@query("""WITH it AS (SELECT l_orderkey AS g, list(l_shipmode ORDER BY l_linenumber, l_shipmode) AS items FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linenumber AS l_shipmode FROM lineitem WHERE l_quantity > 10) GROUP BY 1),
    a AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS number FROM lineitem), m AS (SELECT g, max(number) AS most, count(*) AS n FROM a GROUP BY g),
    j AS (SELECT a.g, number, items, CASE WHEN items IS NULL THEN 'no list' WHEN NOT (len(items) = n OR len(items) BETWEEN most AND most + 3) AND len(items) < most THEN 'too short'
          WHEN NOT (len(items) = n OR len(items) BETWEEN most AND most + 3) THEN 'too long' WHEN number > len(items) THEN 'no item' END AS reason FROM a JOIN m ON m.g = a.g LEFT JOIN it ON it.g = a.g)
    SELECT g AS "group", number, CASE WHEN reason IS NULL THEN items[number] END AS title, reason FROM j""")
def title_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as articles, and the flags of an order's larger lines as its list of titles."""
    li = table(spark, sf_dir, "lineitem")
    a = li.select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("number")).distinct()
    s = F.struct(F.col("l_linenumber"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("t"))
    items = li.where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("group")).agg(F.array_sort(F.collect_list(s)).alias("s"))
    return quality.assign_titles(a, items.select("group", F.transform("s", lambda x: x["t"]).alias("items")))


_TURNS = f"w AS (SELECT conv_id, turn, role, list_distinct({sql.words(sql.fold('text'))}) AS w FROM conversations)"


@query(f"""WITH {_TURNS}, p AS (SELECT x.conv_id, x.turn AS a, y.turn AS b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS similarity
    FROM w x JOIN w y ON x.conv_id = y.conv_id AND y.turn BETWEEN x.turn - 5 AND x.turn + 5 AND x.role = 'user' AND y.role <> 'user' WHERE len(x.w) + len(y.w) > 0) SELECT * FROM p WHERE similarity >= 0.05""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of two speakers within five turns that share words."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(word_tokens(fold(F.col("text")))).alias("w"))
    return quality.band_pairs(c.where("role = 'user'"), c.where("role != 'user'"), "conv_id", "turn", "w", least=0.05)


@query()
def witness_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return quality.align(jaccard_pairs(spark, sf_dir), c.where("role = 'user'").select("conv_id", "turn"), "conv_id", "turn")


@query("""SELECT conv_id, CASE WHEN arg_min(role, turn) = arg_max(role, turn) THEN arg_min(role, turn) ELSE arg_min(role, turn) || '–' || arg_max(role, turn) END AS span FROM conversations WHERE trim(role) <> '' GROUP BY conv_id""")
def span_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.span(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("""SELECT source, lang, count(*) AS n, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS mean_chars, count(*) FILTER (trim(text) = '') AS empty FROM documents GROUP BY 1, 2""")
def part_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.part_stats(table(spark, sf_dir, "documents"), "source", "lang", "text")


@query("""SELECT p_partkey, coalesce(list_sum(list_transform(regexp_extract_all(g, '[A-Z][A-Za-z]*\\.'), lambda x: length(x))), 0) > 0.7 * length(g) AS citation_like
    FROM (SELECT p_partkey, replace(p_type, ' ', '. ') || '.' AS g FROM part)""")
def citation_like_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.concat(F.replace(F.col("p_type"), F.lit(" "), F.lit(". ")), F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", citation_like(g).alias("citation_like"))
