"""Queries over the corpus as a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.html import sanitise_html, unsafe
from lectern.functions.labels import citation, kind_label, roman, stage_for_pool
from lectern.functions.snippet import build_snippet
from lectern.functions.text import fold
from lectern.operators import library, search
from lectern.sources import sql, tables
from lectern.sources.tables import table

NEEDLE, RARE = "que la", "la mentré"
QUERIES, SQL = {}, {}


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


_RANKED = f"""SELECT doc_id, CASE WHEN contains(f, 'que la') THEN 0 WHEN contains(f, 'que') AND contains(f, 'la') THEN 1
    WHEN contains(f, 'que') OR contains(f, 'la') THEN 2 END AS rank FROM (SELECT doc_id, {sql.fold('text')} AS f FROM documents)"""


@query(f"SELECT doc_id, rank::INT AS rank FROM ({_RANKED}) WHERE rank IS NOT NULL ORDER BY rank, doc_id LIMIT 200")
def search_phrase_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("folded"))
    return search.search(docs, NEEDLE, [F.col("doc_id")]).select("doc_id", "rank")


@query(f"SELECT rank::INT AS rank, count(*) AS n FROM ({_RANKED}) WHERE rank IS NOT NULL GROUP BY rank")
def search_rank_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = search.ranked(table(spark, sf_dir, "documents").select(fold(F.col("text")).alias("folded")), NEEDLE)
    return docs.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {sql.PASSAGES}, h AS (SELECT *, {sql.fold('text')} AS f FROM passages),
    p AS (SELECT work_id, pos, text, instr(f, 'la mentre') - 1 AS k, length(text) AS n, length(f) AS m FROM h WHERE contains(f, 'la mentre')),
    s AS (SELECT *, floor(k / m * n + 0.5)::INT AS x FROM p),
    b AS (SELECT *, greatest(0, x - 70) AS lo, least(n, x + 9 + 90) AS hi FROM s)
    SELECT work_id, pos, CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(substring(text, lo + 1, hi - lo)) || CASE WHEN hi < n THEN '…' ELSE '' END AS snippet
    FROM b ORDER BY work_id, pos LIMIT 60""")
def search_tree_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scan(tables.passages(spark, sf_dir), RARE, ["work_id", "pos"]).select("work_id", "pos", "snippet")


@query()
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late materialisation: the 30 best hits first, then their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("folded"))
    best = search.search(docs, NEEDLE, [F.col("doc_id")], limit=30).select("doc_id", "rank")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(best), "doc_id")  # 30 rows
    return texts.select("doc_id", "rank", build_snippet(F.col("text"), NEEDLE).alias("s")).select("doc_id", "rank", "s.*")


@query(f"""WITH {sql.WORKS} SELECT e.edition, count(*) AS n, count(DISTINCT author) AS authors FROM works,
    (VALUES ('all'), ('en'), ('original')) e(edition)
    WHERE e.edition = 'all' OR (e.edition = 'en' AND lang = 'en') OR (e.edition = 'original' AND (lang <> 'en' OR translator IS NULL OR translator = ''))
    GROUP BY e.edition""")
def edition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.works(spark, sf_dir)
    flags = F.array(*(F.when(library.in_edition(e, F.col("lang"), F.col("translator")), F.lit(e)) for e in ("all", "en", "original")))
    per = w.select("author", F.explode(F.array_compact(flags)).alias("edition"))
    return per.groupBy("edition").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("authors"))


@query(f"""WITH {sql.TREE}, k AS (SELECT parent AS id, count(*) AS children FROM tree WHERE parent IS NOT NULL GROUP BY parent)
    SELECT root, tree.id, parent, depth, (row_number() OVER (PARTITION BY root ORDER BY path) - 1)::INT AS pre_order,
           coalesce(children, 0) AS children, coalesce(children, 0) = 0 AS is_leaf FROM tree LEFT JOIN k ON k.id = tree.id""")
def division_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.flatten(tables.tree(spark, sf_dir)).select("root", "id", "parent", "depth", "pre_order", "children", "is_leaf")


_GROUPS = "('c' || c_custkey)"


@query(f"""WITH {sql.TREE}, k AS (SELECT parent AS id, count(*) AS children FROM tree WHERE parent IS NOT NULL GROUP BY parent),
    f AS (SELECT tree.*, coalesce(children, 0) = 0 AS leaf, k.children FROM tree LEFT JOIN k ON k.id = tree.id),
    a AS (SELECT parent AS id, bool_and(leaf) AS all_leaves FROM f WHERE parent IS NOT NULL GROUP BY parent),
    g AS (SELECT f.id FROM f JOIN a ON a.id = f.id JOIN customer ON f.id = 'c' || c_custkey WHERE all_leaves AND c_mktsegment = 'BUILDING'),
    s AS (SELECT root, id, path FROM f WHERE id IN (SELECT id FROM g) OR (leaf AND (parent IS NULL OR parent NOT IN (SELECT id FROM g))))
    SELECT root, id, lag(id) OVER w AS prev, lead(id) OVER w AS next FROM s WINDOW w AS (PARTITION BY root ORDER BY path)""")
def navigable_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer of the BUILDING segment is titled as a consolidatable group; its orders are read as one page."""
    flat = library.flatten(tables.tree(spark, sf_dir))
    titles = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tid"))
    flat = flat.join(titles, flat["id"] == titles["tid"], "left")
    found = library.stops(flat, F.when(F.col("tid").isNotNull(), "Definitions II"))
    return library.neighbours(found, "root", [F.col("path")], "id").select("root", "id", "prev", "next")


@query("""SELECT conv_id AS work_id, turn AS pos, lag(turn) OVER w AS prev, lead(turn) OVER w AS next
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbors_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.neighbours(tables.sections(spark, sf_dir), "work_id", [F.col("pos")], "pos").select("work_id", "pos", "prev", "next")


@query("""WITH m AS (SELECT o_custkey AS work, (o_orderkey % 40)::BIGINT AS number FROM orders), x AS (SELECT work, max(number) AS most FROM m GROUP BY work),
    e AS (SELECT work, unnest(range(1, most + 1)) AS number FROM x)
    SELECT e.work, e.number FROM e ANTI JOIN (SELECT DISTINCT * FROM m) m ON m.work = e.work AND m.number = e.number""")
def gap_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work"), (F.col("o_orderkey") % 40).alias("number"))
    return search.missing_numbers(rows, "work", "number")


_ROMAN = "CASE WHEN o_custkey % 4 = 0 THEN 'I' WHEN o_custkey % 4 = 1 THEN 'I-II' WHEN o_custkey % 4 = 2 THEN 'II-II' ELSE 'III' END"


@query(f"""WITH l AS (SELECT {_ROMAN} AS part, (o_orderkey % 900 + 1) AS q, l_linenumber AS a, l_linestatus AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    art AS (SELECT DISTINCT part, q, a FROM l WHERE s = 'O'), que AS (SELECT DISTINCT part, q FROM art),
    r AS (SELECT DISTINCT part, q, a FROM l UNION ALL SELECT DISTINCT part, q, NULL FROM l)
    SELECT CASE WHEN r.a IS NULL THEN r.part || ', q.' || r.q ELSE r.part || ' q. ' || r.q || ', a ' || r.a END AS ref,
      CASE WHEN r.a IS NULL THEN r.part || ' q. ' || r.q ELSE r.part || ' q. ' || r.q || ' a. ' || r.a END AS citation,
      CASE WHEN r.a IS NULL AND que.q IS NOT NULL THEN 'question' WHEN art.a IS NOT NULL THEN 'article' ELSE 'gap' END AS target
    FROM r LEFT JOIN que ON que.part = r.part AND que.q = r.q LEFT JOIN art ON art.part = r.part AND art.q = r.q AND art.a = r.a
    UNION ALL SELECT DISTINCT r_name, NULL, 'none' FROM region""")
def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as readers type them, resolved to an article, a question, a gap, or nothing."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    code = F.element_at(F.array(*map(F.lit, ["I", "I-II", "II-II", "III"])), (F.col("o_custkey") % 4 + 1).cast("int"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        code.alias("part"), (F.col("o_orderkey") % 900 + 1).cast("int").alias("q"), F.col("l_linenumber").alias("a"), "l_linestatus"
    )
    known = rows.where("l_linestatus = 'O'").select("part", "q", "a")
    typed = rows.select("part", "q", "a").distinct().select(F.format_string("%s q. %d, a %d", "part", "q", "a").alias("ref"))
    typed = typed.unionByName(rows.select("part", "q").distinct().select(F.format_string("%s, q.%d", "part", "q").alias("ref")))
    typed = typed.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("ref")).distinct())
    return search.resolve(typed, known)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE starts_with(o_orderkey::VARCHAR, '12')""")
def question_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderkey").cast("string").startswith("12")).select("o_orderkey", "o_custkey")


_JOINED = "string_agg(text, ' · ' ORDER BY turn)"


@query(f"""SELECT conv_id AS work_id, {sql.fold('t')} AS text, substring(t, 1, 240) AS snippet FROM (SELECT conv_id, {_JOINED} AS t FROM conversations GROUP BY conv_id)""")
def search_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.sections(spark, sf_dir).groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    parts = parts.select("work_id", F.transform("p", lambda p: p["text"]).alias("parts"))
    return search.search_index(parts).select("work_id", "text", "snippet")


@query("""SELECT conv_id AS work_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.joined_text(tables.sections(spark, sf_dir), "work_id", "pos", "text")


@query("""WITH f AS (SELECT source, lang, min(doc_id) AS fst FROM documents GROUP BY source, lang),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fst, lang) AS n FROM f)
    SELECT source, count(*) AS works, CASE WHEN count(*) <= 3 THEN string_agg(lang, ', ' ORDER BY n) ELSE count(*) || ' works' END AS summary FROM r GROUP BY source""")
def title_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.title_summary(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query(f"""WITH {sql.EVIDENCE}, t AS (SELECT user_id, k, count(*) AS n, max((t, event_id)) AS l FROM ev WHERE type = 'click' GROUP BY user_id, k)
    SELECT user_id, k, l[1] AS added, row_number() OVER (PARTITION BY user_id ORDER BY l DESC, k)::INT AS place FROM t WHERE n % 2 = 1""")
def bookmark_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.toggled(tables.evidence(spark, sf_dir).where("type = 'click'"), "user_id", "k", ["at", "event_id"])


@query("""WITH w AS (SELECT DISTINCT p_type AS t FROM part), q AS (SELECT row_number() OVER (ORDER BY t) AS id, t AS text FROM w),
    n AS (SELECT p_partkey AS id, p_name AS text FROM part),
    qk AS (SELECT id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 2)) AS w FROM q),
    nk AS (SELECT id, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 2))) AS key FROM n),
    s AS (SELECT qk.id AS wanted, nk.id AS title, count(*) / any_value(len(qk.w)) AS share FROM (SELECT id, w, unnest(w) AS key FROM qk) qk JOIN nk USING (key) GROUP BY 1, 2)
    SELECT wanted, title, share FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY share DESC, title) AS r FROM s) WHERE r = 1 AND share >= 0.5""")
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part whose name has most words of a type: a curriculum's titles against a registry's."""
    part = table(spark, sf_dir, "part")
    types = part.select("p_type").distinct().orderBy("p_type")
    wanted = types.selectExpr("row_number() OVER (ORDER BY p_type) AS id", "p_type AS text")
    return search.title_matches(wanted, part.selectExpr("p_partkey AS id", "p_name AS text"), stop=[])


@query("""SELECT o_orderkey, 'I q. ' || (o_orderkey % 300) || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE ' a. ' || (o_custkey % 12) END AS citation,
    CASE o_custkey % 3 WHEN 0 THEN 'Book' WHEN 1 THEN 'Chapter' END AS kind,
    CASE WHEN o_custkey < 1000 THEN 'I' WHEN o_custkey < 2500 THEN 'II' WHEN o_custkey < 5000 THEN 'III' WHEN o_custkey < 10000 THEN 'IV' ELSE 'V' END AS stage FROM orders""")
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 12)
    ids = F.element_at(F.array(F.lit("book-4"), F.lit("book-4-ch-12A"), F.lit("sec-9")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", citation(F.lit("I"), F.col("o_orderkey") % 300, a).alias("citation"), kind_label(ids).alias("kind"), stage_for_pool(F.col("o_custkey")).alias("stage"))


@query(f"SELECT p_partkey, CASE WHEN n <= 0 THEN n::VARCHAR ELSE {sql.roman('n')} END AS roman FROM (SELECT p_partkey, p_partkey % 4000 - 5 AS n FROM part)")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", roman(F.col("p_partkey") % 4000 - 5).alias("roman"))


@query()
def html_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", unsafe(F.col("html")).alias("was_unsafe"), sanitise_html(F.col("html")).alias("html"))
    return p.withColumn("is_unsafe", unsafe(F.col("html")))
