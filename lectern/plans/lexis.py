"""Queries over running words. A folded word is a lexeme; the lexicon holds the words that three works have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.greek import transliterate
from lectern.functions.morph import describe
from lectern.functions.text import fold, sentences, word_tokens
from lectern.functions.tokenizer import tokens as tokenize
from lectern.operators import lexis
from lectern.sources import sql, tables
from lectern.sources.tables import table

QUERIES, SQL = {}, {}
CORE = 100


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


def keyed_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = lexis.surface_counts(tables.surfaces(spark, sf_dir), ["lang"], "surface", ["work_id", "pos"])
    return per.withColumn("key", fold(F.col("surface")))


_KEYED = f"{sql.SURFACES}, ks AS (SELECT *, {sql.fold('surface')} AS key FROM surfaces)"


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexis.names(keyed_surfaces(spark, sf_dir), ["lang"], "key", "surface")


_PER = "per AS (SELECT lang, key, surface, count(*) AS n, min((work_id, pos)) AS f, regexp_matches(surface, '^\\p{Lu}') AS cap FROM ks GROUP BY lang, key, surface)"
_NAMES = f"""{_KEYED}, {_PER}, tot AS (SELECT lang, key, sum(n) AS total, sum(CASE WHEN cap THEN n ELSE 0 END) AS capitals FROM per GROUP BY lang, key),
    best AS (SELECT lang, key, surface AS name, row_number() OVER (PARTITION BY lang, key ORDER BY n DESC, f) AS r FROM per WHERE cap),
    names AS (SELECT tot.lang, tot.key, name, total FROM tot JOIN best ON best.lang = tot.lang AND best.key = tot.key AND r = 1 WHERE capitals * 2 > total)"""


@query(f"WITH {_NAMES} SELECT lang, key, name, total::BIGINT AS n FROM names")
def proper_name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_keys(spark, sf_dir)


@query(f"WITH {sql.TOKENS} SELECT lang, count(*) AS tokens, count(DISTINCT key) AS forms, count(DISTINCT work_id) AS works, count(*) / count(DISTINCT key) AS per_form FROM tokens GROUP BY lang")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.counts(spark, sf_dir)
    running = c.groupBy("lang", "work_id").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("works"))
    forms = c.select("lang", "key").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("forms"))
    return running.join(forms, "lang").select("lang", "tokens", "forms", "works", (F.col("tokens") / F.col("forms")).alias("per_form"))


def core(spark: SparkSession, sf_dir: str, n: int = CORE) -> DataFrame:
    counts = lexis.lemma_counts(tables.counts(spark, sf_dir), ["lang"], "key")
    return lexis.core_words(counts, name_keys(spark, sf_dir).select("lang", "key"), "lang", "key", n)


_CORE = f"""{_NAMES}, {sql.TOKENS}, lt AS (SELECT lang, key, count(*) AS n FROM tokens GROUP BY lang, key),
    lw AS (SELECT lang, sum(n) AS words FROM lt GROUP BY lang),
    core AS (SELECT * FROM (SELECT lt.*, row_number() OVER (PARTITION BY lt.lang ORDER BY lt.n DESC, lt.key) AS rank FROM lt ANTI JOIN names ON names.lang = lt.lang AND names.key = lt.key) WHERE rank <= {CORE})"""


@query(f"WITH {_CORE} SELECT core.lang, key, n, rank::INT AS rank, n / words AS share FROM core JOIN lw ON lw.lang = core.lang")
def core_words_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core(spark, sf_dir)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, lexeme, known): words of three works at least; those that are core in some language count as known."""
    t = tables.counts(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("works")).where("works >= 3")
    known = core(spark, sf_dir).select("key").distinct().withColumn("core", F.lit(True))
    return t.join(known, "key", "left").select("key", F.col("key").alias("lexeme"), F.coalesce("core", F.lit(False)).alias("known"))


_LEXICON = f"""{_CORE}, lexicon AS (SELECT key, key IN (SELECT key FROM core) AS known FROM (SELECT DISTINCT work_id, key FROM tokens) GROUP BY key HAVING count(*) >= 3)"""


@query(f"""WITH {_LEXICON}, p AS (SELECT work_id, key, count(*) AS n FROM tokens GROUP BY work_id, key)
    SELECT work_id, sum(n)::BIGINT AS tokens, sum(CASE WHEN known THEN n ELSE 0 END)::BIGINT AS known_tokens, count(lexicon.key) AS lexemes,
           count(*) FILTER (known) AS known_lexemes FROM p LEFT JOIN lexicon ON lexicon.key = p.key GROUP BY work_id""")
def division_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexis.division_coverage(tables.counts(spark, sf_dir), lexicon(spark, sf_dir), ["work_id"], "key")


@query(f"""WITH {_LEXICON}, p AS (SELECT author, key, count(*) AS n FROM tokens GROUP BY author, key),
    s AS (SELECT author, sum(n) AS tokens, sum(CASE WHEN lexicon.key IS NOT NULL THEN n ELSE 0 END) AS recognized, count(*) AS forms,
          count(lexicon.key) AS recognized_forms, count(*) FILTER (known) AS known_forms FROM p LEFT JOIN lexicon ON lexicon.key = p.key GROUP BY author)
    SELECT author, tokens::BIGINT AS tokens, recognized::BIGINT AS recognized, forms, recognized_forms, known_forms,
           CASE WHEN recognized_forms > 0 THEN floor(recognized * known_forms / recognized_forms + 0.5)::BIGINT ELSE 0 END AS known_tokens FROM s""")
def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexis.work_coverage(tables.counts(spark, sf_dir), lexicon(spark, sf_dir), ["author"], "key")


@query(f"""WITH {_LEXICON} SELECT key, count(*) AS n, CASE WHEN regexp_matches(key, '[0-9]') THEN 'number' WHEN length(key) <= 2 THEN 'abbreviation' ELSE 'unknown' END AS reason
    FROM tokens WHERE key NOT IN (SELECT key FROM lexicon) GROUP BY key ORDER BY n DESC, key LIMIT 200""")
def unrecognised_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("key").rlike("[0-9]"), "number").when(F.length("key") <= 2, "abbreviation").otherwise("unknown")
    t = tables.counts(spark, sf_dir).groupBy("key").agg(F.sum("n").alias("n")).join(lexicon(spark, sf_dir), "key", "left_anti")
    return t.select("key", "n", reason.alias("reason")).orderBy(F.col("n").desc(), "key").limit(200)


@query(f"""WITH {_LEXICON}, cls AS (SELECT key, CASE WHEN known THEN 'known' WHEN length(key) <= 4 THEN 'likely-familiar' WHEN length(key) <= 7 THEN 'met' ELSE 'new' END AS c FROM lexicon),
    p AS (SELECT work_id, key, count(*) AS n FROM tokens GROUP BY work_id, key), j AS (SELECT p.*, c FROM p LEFT JOIN cls ON cls.key = p.key)
    SELECT work_id, sum(n)::BIGINT AS tokens, coalesce(sum(n) FILTER (c = 'known'), 0)::BIGINT AS known, coalesce(sum(n) FILTER (c = 'likely-familiar'), 0)::BIGINT AS likely,
      coalesce(sum(n) FILTER (c = 'met'), 0)::BIGINT AS met, coalesce(sum(n) FILTER (c = 'new'), 0)::BIGINT AS new, coalesce(sum(n) FILTER (c IS NULL), 0)::BIGINT AS unrec,
      sum(CASE WHEN c IN ('known', 'likely-familiar') THEN n WHEN c = 'met' THEN n * 0.5 ELSE 0 END)::DOUBLE / sum(n) AS coverage FROM j GROUP BY work_id""")
def unit_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes stand in for a reader's record: core words are known, short ones likely familiar, middling ones met."""
    n = F.length("key")
    c = F.when(F.col("known"), "known").when(n <= 4, "likely-familiar").when(n <= 7, "met").otherwise("new")
    return lexis.forecast(tables.counts(spark, sf_dir), lexicon(spark, sf_dir).select("key", c.alias("class")), ["work_id"], "key")


_RAW = "list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@query(f"""WITH {sql.SURFACES}, f AS (SELECT lower(surface) AS key, min((work_id, pos)) AS pos FROM surfaces GROUP BY 1),
    forms AS (SELECT key, pos, {sql.fold('key')} AS folded FROM f), fk AS (SELECT folded, arg_min(key, pos) AS lexeme FROM forms GROUP BY folded),
    t AS (SELECT conv_id, lower(unnest({_RAW})) AS key FROM conversations), u AS (SELECT conv_id, key, {sql.fold('key')} AS folded FROM t)
    SELECT conv_id, count(*) AS tokens, count(forms.key) AS exact, count(*) FILTER (forms.key IS NULL AND fk.lexeme IS NOT NULL) AS by_fold,
           count(DISTINCT coalesce(forms.key, fk.lexeme)) AS lexemes FROM u LEFT JOIN forms ON forms.key = u.key LEFT JOIN fk ON fk.folded = u.folded GROUP BY conv_id""")
def best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations against the documents' forms, by key and else by folded key."""
    s = tables.surfaces(spark, sf_dir).withColumn("key", F.lower("surface"))
    forms = s.groupBy("key").agg(F.min(F.struct("work_id", "pos")).alias("pos"))
    forms = forms.select("pos", "key", fold(F.col("key")).alias("folded"), F.col("key").alias("lexeme"))
    words = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda t: t != "")
    t = table(spark, sf_dir, "conversations").select("conv_id", F.explode(words).alias("w")).select("conv_id", F.lower("w").alias("key"))
    found = lexis.readings(t.withColumn("folded", fold(F.col("key"))), forms, "key", "folded")
    return found.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("tier") == 1).alias("exact"), F.count_if(F.col("tier") == 2).alias("by_fold"), F.countDistinct("lexeme").alias("lexemes")
    )


@query(f"""WITH {_KEYED}, per AS (SELECT lang, key, surface, count(*) AS c FROM ks GROUP BY lang, key, surface)
    SELECT lang, key, sum(c)::BIGINT AS n, string_agg(surface || '=' || c, ',' ORDER BY surface) AS forms FROM per GROUP BY lang, key""")
def key_surface_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lexis.surface_dictionary(keyed_surfaces(spark, sf_dir), "lang", "key", "surface")
    return d.withColumn("forms", F.array_join(F.transform(F.map_entries("forms"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query(f"""WITH {sql.TOKENS} SELECT work_id, key AS lemma, count(*) AS n FROM tokens GROUP BY work_id, key""")
def lemma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexis.lemma_counts(tables.counts(spark, sf_dir).withColumnRenamed("key", "lemma"), ["work_id"], "lemma")


_TILES = "[\\s\\x{FEFF}]+|[A-Za-zÀ-\u024f\u0300-\u036f]+[\u02bc\u2019\u1fbd\u1fbf'']?|[0-9]+|(?s:.)"


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TILES}')) AS s FROM documents),
    k AS (SELECT doc_id, s, CASE WHEN regexp_matches(s, '^[\\s\\x{{FEFF}}]') THEN 'space' WHEN regexp_matches(s, '^[A-Za-zÀ-\u024f\u0300-\u036f]') THEN 'word' WHEN regexp_matches(s, '^[0-9]') THEN 'number'
      WHEN regexp_matches(s, '^[\\p{{P}}\\p{{S}}]') THEN 'punct' ELSE 'other' END AS kind FROM t)
    SELECT doc_id, count(*) FILTER (kind = 'word') AS word, count(*) FILTER (kind = 'number') AS number, count(*) FILTER (kind = 'space') AS space, count(*) FILTER (kind = 'punct') AS punct,
      count(*) FILTER (kind = 'other') AS other, sum(length(s))::BIGINT AS chars FROM k GROUP BY doc_id""")
def lossless_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token kinds of each document; the tokens tile its text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("it").alias("lang"))
    t = tokenize(d).groupBy("id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("word", "number", "space", "punct", "other")), F.sum(F.length("surface")).alias("chars"))
    return t.withColumnRenamed("id", "doc_id")


@query(f"""WITH {sql.PASSAGES}, s AS (SELECT work_id, trim(unnest({sql.sentences('text')})) AS s FROM passages)
    SELECT work_id, count(*) AS sentences, max(length(s))::INT AS longest FROM s WHERE s <> '' GROUP BY work_id""")
def sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.passages(spark, sf_dir).select("work_id", F.explode(sentences(F.col("text"))).alias("s"))
    return s.groupBy("work_id").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.length("s")).alias("longest"))


_PROSE = ["perfect participle middle/passive, nominative singular neuter", "genitive plural feminine", "present indicative active 3rd person singular", "adverb"]


@query(f"SELECT c_custkey, {_PROSE}[(c_custkey % 4 + 1)::INT] AS prose, 'lógos' AS word FROM customer")
def morphology_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of a small tag set by customer segment, described; Greek letters romanised beside it."""
    tags = F.element_at(F.array(F.lit("verb ptcp perf mp nom sg n"), F.lit("noun gen pl f"), F.lit("verb ind pres act 3 sg"), F.lit("adv")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", describe(tags).alias("prose"), transliterate(F.lit("λόγος")).alias("word"))
