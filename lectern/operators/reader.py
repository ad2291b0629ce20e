"""What a reader's screens ask: lookups, filters, highlights, settings, selections, name matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import fold
from lectern.operators.lexis import is_known


def part_by_code(parts: DataFrame, code: Column, lang: str = "la") -> DataFrame:
    """Parts with a code, of one language, as codes repeat across languages."""
    return parts.where((F.col("code") == code) & (F.col("lang") == lang))


def find_article(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q, param, found): wanted (q, param) against (q, a); "u" means an article without a number, other words find nothing."""
    w = wanted.withColumn("n", F.col("param").try_cast("int")).where((F.col("param") == "u") | F.col("n").isNotNull())
    known = articles.select(F.col("q").alias("kq"), F.col("a").cast("int").alias("ka")).distinct().withColumn("found", F.lit(True))
    hit = w.join(known, (F.col("q") == F.col("kq")) & F.col("n").eqNullSafe(F.col("ka"))).select("q", "param", "found")
    return wanted.join(hit.distinct(), ["q", "param"], "left").select("q", "param", F.coalesce("found", F.lit(False)).alias("found"))


def vocabulary(words: DataFrame, status: str | None, lang: str | None, part: str) -> DataFrame:
    """Words of a status and language whose lemma contains the typed letters, case aside, in the collation of the language."""
    keep = F.contains(F.lower("lemma"), F.lit(part.lower()))
    for column, value in (("status", status), ("lang", lang)):
        keep = keep & (F.col(column) == value) if value else keep
    return words.where(keep).orderBy(F.collate("lemma", "UNICODE"), "lemma")


def letter_order(rows: DataFrame, group: str, ident: str) -> DataFrame:
    """Adds place: ids as 12a by number, then by what follows; ids without a number come last."""
    n = F.regexp_extract(ident, r"^(\d+)", 1).try_cast("long")
    w = Window.partitionBy(group).orderBy(n.asc_nulls_last(), F.regexp_extract(ident, r"^\d*(.*)$", 1), ident)
    return rows.withColumn("place", F.row_number().over(w))


def highlight(mode: Column, status: Column) -> Column:
    """Every word, or only words without a status and new ones."""
    return F.when(mode == "all", True).when(mode == "new", status.isNull() | (status == "new")).otherwise(False)


def effective(settings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Settings with the stage's profile in their place where a reader follows the path and stands on the ladder."""
    j = settings.join(profiles.select("stage", F.col("hints").alias("p_hints"), F.col("marks").alias("p_marks")), "stage", "left")
    on = F.col("following") & F.col("p_hints").isNotNull()
    return j.select("reader", F.when(on, F.col("p_hints")).otherwise(F.col("hints")).alias("hints"), F.when(on, F.col("p_marks")).otherwise(F.col("marks")).alias("marks"))


def selection(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(wanted, key, how): exact, else case aside (the first key by code point), else missing; "ALL" selects every key."""
    exact = known.select(F.col("key").alias("wanted"), F.col("key").alias("exact"))
    loose = known.groupBy(F.lower("key").alias("low")).agg(F.min("key").alias("loose"))
    some = wanted.where("wanted != 'ALL'").join(exact, "wanted", "left").withColumn("low", F.lower("wanted")).join(loose, "low", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "case").otherwise("missing")
    every = wanted.where("wanted = 'ALL'").distinct().join(known.select("key"))
    return some.select("wanted", F.coalesce("exact", "loose").alias("key"), how.alias("how")).unionByName(every.select("wanted", "key", F.lit("all").alias("how")))


def author_match(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """(wanted, id): the first registry author (by pos) equal to a name, containing it, contained in it, or of its surname.

    Names are compared folded, by whole words, so candidates meet on a shared word; surnames have four letters at least.
    """
    words = lambda df, c: df.withColumn("w", F.explode(F.array_distinct(F.split(c, " "))))
    a = wanted.select("wanted", fold(F.col("wanted")).alias("x"))
    b = registry.select("id", "pos", fold(F.col("name")).alias("y"))
    j = words(a, F.col("x")).join(words(b, F.col("y")), "w")
    inside = lambda p, q: F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" ")))
    last = lambda c: F.element_at(F.split(c, " "), -1)
    same = inside(F.col("x"), F.col("y")) | inside(F.col("y"), F.col("x")) | ((last(F.col("x")) == last(F.col("y"))) & (F.length(last(F.col("x"))) > 3))
    best = j.where(same).groupBy("wanted").agg(F.min_by("id", F.struct("pos", "id")).alias("id"))
    return wanted.select("wanted").join(best, "wanted", "left")


def presence(rows: DataFrame, group: str, found: str) -> DataFrame:
    """(group, n, there, bucket): present, partial or missing by how many of a group's rows were found."""
    s = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(found)).alias("there"))
    return s.withColumn("bucket", F.when(F.col("there") == F.col("n"), "present").when(F.col("there") > 0, "partial").otherwise("missing"))


def parsed_rows(raw: DataFrame, column: str) -> DataFrame:
    """Stored settings, read defensively: what doesn't parse, or is missing, has its default."""
    s = F.from_json(column, "auto int, mark string, gloss boolean")
    return raw.withColumn("s", s).select(
        *raw.columns, F.coalesce("s.auto", F.lit(6)).alias("auto"), F.when(F.col("s.mark").isin("all", "new", "none"), F.col("s.mark")).otherwise("new").alias("mark"), F.coalesce("s.gloss", F.lit(True)).alias("gloss")
    )


def known_share(words: DataFrame, lang: str, status: str) -> DataFrame:
    """(lang, words, known)."""
    return words.groupBy(lang).agg(F.count(F.lit(1)).alias("words"), F.count_if(is_known(F.col(status))).alias("known"))
