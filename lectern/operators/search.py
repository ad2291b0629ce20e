"""Ranked search, tree scans, references and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.reference import parse_reference
from lectern.functions.text import fold, fold_search, snippet_around
from lectern.functions.unicode import fold_text

PHRASE, ALL, SOME = 0, 1, 2


def rank_of(folded: Column, query: str) -> Column:
    """0: the phrase (or the only word) occurs, 1: all words do, 2: some do, null: none; words match as substrings."""
    phrase = fold_text(query)
    words = [w for w in "".join(c if c.isalnum() else " " for c in phrase).split(" ") if w]
    if not words:
        return F.lit(None).cast("int")
    hits = sum((F.contains(folded, F.lit(w)).cast("int") for w in words), F.lit(0))
    out = F.when(F.contains(folded, F.lit(phrase)), PHRASE) if len(words) > 1 else F.when(hits == 1, PHRASE)
    return out.when(hits == len(words), ALL).when(hits > 0, SOME)


def search(records: DataFrame, query: str, order: list[Column], limit: int = 200, folded: str = "folded") -> DataFrame:
    """Records with a rank, best first, then in corpus order. The limit is the feature: a top-k that partitions keep apart."""
    return ranked(records, query, folded).orderBy("rank", *order).limit(limit)


def ranked(records: DataFrame, query: str, folded: str = "folded") -> DataFrame:
    """Records with a rank. A filter on the rank would be pushed below the folding and repeat it, so a generator drops the rest."""
    ranks = F.transform(F.array(F.col(folded)), lambda f: rank_of(f, query))
    return records.withColumn("rank", F.explode(F.filter(ranks, lambda r: r.isNotNull())))


def scan(passages: DataFrame, query: str, order: list[str], limit: int = 60) -> DataFrame:
    """The first passages in corpus order that contain the query, with a snippet; queries under two letters find nothing."""
    q = fold_text(query).replace("ς", "σ")
    rows = passages.withColumn("folded", fold_search(F.col("text"))).where(F.contains("folded", F.lit(q)) & F.lit(len(q) >= 2))
    return rows.withColumn("snippet", snippet_around(F.col("text"), F.col("folded"), q)).orderBy(*order).limit(limit)


def search_index(sections: DataFrame, parts: str = "parts", preview: int = 240) -> DataFrame:
    """(work_id, text, snippet): the parts of each article joined by " · ", folded; a preview of the original."""
    joined = F.array_join(parts, " · ")
    return sections.withColumn("text", fold(joined)).withColumn("snippet", F.substring(joined, 1, preview))


def resolve(references: DataFrame, articles: DataFrame, text: str = "ref") -> DataFrame:
    """Parsed references against (part, q, a): "article", "question", "gap" where nothing is there, "none" if not a reference."""
    parsed = references.withColumn("p", parse_reference(F.col(text)))
    known_q = articles.select("part", "q").distinct().withColumn("has_q", F.lit(True))
    known_a = articles.select("part", "q", "a").distinct().withColumn("has_a", F.lit(True))
    out = parsed.withColumn("part", F.col("p.part")).withColumn("q", F.col("p.q")).withColumn("a", F.col("p.a"))
    out = out.join(known_q, ["part", "q"], "left").join(known_a, ["part", "q", "a"], "left")
    kind = (
        F.when(F.col("p").isNull(), "none").when(F.col("a").isNull() & F.col("has_q"), "question").when(F.col("has_a"), "article").otherwise("gap")
    )
    return out.select(text, F.col("p.citation").alias("citation"), kind.alias("target"))


def missing_numbers(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, number): 1 to the largest number of a group, less those that are there. Null numbers don't count."""
    rows = rows.where(F.col(number).isNotNull()).select(group, F.col(number).cast("long").alias(number))
    full = rows.groupBy(group).agg(F.max(number).alias("most")).where("most >= 1")
    full = full.select(group, F.explode(F.sequence(F.lit(1).cast("long"), "most")).alias(number))
    return full.join(rows.distinct(), [group, number], "left_anti")


def title_matches(wanted: DataFrame, titles: DataFrame, stop: list[str], least: float = 0.5) -> DataFrame:
    """(wanted, title, share): the title that has most of the wanted keywords, the first one on ties, if at least ``least`` of them.

    Both are (id, text). A title with that share has one of the rarest keywords that are more than the others allow to miss, so
    only these meet by an equi-join and common keywords make no pairs; the rest is counted on the pairs found.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop)))
    t = titles.select(F.col("id").alias("title"), words(F.col("text")).alias("has"))
    t = t.select("title", "has", F.explode("has").alias("key"))
    often = t.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    w = wanted.select(F.col("id").alias("wanted"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("wanted", "w", F.explode("w").alias("key")).join(often, "key")
    nth = F.row_number().over(Window.partitionBy("wanted").orderBy("often", "key"))
    rare = w.withColumn("nth", nth).where(F.col("nth") <= F.size("w") - F.ceil(F.size("w") * least) + 1)
    share = rare.join(t, "key").select("wanted", "title", (F.size(F.array_intersect("w", "has")) / F.size("w")).alias("share"))
    best = share.groupBy("wanted").agg(F.max(F.struct("share", (-F.col("title")).alias("first"))).alias("b"))
    return best.where(F.col("b.share") >= least).select("wanted", (-F.col("b.first")).alias("title"), F.col("b.share").alias("share"))
