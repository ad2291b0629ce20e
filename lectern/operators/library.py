"""The corpus as tables: editions, trees, neighbours, stops, bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.labels import CONSOLIDATABLE


def in_edition(edition: str, lang: Column, translator: Column) -> Column:
    """Works of an edition: "all"; "en": English ones; "original": others, and English ones without a translator."""
    if edition == "all":
        return F.lit(True)
    english = lang == "en"
    return english if edition == "en" else ~english | translator.isNull() | (translator == "")


def flatten(tree: DataFrame) -> DataFrame:
    """Adds pre_order (within a root, in the order of paths), is_leaf and children to (root, id, parent, depth, path)."""
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    order = Window.partitionBy("root").orderBy("path")
    out = tree.withColumn("pre_order", F.row_number().over(order) - 1).join(kids, "id", "left")
    return out.withColumn("children", F.coalesce("children", F.lit(0))).withColumn("is_leaf", F.col("children") == 0)


def neighbours(rows: DataFrame, work: str, order: list[Column], key: str) -> DataFrame:
    """Adds prev and next, the keys before and after within a work; null at its ends."""
    w = Window.partitionBy(work).orderBy(*order)
    return rows.withColumn("prev", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def stops(flat: DataFrame, title: Column) -> DataFrame:
    """Navigable divisions: leaves, but a group of leaves only with a consolidatable title is one stop and its leaves none."""
    kids = flat.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.bool_and("is_leaf").alias("all_leaves"))
    d = flat.withColumn("title", title).join(kids, flat["id"] == F.col("of"), "left").drop("of")
    d = d.withColumn("group", F.coalesce(F.col("all_leaves") & F.col("title").rlike(CONSOLIDATABLE), F.lit(False)))
    groups = d.where("group").select(F.col("id").alias("gid"))
    leaves = d.where("is_leaf").join(groups, F.col("parent") == F.col("gid"), "left_anti")
    return d.where("group").unionByName(leaves)


def toggled(events: DataFrame, group: str, key: str, order: list[str]) -> DataFrame:
    """Keys that an odd number of toggles leave in the set, with the time of the last one and their place, newest first."""
    out = events.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order)).alias("last"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("last").desc(), key))
    return out.where(F.col("n") % 2 == 1).select(group, key, F.col(f"last.{order[0]}").alias("added"), place.alias("place"))


def top_level(parts: DataFrame) -> DataFrame:
    """(work, pos, id, label, path): a work's parts in order; a Latin work has its preface before them.

    parts is (work, lang, pos, id, label).
    """
    rows = parts.select("work", "pos", "id", "label", F.concat(F.lit("/part/"), "id").alias("path"))
    preface = parts.where("lang = 'la'").select("work").distinct()
    return rows.unionByName(preface.select("work", F.lit(-1).cast(rows.schema["pos"].dataType).alias("pos"), F.lit("prooemium").alias("id"), F.lit("Proœmium").alias("label"), F.lit("/prooemium").alias("path")))


def available(works: DataFrame, bundles: DataFrame, languages: list[str]) -> DataFrame:
    """Works in a language that the tables of ``bundles`` (lang) have, of those that are supported at all."""
    return works.where(F.col("lang").isin(*languages)).join(bundles.select("lang").distinct(), "lang", "left_semi")


def by_year(authors: DataFrame, year: str, name: str) -> DataFrame:
    """Authors by sort year, those without one last, then by name."""
    return authors.orderBy(F.col(year).asc_nulls_last(), name)


def split_misplaced(passages: DataFrame, incipits: DataFrame) -> DataFrame:
    """Passages (div, pos, text) keyed anew from where a known incipit begins: (div, pos, text) with the right division.

    incipits is (div, incipit, right): from the first passage of ``div`` that begins so, all that follow are of ``right``.
    """
    hit = passages.join(incipits, "div").where(F.startswith("text", "incipit")).groupBy("div").agg(F.min_by("right", "pos").alias("right"), F.min("pos").alias("from"))
    j = passages.join(hit, "div", "left")
    return j.select(F.when(F.col("pos") >= F.col("from"), F.col("right")).otherwise(F.col("div")).alias("div"), "pos", "text")


def title_summary(rows: DataFrame, group: str, title: str, order: str) -> DataFrame:
    """(group, works, summary): up to three titles in order of first appearance, else their number."""
    firsts = rows.groupBy(group, title).agg(F.min(order).alias("at"))
    w = Window.partitionBy(group).orderBy("at", title)
    ranked = firsts.withColumn("n", F.row_number().over(w))
    out = ranked.groupBy(group).agg(
        F.count(F.lit(1)).alias("works"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", title)))), lambda s: s[title]), ", ").alias("names"),
    )
    return out.select(group, "works", F.when(F.col("works") <= 3, F.col("names")).otherwise(F.concat(F.col("works").cast("string"), F.lit(" works"))).alias("summary"))


def joined_text(rows: DataFrame, work: str, pos: str, text: str, by: str = "\n") -> DataFrame:
    """(work, text): passages in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(pos, text)))
    return rows.groupBy(work).agg(F.array_join(F.transform(parts, lambda p: p[text]), by).alias("text"))
