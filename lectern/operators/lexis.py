"""Running words against a lexicon: counts, coverage, names, readings, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KNOWN = ("known", "mastered", "ignored")
CORE_WORDS = 300
#: Weights of a forecast's classes.
WEIGHTS = {"known": 1.0, "likely-familiar": 1.0, "met": 0.5, "new": 0.0}
FAMILIAR = {"encounters": 4, "days": 2, "quiet_hours": 36}


def is_known(status: Column) -> Column:
    return F.coalesce(status.isin(*KNOWN), F.lit(False))


def familiarity(status: Column, encounters: Column, days: Column, lookups: Column, last_seen: Column, last_lookup: Column) -> Column:
    """known, likely-familiar (4 encounters on 2 days, no lookup in the 36 hours before the last), met, or new."""
    quiet = last_lookup.isNull() | (F.unix_micros(last_seen.cast("timestamp")) - F.unix_micros(last_lookup.cast("timestamp")) >= FAMILIAR["quiet_hours"] * 3_600_000_000)
    likely = (encounters >= FAMILIAR["encounters"]) & (days >= FAMILIAR["days"]) & quiet
    met = (encounters > 0) | (lookups > 0)
    return F.when(is_known(status), "known").when(likely, "likely-familiar").when(met, "met").otherwise("new")


def _n(tokens: DataFrame) -> Column:
    """How many running words: rows, or what the column n of rows that are counted already adds up to."""
    return (F.sum("n") if "n" in tokens.columns else F.count(F.lit(1))).alias("n")


def lemma_counts(tokens: DataFrame, text: list[str], lemma: str) -> DataFrame:
    """Running words and unrecognised ones (null lemma) of each text, and its counts by lemma as rows."""
    return tokens.groupBy(*text, lemma).agg(_n(tokens))


def core_words(counts: DataFrame, names: DataFrame, group: str, lemma: str, n: int = CORE_WORDS) -> DataFrame:
    """(group, lemma, n, rank, share): the n commonest lemmas that aren't names; share of all running words, names included.

    names is (group, lemma), or (lemma) where a name is one in every group.
    """
    totals = counts.groupBy(group, lemma).agg(F.sum("n").alias("n"))
    words = totals.groupBy(group).agg(F.sum("n").alias("words"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col(lemma))
    top = totals.join(names, [c for c in (group, lemma) if c in names.columns], "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.join(words, group).withColumn("share", F.col("n") / F.col("words")).drop("words")


def surface_counts(surfaces: DataFrame, group: list[str], surface: str, order: list[str]) -> DataFrame:
    """(group, surface, n, first): counted before anything is done to a surface, so that it is done once."""
    return surfaces.groupBy(*group, surface).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))


def names(per: DataFrame, group: list[str], key: str, surface: str) -> DataFrame:
    """(group, key, name, n): keys mostly written with a capital; the commonest capitalised surface, the first one on ties.

    per is ``surface_counts`` with a key.
    """
    capital = F.col(surface).rlike(r"^\p{Lu}")
    totals = per.groupBy(*group, key).agg(
        F.sum("n").alias("all"), F.sum(F.when(capital, F.col("n")).otherwise(0)).alias("capitals"),
        F.min(F.when(capital, F.struct((-F.col("n")).alias("m"), "first", surface))).alias("best"),
    )
    return totals.where(F.col("capitals") * 2 > F.col("all")).select(*group, key, F.col(f"best.{surface}").alias("name"), F.col("all").alias("n"))


def division_coverage(tokens: DataFrame, lexicon: DataFrame, text: list[str], key: str) -> DataFrame:
    """Exact coverage of each text: tokens, known tokens, lexemes, known lexemes; lexicon is (key, lexeme, known)."""
    per = tokens.groupBy(*text, key).agg(_n(tokens))
    j = per.join(lexicon, key, "left")
    return j.groupBy(*text).agg(
        F.sum("n").alias("tokens"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("known_tokens"),
        F.countDistinct("lexeme").alias("lexemes"), F.countDistinct(F.when(F.col("known"), F.col("lexeme"))).alias("known_lexemes"),
    )


def work_coverage(tokens: DataFrame, lexicon: DataFrame, work: list[str], key: str) -> DataFrame:
    """Coverage by forms: recognised tokens and forms of a work, and its known tokens estimated by the share of known forms."""
    forms = tokens.groupBy(*work, key).agg(_n(tokens)).join(lexicon, key, "left")
    there = F.col("lexeme").isNotNull()
    out = forms.groupBy(*work).agg(
        F.sum("n").alias("tokens"), F.sum(F.when(there, F.col("n")).otherwise(0)).alias("recognized"),
        F.count(F.lit(1)).alias("forms"), F.count_if(there).alias("recognized_forms"), F.count_if(F.coalesce("known", F.lit(False))).alias("known_forms"),
    )
    guess = F.floor(F.col("recognized") * F.col("known_forms") / F.col("recognized_forms") + 0.5).cast("long")
    return out.withColumn("known_tokens", F.when(F.col("recognized_forms") > 0, guess).otherwise(F.lit(0).cast("long")))


def forecast(tokens: DataFrame, classes: DataFrame, text: list[str], key: str) -> DataFrame:
    """Words by familiarity class and weighted coverage; classes is (key, class), a missing key is unrecognised."""
    j = tokens.groupBy(*text, key).agg(_n(tokens)).join(classes, key, "left")
    of = lambda c: F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0))
    weight = sum((of(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return j.groupBy(*text).agg(
        F.sum("n").alias("tokens"), of("known").alias("known"), of("likely-familiar").alias("likely"), of("met").alias("met"), of("new").alias("new"),
        F.sum(F.when(F.col("class").isNull(), F.col("n")).otherwise(0)).alias("unrec"), (weight / F.sum("n")).alias("coverage"),
    )


def readings(tokens: DataFrame, forms: DataFrame, key: str, folded: str) -> DataFrame:
    """Tokens with their best reading: by key, else by folded key, where the first stored key of a fold wins; else null.

    forms is (pos, key, folded, lexeme), one row a key. Adds lexeme and tier (1, 2 or null).
    """
    exact = forms.select(F.col("key").alias(key), F.col("lexeme").alias("by_key"))
    loose = forms.groupBy(F.col("folded").alias(folded)).agg(F.min_by("lexeme", "pos").alias("by_fold"))
    j = tokens.join(exact, key, "left").join(loose, folded, "left")
    tier = F.when(F.col("by_key").isNotNull(), 1).when(F.col("by_fold").isNotNull(), 2)
    return j.withColumn("lexeme", F.coalesce("by_key", "by_fold")).withColumn("tier", tier).drop("by_key", "by_fold")


def surface_dictionary(per: DataFrame, group: str, key: str, surface: str) -> DataFrame:
    """(group, key, n, forms): count of a key, and a map of its surfaces with theirs; per is ``surface_counts`` with a key."""
    return per.groupBy(group, key).agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(surface, F.col("n").alias("c"))))).alias("forms"))
