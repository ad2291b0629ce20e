"""Data quality as findings: residual words, accounting, integrity, order, alignment, merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROBE, SHORT = 60, 40
ACCEPT, REJECT, BAND = 0.6, 0.34, 5


def findings(parts: list[tuple[DataFrame, str, str, Column]]) -> DataFrame:
    """(level, check, message) out of (rows, level, check, message column)."""
    out = None
    for rows, level, check, message in parts:
        f = rows.select(F.lit(level).alias("level"), F.lit(check).alias("check"), message.cast("string").alias("message"))
        out = f if out is None else out.unionByName(f)
    return out


def summary(found: DataFrame) -> DataFrame:
    """(level, check, n)."""
    return found.groupBy("level", "check").agg(F.count(F.lit(1)).alias("n"))


def residual_words(tokens: DataFrame, allowed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, n, first): words that no allowed text has, with their count and first place."""
    left = tokens.join(allowed.select(key).distinct(), key, "left_anti")
    return left.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))


def probe(text: Column, width: int = PROBE) -> Column:
    """The middle ``width`` characters of a text."""
    n = F.length(text)
    return F.substring(text, (F.floor((n - width) / 2) + 1).cast("int"), F.lit(width))


def accounting(paragraphs: DataFrame, output: DataFrame, key: str, run: int = 3) -> DataFrame:
    """(id, found): whether the probe of a paragraph (id, text) occurs in any output text (key, text), spaces collapsed.

    A probe is the middle of its paragraph from the next word on; paragraphs under 40 characters, and probes of no more than
    ``run`` words, are left out. Probes meet outputs by an equi-join on their first words, and the whole is compared then.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    p = paragraphs.where(F.length("text") >= SHORT).select("id", F.regexp_replace(probe(plain(F.col("text"))), r"^\S*\s+", "").alias("probe"))
    p = p.withColumn("w", F.split("probe", " ")).where(F.size("w") > run).select("id", "probe", F.array_join(F.slice("w", 1, run), " ").alias("run"))
    o = output.select(key, plain(F.col("text")).alias("whole")).withColumn("w", F.split("whole", " ")).where(F.size("w") >= run)
    at = F.sequence(F.lit(1), F.size("w") - run + 1)
    runs = o.select("whole", F.explode(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("w", i, run), " ")))).alias("run"))
    hits = runs.join(p, "run").where(F.contains("whole", "probe")).select("id").distinct().withColumn("found", F.lit(True))
    return p.select("id").join(hits, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def violations(rows: DataFrame, on: str, parents: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows whose reference has no parent; a report may ask for the first few only."""
    out = rows.where(F.col(on).isNotNull()).join(parents.select(F.col(key).alias(on)).distinct(), on, "left_anti")
    return out.limit(limit) if limit else out


def contiguous(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, rows, contiguous): whether the numbers of a group's rows are 1..n, in whatever order they stand."""
    w = Window.partitionBy(group).orderBy(number)
    r = rows.withColumn("__at", F.row_number().over(w))
    return r.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("__at") == F.col(number)).alias("contiguous"))


def reordered(rows: DataFrame, group: str, at: str, number: str) -> DataFrame:
    """(group, reordered): how many of a group's rows stand (by ``at``) behind one with a larger number."""
    before = F.max(number).over(Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__back", F.coalesce(F.col(number) < before, F.lit(False))).groupBy(group).agg(F.count_if("__back").alias("reordered"))


def probe_accounting(paragraphs: DataFrame, output: DataFrame, furniture: list[str], allowed: list[str]) -> DataFrame:
    """(id, verdict): whether 60 characters from the middle of a paragraph occur in its work: "found" or "missing".

    paragraphs is (work, id, text), output (work, text); spaces are collapsed in both. Paragraphs under 40 characters are
    "short"; furniture, and what begins with an allowed prefix, is "allowed". A probe meets the texts of its own work only.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    p = paragraphs.select("work", "id", plain(F.col("text")).alias("text"))
    start = F.greatest(F.lit(0), F.floor(F.length("text") / 2).cast("int") - 30)
    exempt = F.col("text").isin(*furniture) if furniture else F.lit(False)
    for prefix in allowed:
        exempt = exempt | F.startswith("text", F.lit(prefix))
    p = p.withColumn("probe", F.substring(F.col("text"), start + 1, F.lit(PROBE))).withColumn("kind", F.when(F.length("text") < SHORT, "short").when(exempt, "allowed"))
    hits = p.where("kind is null").join(output.select("work", plain(F.col("text")).alias("whole")), "work").where(F.contains("whole", "probe"))
    found = hits.select("work", "id", F.lit("found").alias("hit")).distinct()
    return p.join(found, ["work", "id"], "left").select("work", "id", F.coalesce("kind", "hit", F.lit("missing")).alias("verdict"))


def marker_counts(rows: DataFrame, group: str, markers: list[str]) -> DataFrame:
    """(group, marker, n): how often each marker occurs in a group's texts; markers that don't occur aren't listed."""
    each = F.array(*(F.struct(F.lit(m).alias("marker"), ((F.length("text") - F.length(F.replace(F.col("text"), F.lit(m), F.lit("")))) / len(m)).cast("long").alias("n")) for m in markers))
    return rows.select(group, F.explode(each).alias("m")).groupBy(group, "m.marker").agg(F.sum("m.n").alias("n")).where("n > 0")


def expected(truth: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, verdict) of a ground-truth table (key, expected) and the rows that are there; fewer is an error, more a warning."""
    there = rows.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    j = truth.join(there, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return j.withColumn("verdict", F.when(F.col("actual") < F.col("expected"), "error").when(F.col("actual") > F.col("expected"), "warn").otherwise("ok"))


def bundle_findings(readings: DataFrame, lexemes: DataFrame, shards: DataFrame, pos: list[str], tags: list[str]) -> DataFrame:
    """(level, check, message) of a lexicon bundle: duplicate readings, lexemes that aren't there, tags outside the vocabulary,
    confidence outside (0, 1], lexemes without a gloss or of no known class, and lexemes that their shard doesn't hold.

    readings is (key, lexeme, morph, conf), lexemes (lexeme, pos, gloss), shards (lexeme).
    """
    name = F.concat_ws(" ", "key", "lexeme")
    twice = readings.groupBy("key", "lexeme", "morph").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = F.filter(F.split("morph", " "), lambda t: t != "")
    odd_tags = F.array_except(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), F.array(*map(F.lit, tags)))
    tagged = readings.where("morph <> ''")
    return findings([
        (twice, "error", "duplicate reading", name), (readings.join(lexemes, "lexeme", "left_anti"), "error", "unknown lexeme", name),
        (tagged.where(~F.get(words, F.lit(0)).isin(*pos)), "error", "class of tags", F.col("morph")), (tagged.where(F.size(odd_tags) > 0), "error", "unknown tag", F.array_join(odd_tags, " ")),
        (readings.where("conf <= 0 or conf > 1"), "error", "confidence", name), (lexemes.where("coalesce(gloss, '') = ''"), "error", "no gloss", F.col("lexeme")),
        (lexemes.where(~F.col("pos").isin(*pos)), "error", "class of lexeme", F.col("lexeme")), (readings.select("lexeme").distinct().join(shards, "lexeme", "left_anti"), "error", "not in its shard", F.col("lexeme")),
    ])


def missing_duplicate(source: DataFrame, output: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_in, n_out, verdict): rows of the source against those of the output, from both sides."""
    a = source.groupBy(*key).agg(F.count(F.lit(1)).alias("n_in"))
    b = output.groupBy(*key).agg(F.count(F.lit(1)).alias("n_out"))
    j = a.join(b, key, "full").select(*key, F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
    v = F.when(F.col("n_in") == F.col("n_out"), "ok").when(F.col("n_out") == 0, "missing").when(F.col("n_in") == 0, "extra").when(F.col("n_out") > F.col("n_in"), "duplicate").otherwise("partial")
    return j.withColumn("verdict", v)


def merge_absent(base: DataFrame, witness: DataFrame, key: list[str], name: str, strict: bool = False) -> DataFrame:
    """Rows of ``base`` and those of ``witness`` whose key it lacks, with the witness named; a clash is an error if strict."""
    own = base.withColumn("witness", F.lit(None).cast("string"))
    more = witness.join(base.select(*key).distinct(), key, "left_anti").withColumn("witness", F.lit(name))
    if strict:
        clash = witness.join(base.select(*key).distinct(), key, "left_semi").select(*(F.col(c) for c in witness.columns))
        more = more.unionByName(clash.withColumn("witness", F.raise_error(F.concat_ws("/", *key)).cast("string")))
    return own.unionByName(more)


def assign_titles(articles: DataFrame, lists: DataFrame, slack: int = 3) -> DataFrame:
    """(group, number, title, reason): the item of a group's list by number, if the list is as long as needed, or a little longer."""
    most = articles.groupBy("group").agg(F.max("number").alias("most"), F.count(F.lit(1)).alias("n"))
    j = articles.join(most, "group").join(lists, "group", "left")
    size = F.size("items")
    fits = (size == F.col("n")) | size.between(F.col("most"), F.col("most") + slack)
    reason = F.when(F.col("items").isNull(), "no list").when(~fits & (size < F.col("most")), "too short").when(~fits, "too long").when(F.col("number") > size, "no item")
    return j.select("group", "number", F.when(reason.isNull(), F.try_element_at("items", F.col("number").cast("int"))).alias("title"), reason.alias("reason"))


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def band_pairs(left: DataFrame, right: DataFrame, group: str, pos: str, words: str, band: int = BAND, least: float = ACCEPT) -> DataFrame:
    """(group, a, b, similarity): sections of two witnesses within a band of positions that share enough words."""
    near = left.select(group, F.col(pos).alias("a"), F.col(words).alias("wa")).withColumn("b", F.explode(F.sequence(F.col("a") - band, F.col("a") + band)))
    j = near.join(right.select(group, F.col(pos).alias("b"), F.col(words).alias("wb")), [group, "b"])
    return j.withColumn("similarity", F.round(jaccard(F.col("wa"), F.col("wb")), 6)).where(F.col("similarity") >= least).select(group, "a", "b", "similarity")


def align(pairs: DataFrame, lefts: DataFrame, group: str, pos: str) -> DataFrame:
    """(group, pos, other, how): a monotone alignment from pairs; places between accepted pairs take the offset before them."""

    def one(key, p: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int, float]] = []
        for a, b, s in p.sort_values(["a", "similarity", "b"], ascending=[True, False, True]).drop_duplicates("a")[["a", "b", "similarity"]].itertuples(index=False):
            while kept and kept[-1][1] >= b and kept[-1][2] < s:
                kept.pop()
            if not kept or kept[-1][1] < b:
                kept.append((a, b, s))
        at, out, offset = {a: b for a, b, _ in kept}, [], None
        for n in sorted(left[pos].unique()):
            offset = at[n] - n if n in at else offset
            out.append((key[0], n, None if offset is None else n + offset, "matched" if n in at else "none" if offset is None else "interpolated"))
        return pd.DataFrame(out, columns=[group, pos, "other", "how"])

    kinds = dict(lefts.dtypes)
    return pairs.groupBy(group).cogroup(lefts.groupBy(group)).applyInPandas(one, f"{group} {kinds[group]}, {pos} {kinds[pos]}, other long, how string")


def span(rows: DataFrame, group: str, order: str, ref: str) -> DataFrame:
    """(group, span): first and last reference by order, blanks left out; one if they are the same."""
    full = rows.where(F.col(ref).isNotNull() & (F.trim(ref) != ""))
    s = full.groupBy(group).agg(F.min_by(ref, order).alias("a"), F.max_by(ref, order).alias("b"))
    return s.select(group, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat("a", F.lit("–"), "b")).alias("span"))


def part_stats(rows: DataFrame, part: str, kind: str, text: str) -> DataFrame:
    """(part, kind, n, chars, mean_chars, empty)."""
    return rows.groupBy(part, kind).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"), F.round(F.avg(F.length(text)), 6).alias("mean_chars"), F.count_if(F.trim(text) == "").alias("empty")
    )
