"""Building a lexicon: candidate pools, ranking, homographs, glosses, shards, codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_BYTES, SHARD_DEPTH, TOP_ANALYSES, TOP_READINGS = 250_000, 4, 15, 6
RESERVED = ["con", "prn", "aux", "nul", *[f"com{n}" for n in range(1, 10)], *[f"lpt{n}" for n in range(1, 10)]]


def variants(key: Column) -> Column:
    """Spellings of a key in the order they are tried: itself, v as u, u as v."""
    return F.array_distinct(F.array(key, F.translate(key, "v", "u"), F.translate(key, "u", "v")))


def pool(keys: DataFrame, entries: DataFrame, enclitics: tuple[str, ...] = ("que", "ne", "ve")) -> DataFrame:
    """(key, entry, stripped): entries of the first spelling that has any; else of the key without an enclitic.

    keys is (key), entries (key, entry). An enclitic is taken off where three letters at least are left.
    """
    e = entries.select(F.col("key").alias("form"), "entry")

    def first(k: DataFrame, by: str) -> DataFrame:
        tried = k.select("key", F.posexplode(variants(F.col(by))).alias("at", "form"))
        hit = tried.join(e, "form")
        best = hit.groupBy("key").agg(F.min("at").alias("at"))
        return hit.join(best, ["key", "at"]).select("key", "entry")

    direct = first(keys.withColumn("base", F.col("key")), "base").withColumn("stripped", F.lit(None).cast("string"))
    left = keys.join(direct.select("key").distinct(), "key", "left_anti")
    ends = F.array(*(F.when(F.col("key").endswith(s) & (F.length("key") > len(s) + 2), F.struct(F.expr(f"left(key, length(key) - {len(s)})").alias("base"), F.lit(s).alias("s"))) for s in enclitics))
    cut = left.select("key", F.explode(F.slice(F.array_compact(ends), 1, 1)).alias("c")).select("key", "c.base", F.col("c.s").alias("stripped"))
    return direct.unionByName(first(cut, "base").join(cut.select("key", "stripped"), "key"))


def lookup_all(lemmas: DataFrame, spellings: Column, entries: DataFrame) -> DataFrame:
    """(lemma, entry, at): entries of a lemma's first spelling that has any, of the wanted class if one of them is, else all.

    lemmas is (lemma, wanted), spellings an array column over it, entries (headword, entry, class, at) with ``at`` the order
    of homographs. A null class is one that isn't asked for.
    """
    tried = lemmas.select("lemma", "wanted", F.posexplode(spellings).alias("nth", "headword"))
    hits = tried.join(entries, "headword")
    first = hits.groupBy("lemma", "wanted").agg(F.min("nth").alias("nth"))
    hits = hits.join(first.withColumnRenamed("wanted", "w"), (hits["lemma"] == first["lemma"]) & hits["wanted"].eqNullSafe(F.col("w")) & (hits["nth"] == first["nth"]), "left_semi")
    fits = F.coalesce(F.col("class") == F.col("wanted"), F.lit(False))
    any_ = F.max(fits).over(Window.partitionBy("lemma", "wanted"))
    return hits.withColumn("fits", fits).withColumn("any", any_).where("fits or not any").select("lemma", "entry", "at")


def pick_headword(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """(headword, pos, entry): of several entries of a headword one of the wanted class, else a main one, else the first.

    wanted is (headword, pos), entries (headword, entry, class, main, at). A single entry is taken whatever its class.
    """
    order = F.struct((~F.coalesce(F.col("class") == F.col("pos"), F.lit(False))).alias("other"), (~F.col("main")).alias("side"), "at")
    by_class = wanted.join(entries, "headword").withColumn("order", order)
    return by_class.groupBy("headword", "pos").agg(F.min_by("entry", F.struct("order.other", F.when(~F.col("order.other"), False).otherwise(F.col("order.side")), "order.at")).alias("entry"))


def gated(analyses: DataFrame, first: DataFrame, second: DataFrame, lemma: str) -> DataFrame:
    """Analyses whose lemma one of two dictionaries knows: a semi-join against both lemma sets."""
    return analyses.join(first.select(lemma).unionByName(second.select(lemma)).distinct(), lemma, "left_semi")


def signature_weights(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(signature, weight): running words of the keys by what their fallback candidates look like, each key once a signature."""
    return candidates.select("key", "signature").distinct().join(counts, "key").groupBy("signature").agg(F.sum("n").alias("weight"))


def work_files(works: DataFrame, files: DataFrame, overrides: DataFrame) -> DataFrame:
    """(work, file): works and corpus files by author and work number; an override goes before what a work's text says.

    works is (work, author, number), files (file, author, number), overrides (work, author, number), null for no match.
    """
    fixed = overrides.select("work", F.col("author").alias("a"), F.col("number").alias("n"), F.lit(True).alias("fixed"))
    known = works.join(fixed, "work", "left")
    known = known.select("work", F.when(F.col("fixed"), F.col("a")).otherwise(F.col("author")).alias("author"), F.when(F.col("fixed"), F.col("n")).otherwise(F.col("number")).alias("number"))
    return known.join(files, ["author", "number"]).select("work", "file")


def form_counts(readings: DataFrame) -> DataFrame:
    """(work, lexeme, forms): how many different forms of a work have a lexeme as their best reading (rank 0)."""
    return readings.where("rank = 0").groupBy("work", "lexeme").agg(F.countDistinct("key").alias("forms"))


def homographs(entries: DataFrame, by: list[str], weight: str, entry: str, lemma: str) -> DataFrame:
    """Adds lexeme_id: entries of one lemma and class numbered by weight; the first has no number."""
    w = Window.partitionBy(*by).orderBy(F.col(weight).desc(), F.col(entry))
    n = F.row_number().over(w)
    return entries.withColumn("n", n).withColumn("lexeme_id", F.concat(F.concat_ws(":", *by), F.when(F.col("n") > 1, F.concat(F.lit("#"), F.col("n").cast("string"))).otherwise(""))).drop("n")


def entry_weights(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(entry, weight): running words of the keys that can be an entry; a key counts once a candidate row, as cells do."""
    return candidates.join(counts, "key").groupBy("entry").agg(F.sum("n").alias("weight"))


def best_first(readings: DataFrame, key: str, weight: str, morph: str) -> DataFrame:
    """Adds rank and conf: heavier lexemes first, then by tags; 0.9 for the only reading of a key, 0.8 among several."""
    w = Window.partitionBy(key).orderBy(F.col(weight).desc(), F.col(morph))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return readings.withColumn("rank", F.row_number().over(w) - 1).withColumn("conf", F.when(n == 1, 0.9).otherwise(0.8))


def scored(readings: DataFrame, key: str, lexeme: str, morph: str, most: int = TOP_READINGS) -> DataFrame:
    """Readings of one lexeme and tags once, the best kept; six a key by score (exact 1, direct 0.5); conf by what is found."""
    s = F.when(F.col("exact"), 1.0).otherwise(0.0) + F.when(F.col("direct"), 0.5).otherwise(0.0)
    one = readings.groupBy(key, lexeme, morph).agg(F.max(s).alias("score"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(lexeme), F.col(morph))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    conf = F.when(F.col("score") < 1, 0.6).when(n == 1, 1.0).otherwise(0.8)
    return one.withColumn("conf", conf).withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most)


def top_analyses(analyses: DataFrame, key: str, analysis: str, most: int = TOP_ANALYSES) -> DataFrame:
    """(key, analysis, n, rank): the commonest analyses of a key."""
    per = analyses.groupBy(key, analysis).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), analysis)
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def first_gloss(entries: DataFrame, by: list[str], gloss: str, order: str) -> DataFrame:
    """The first gloss of each entry that isn't empty."""
    return entries.where(F.col(gloss).isNotNull() & (F.col(gloss) != "")).groupBy(*by).agg(F.min_by(gloss, order).alias(gloss))


def form_targets(stubs: DataFrame, entries: DataFrame) -> DataFrame:
    """(stub, target, kind): the entry a form points to; of several the one with most senses, else "synthetic".

    stubs is (stub, lemma), entries (entry, lemma, senses).
    """
    best = entries.groupBy("lemma").agg(F.min(F.struct((-F.col("senses")).alias("s"), "entry")).alias("b"), F.count(F.lit(1)).alias("k"))
    j = stubs.join(best, "lemma", "left")
    kind = F.when(F.col("b").isNull(), "synthetic").when(F.col("k") == 1, "only").otherwise("most senses")
    return j.select("stub", F.col("b.entry").alias("target"), kind.alias("kind"))


def resolve_glosses(entries: DataFrame, depth: int = 4) -> DataFrame:
    """(entry, gloss, hops): "of" entries take the gloss of what they point to, ``depth`` hops at most, else null.

    entries is (entry, gloss, target). Each hop is a join; relations that run in circles end with null.
    """
    known = entries.select(F.col("entry").alias("to"), F.col("gloss").alias("to_gloss"), F.col("target").alias("to_target"))
    out = entries.select("entry", "gloss", F.col("target").alias("at"), F.lit(0).alias("hops"))
    for _ in range(depth):
        go = F.col("gloss").isNull() & F.col("at").isNotNull()
        j = out.join(known, F.when(go, F.col("at")) == F.col("to"), "left")
        out = j.select("entry", F.coalesce("gloss", "to_gloss").alias("gloss"), F.when(go, F.col("to_target")).otherwise(F.col("at")).alias("at"), (F.col("hops") + F.col("to").isNotNull().cast("int")).alias("hops"))
    return out.select("entry", "gloss", F.when(F.col("gloss").isNotNull(), F.col("hops")).alias("hops"))


def semi_filter(entries: DataFrame, wanted: DataFrame, headword: str, forms: str) -> DataFrame:
    """Entries whose headword or any form is a wanted key: two left-semi joins, so an entry comes once."""
    w = wanted.select(F.col("key").alias("__key")).distinct()
    e = entries.withColumn("__k", F.explode(F.array_distinct(F.concat(F.array(headword), F.coalesce(forms, F.array().cast("array<string>"))))))
    ids = e.join(w, F.col("__k") == F.col("__key"), "left_semi").select("entry").distinct()
    return entries.join(ids, "entry", "left_semi")


def choose_shards(entries: DataFrame, plain: Column, size: Column, most: int = SHARD_BYTES, depth: int = SHARD_DEPTH) -> DataFrame:
    """Adds shard: the shortest prefix, of two letters at least, whose entries fit; a prefix of ``depth`` is not split further.

    An entry too short to go deeper stays at its own length; one without a letter is in "_".
    """
    e = entries.withColumn("__p", plain).withColumn("__n", size)
    for k in range(2, depth + 1):
        e = e.withColumn(f"__p{k}", F.when(F.length("__p") >= k, F.substring("__p", 1, k)))
    for k in range(2, depth):
        sums = e.where(f"__p{k} is not null").groupBy(f"__p{k}").agg(F.sum("__n").alias(f"__s{k}"))
        e = e.join(sums, f"__p{k}", "left")
    choice = F.col(f"__p{depth}")
    for k in reversed(range(2, depth)):
        choice = F.when((F.col(f"__s{k}") <= most) | F.col(f"__p{k + 1}").isNull(), F.col(f"__p{k}")).otherwise(choice)
    return e.withColumn("shard", F.coalesce(choice, F.when(F.length("__p") > 0, F.col("__p")), F.lit("_"))).select(*entries.columns, "shard")


def longest_prefix(ids: DataFrame, shards: DataFrame, plain: str, depth: int = SHARD_DEPTH) -> DataFrame:
    """(id, shard): the longest listed prefix, of four letters down to one, else "_" if that is listed, else null."""
    tried = F.concat(F.transform(F.sequence(F.lit(depth), F.lit(1), F.lit(-1)), lambda k: F.when(F.length(plain) >= k, F.substring(F.col(plain), F.lit(1), k))), F.array(F.lit("_")))
    each = ids.select("id", F.posexplode(tried).alias("at", "shard")).where("shard is not null")
    best = each.join(shards.select("shard").distinct(), "shard").groupBy("id").agg(F.min_by("shard", "at").alias("shard"))
    return ids.select("id").join(best, "id", "left")


def shard_stem(prefix: Column) -> Column:
    """File stem of a shard; names that some systems reserve get an underscore."""
    return F.when(F.lower(prefix).isin(*RESERVED), F.concat(prefix, F.lit("_"))).otherwise(prefix)


def shard_prefix(stem: Column) -> Column:
    """The prefix whose shard has this stem: the inverse of ``shard_stem``."""
    bare = F.substring(stem, F.lit(1), F.length(stem) - 1)
    return F.when(F.endswith(stem, F.lit("_")) & F.lower(bare).isin(*RESERVED), bare).otherwise(stem)


def encode(forms: DataFrame) -> DataFrame:
    """(work, lexemes, morphs, codes): a bundle of (work, pos, rank, key, lexeme, morph, conf) interned.

    lexemes and morphs are in order of first appearance; codes has (pos, key, flat triples of lexeme, morph, conf x 100).
    """
    at = F.struct("pos", "rank")

    def interned(col: str) -> DataFrame:
        firsts = forms.groupBy("work", col).agg(F.min(at).alias("first"))
        return firsts.withColumn("i", F.row_number().over(Window.partitionBy("work").orderBy("first")) - 1)

    lexemes, morphs = interned("lexeme"), interned("morph")
    table = lambda df, c, name: df.groupBy("work").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c]).alias(name))
    j = forms.join(lexemes.select("work", "lexeme", F.col("i").alias("l")), ["work", "lexeme"]).join(morphs.select("work", "morph", F.col("i").alias("m")), ["work", "morph"])
    triple = F.struct("rank", F.array("l", "m", F.round(F.col("conf") * 100).cast("int")).alias("t"))
    keys = j.groupBy("work", "pos", "key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(triple)), lambda x: x["t"])).alias("codes"))
    codes = keys.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "codes"))).alias("codes"))
    return table(lexemes, "lexeme", "lexemes").join(table(morphs, "morph", "morphs"), "work").join(codes, "work")


def decode(bundles: DataFrame) -> DataFrame:
    """The rows that ``encode`` took."""
    e = bundles.select("work", "lexemes", "morphs", F.explode("codes").alias("c")).select("work", "lexemes", "morphs", "c.*")
    at = lambda k: F.element_at("codes", F.col("rank") * 3 + k)
    e = e.withColumn("rank", F.explode(F.sequence(F.lit(0), (F.size("codes") / 3).cast("int") - 1)))
    return e.select("work", "pos", "rank", "key", F.element_at("lexemes", at(1) + 1).alias("lexeme"), F.element_at("morphs", at(2) + 1).alias("morph"), (at(3) / 100).alias("conf"))


def elisions(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """(id, pos, key): a token found in the elision table (form, words) becomes its words, others stay."""
    j = tokens.join(table, F.col("key") == F.col("form"), "left")
    return j.select("id", "pos", F.explode(F.coalesce("words", F.array("key"))).alias("key"))
