"""Readers of the driver's tables, and the corpus roles they stand in for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import fold, word_tokens
from lectern.shipping import ship


#: Tables whose rows are texts, so that work a row is worth spreading.
TEXTS = ("documents", "conversations", "pages")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are; larger inputs stay as they were read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, author, lang, translator): a document is a work, its source the author; works of src0 have no translator."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("work_id"), F.col("source").alias("author"), "lang", F.when(F.col("source") != "src0", F.col("source")).alias("translator"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, author, lang, pos, text): the lines of a document that aren't empty."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("work_id"), F.col("source").alias("author"), "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return lines.where("text != ''")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, author, lang, key): running words of folded text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("work_id"), F.col("source").alias("author"), "lang", F.explode(word_tokens(fold(F.col("text")))).alias("key"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, author, lang, key, n): running words of folded text, counted where a work is read. Whatever needs counts, by
    work, language or key, is a sum over this one aggregate, so its shuffle is made once a query and reused.
    """
    return tokens(spark, sf_dir).groupBy("work_id", "author", "lang", "key").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, lang, key): the different words of each work, made distinct where the work is read."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("work_id"), "lang", F.explode(F.array_distinct(word_tokens(fold(F.col("text"))))).alias("key"))


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, lang, pos, surface): running words as they are written."""
    d = table(spark, sf_dir, "documents")
    words = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return d.select(F.col("doc_id").alias("work_id"), "lang", F.posexplode(words).alias("pos", "surface"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, pos, kind, text): a conversation is a work, its turns the sections."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("work_id"), F.col("turn").alias("pos"), F.col("role").alias("kind"), "text")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, id, parent, depth, path): region, nation, customer, order as a tree; path sorts in document order."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    step: list[Column] = [F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey"), F.col("o_orderkey")]
    names = ["r", "n", "c", "o"]
    id_of = lambda k: F.concat(F.lit(names[k]), step[k].cast("string"))
    levels = [region, region.join(nation, F.col("n_regionkey") == F.col("r_regionkey"))]
    levels.append(levels[-1].join(customer, F.col("c_nationkey") == F.col("n_nationkey")))
    levels.append(levels[-1].join(orders, F.col("o_custkey") == F.col("c_custkey")))
    out = None
    for k, df in enumerate(levels):
        parent = id_of(k - 1) if k else F.lit(None).cast("string")
        rows = df.select(
            F.col("r_regionkey").cast("long").alias("root"), id_of(k).alias("id"), parent.alias("parent"), F.lit(k).alias("depth"),
            F.array(*(s.cast("long") for s in step[: k + 1])).alias("path"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, at, type, value, k): the event log; k is the stop or lexeme an event is about."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("ts").alias("at"), F.col("event_type").alias("type"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
