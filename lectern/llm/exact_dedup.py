"""Exact duplicates by a content sort.

Sampled splitters deal rows to ranges of (first characters, 64-bit hash, salt); Spark's external sort puts equal texts
next to each other and the window operator compares neighbours by their full text. Splitters are a bounded prefix and
two integers, so the sample that reaches the driver stays small however long the texts are. A text that makes up more
than 1/(4P) of the rows (P: shuffle partitions; there are at most 4P of those) is dealt to several salts, and the parts'
survivors are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import documents, materialise, partitions

HEAD = 32


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if all their bytes are; a null text is an empty one. ``keep``: "smallest" or "largest" id stays.
    Null ids come last, so one stays only where the whole group has none; of rows with the same id and text exactly one
    is kept. An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    rows = documents(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("h", F.xxhash64("text"))
    parts, total = 4 * partitions(spark), max(1, docs.count())
    hot = (
        rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") * parts > total)
        .select("h", F.ceil(F.col("n") * parts / F.lit(total)).cast("long").alias("salts"))
    )  # at most 4P rows, by the threshold
    rows = rows.join(F.broadcast(hot), "h", "left").select(
        "doc_id", "text", "h", "salts", F.substring("text", 1, HEAD).alias("head"),
        F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).alias("salt"),
    )
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    same = Window.partitionBy("head", "h", "salt", "text")
    best = F.min if keep == "smallest" else F.max
    part = rows.repartitionByRange("head", "h", "salt").select(
        "doc_id", "h", "salts", F.sha2("text", 256).alias("text_sha256"),
        best("doc_id").over(same).alias("part_keep"), F.count(F.lit(1)).over(same).alias("part_size"),
        F.row_number().over(same.orderBy(order)).alias("nth"),
    )
    part = materialise(part, "exact")
    whole = (
        part.where(F.col("salts").isNotNull() & (F.col("nth") == 1)).groupBy("h", "text_sha256")
        .agg(best("part_keep").alias("whole_keep"), F.sum("part_size").alias("whole_size"))
    )  # the hot texts again: at most 4P rows
    part = part.join(F.broadcast(whole), ["h", "text_sha256"], "left").withColumn("hot", F.col("whole_size").isNotNull())
    keep_id = F.when(F.col("hot"), F.col("whole_keep")).otherwise(F.col("part_keep"))
    return part.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("whole_size", "part_size").cast("long").alias("group_size"),
        ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"), "text_sha256",
    )
