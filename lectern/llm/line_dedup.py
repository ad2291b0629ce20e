"""Cross-site boilerplate lines by distinct-site spread.

Lines that occur as often as there must be sites are sketched: a HyperLogLog of sites a line hash, merged by aggregation.
A line well above the threshold is boilerplate, one well below is not, and only the lines near it get exact counts of
distinct sites. Lines are known by a hash of 128 bits from then on; texts move only for documents that lose a line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import documents, materialise, small
from lectern.shipping import map_arrow

SITES, LOG_K = 8, 12
#: Share of the threshold to both sides within which lines are counted exactly: over six standard errors at 2^12 registers.
NEAR = 0.12


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h) of the lines (h, site) that at least ``sites`` distinct sites have."""
    often = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).select("h")
    some = materialise(lines.join(small(materialise(often, "often")), "h"), "often-lines")
    about = some.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("about"))
    about = materialise(about.where(F.col("about") >= sites * (1 - NEAR) - 1), "about")
    far = F.col("about") > sites * (1 + NEAR) + 1
    near = small(about.where(~far).select("h"))
    exact = some.join(near, "h").select("h", "site").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return about.where(far).select("h").unionByName(exact.where(F.col("n") >= sites).select("h"))


def _without(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, sha, texts = [], [], [], []
        for text, at in zip(b.column("text").to_pylist(), b.column("at").to_pylist(), strict=True):
            lines, drop = text.split("\n"), set(at)
            rest = "\n".join(x for k, x in enumerate(lines) if k not in drop)
            n.append(len(lines))
            gone.append(len(drop))
            sha.append(hashlib.sha256(rest.encode("utf-8", "replace")).hexdigest())
            texts.append(rest if with_text else None)
        cols = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_lines", "n_removed", "kept_sha256", "kept_text"])


def line_dedup(docs: DataFrame, sites: int = SITES, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_sha256 (and kept_text).

    Lines are what newlines part, compared as they are; a line of spaces alone is never boilerplate. A site is a source,
    null being one of its own. A null text is an empty one, which has one empty line. All occurrences of a boilerplate line
    go. Texts and lines may have any length; other columns are ignored. Repeated rows each give a row; an empty table gives
    an empty result.
    """
    rows = documents(docs, "doc_id", "text", "source").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("k", F.xxhash64("text"))
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    lines = rows.select("doc_id", "k", site.alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.where(F.length(F.trim("line")) > 0).select("doc_id", "k", "site", "at", F.unhex(F.md5(F.col("line").cast("binary"))).alias("h"))
    gone = materialise(boilerplate(lines.select("h", "site"), sites), "boilerplate")
    hits = lines.join(small(gone), "h").groupBy("doc_id", "k").agg(F.collect_set("at").alias("at"))
    hits = materialise(hits.select(F.col("doc_id").alias("d"), F.col("k").alias("j"), "at"), "line-hits")
    same = lambda y: rows["doc_id"].eqNullSafe(y["d"]) & (rows["k"] == y["j"])
    keys = small(hits.select("d", "j"))
    clean = rows.join(keys, same(keys), "left_anti").select(
        "doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"), (F.col("text") if with_text else F.lit(None).cast("string")).alias("kept_text"),
    )
    touched = rows.join(keys, same(keys), "left_semi")
    touched = touched.join(hits, touched["doc_id"].eqNullSafe(hits["d"]) & (touched["k"] == hits["j"])).select("doc_id", "text", "at")
    kinds = "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept_text string"
    out = clean.unionByName(map_arrow(touched, lambda it: _without(it, with_text), kinds))
    return out if with_text else out.drop("kept_text")
