"""Mixing sources to target weights by Pareto order sampling.

Whole copies are certain and taken first: each document gets the whole part of its source's target over its size. What the
target leaves is drawn as one more copy of some documents. A document's inclusion probability p grows with its size, as
size to the power ``tilt``, scaled so that the expected words are those left; documents that come to 1 or more are
certain. The others are ranked by (u / (1 - u)) / (p / (1 - p)) with u uniform by a hash, and a source takes them in this
order until its target is reached, so the sample is fixed in size (in words). The scale comes from running sums over a
source's different sizes. The rank isn't computed by one sort a source: sums by 4,096 slices of the rank place the cut,
and only the slice it falls in is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import documents, materialise, small

WORDS = r"[^\x20\x09-\x0D]+"
#: Slices of the rank, and the power of a document's size that its inclusion follows.
SLICES, TILT = 4096, 0.5
WEIGHTS, MOST, SEED = (1.0, 2.0, 3.0), 3.0, 11


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds target to (source, source_size): the total shared by weight, none above ``most`` times its size.

    Weights repeat along the sources by code point, null last. In order of cap / weight the capped sources come first,
    so running sums give the level at which the rest share what the capped ones leave; this is where reshared excess ends.
    The table has a row a source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("at", F.row_number().over(by_name)).withColumn("w", w.cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "at")
    up = before.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "source", "source_size", "w", "cap", F.row_number().over(before).alias("k"),
        ((F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
         / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0)))).alias("level"),
    )
    free = F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct("k", "level"))
    s = s.withColumn("first", F.min(free).over(every))
    under = F.col("first").isNotNull() & (F.col("k") >= F.col("first.k"))
    return s.select("source", "source_size", F.when(under, F.col("first.level") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def scales(sizes: DataFrame, tilt: float) -> DataFrame:
    """(of, scale) from (source, rest, size, n): the sum of least(1, scale * measure) * size over a source's documents is rest.

    From the largest size down, sizes are certain as long as they would come to more than 1. Sums are of whole numbers, so
    reruns agree to the bit.
    """
    exact = lambda x: x.cast("decimal(38,0)")
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    words = F.sum(exact(F.col("n") * F.col("size")))
    cells = sizes.where("size > 0 and rest > 0").withColumn("m", measure("size", tilt))
    cells = cells.select(
        "source", "rest", "size", "m", F.coalesce(words.over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double").alias("sure"),
        F.sum(exact(F.col("n") * F.col("size")) * exact(F.col("m"))).over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double").alias("open"),
    )
    cells = cells.withColumn("scale", (F.col("rest") - F.col("sure")) / F.col("open"))
    fit = cells.where(F.col("scale") * F.col("m") <= 1)
    return fit.groupBy(F.col("source").alias("of")).agg(F.max_by("scale", "size").alias("scale"))


def measure(size: str, tilt: float) -> Column:
    """What the inclusion of a document is in proportion to, as a whole number."""
    return F.round(F.pow(F.col(size), F.lit(float(tilt))) * 1024).cast("long")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """Adds size, key and the random number u, which follow from id, text and seed alone."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.withColumn("size", size).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.withColumn("u", (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "key"), 11) + 0.5) / float(2**53))


def _ranked(rows: DataFrame, sources: DataFrame, slices: int, tilt: float) -> DataFrame:
    """Adds a source's columns, and place: where a document stands in its source's order, (rank, id, key, size)."""
    p = F.least(F.lit(1.0), F.coalesce("scale", F.lit(0.0)) * measure("size", tilt))
    odds = F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p"))
    rank = F.when(F.col("p") > 1e-12, odds / (1 + odds)).otherwise(1.0)  # 0 for certain ones, and in the order of the ratio of odds
    ranked = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("p", p).withColumn("rank", rank)
    place = F.struct("rank", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "key", "size")
    return ranked.withColumn("slice", F.least(F.lit(slices - 1), F.floor(F.col("rank") * slices)).cast("int")).withColumn("place", place)


def plan(docs: DataFrame, weights: tuple[float, ...], most: float, seed: int, slices: int, tilt: float) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): the sized documents, and a row a source with target, whole copies, scale and where its order is cut.

    A document gets its copies from its own row and its source's, wherever it is read; texts are never shuffled.
    """
    rows = materialise(_sized(documents(docs, "doc_id", "source", "text"), seed).drop("text"), "mix-docs")
    sizes = materialise(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    by_source = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = targets(by_source, weights, most).withColumnRenamed("source", "of")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(each + 1e-9))
    goal = materialise(goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "mix-goal")
    by_size = sizes.join(small(goal).select("of", "rest"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    scale = scales(by_size, tilt).withColumnRenamed("of", "scaled")
    goal = materialise(goal.join(scale, F.col("of").eqNullSafe(F.col("scaled")), "left").drop("scaled"), "mix-scales")

    ranked = _ranked(rows, small(goal), slices, tilt)
    cells = ranked.groupBy("source", "rest", "slice").agg(F.sum("size").alias("cell"))
    up = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("above", F.coalesce(F.sum("cell").over(up), F.lit(0)))
    cut = materialise(
        cells.where((F.col("above") < F.col("rest")) & (F.col("above") + F.col("cell") >= F.col("rest")))
        .select(F.col("source").alias("cut_of"), F.col("slice").alias("at"), "above"), "mix-cut",
    )
    order = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    edge = ranked.join(small(cut), F.col("source").eqNullSafe(F.col("cut_of")) & (F.col("slice") == F.col("at")))
    edge = edge.withColumn("run", F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = edge.where(F.col("above") + F.col("run") + F.col("size") / 2 <= F.col("rest")).groupBy(F.col("source").alias("last_of")).agg(F.max("place").alias("last"))
    goal = goal.join(cut.drop("above"), F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of")
    goal = goal.join(last, F.col("of").eqNullSafe(F.col("last_of")), "left").drop("last_of")
    at = F.coalesce("at", F.when(F.col("rest") > 0, F.lit(slices)).otherwise(F.lit(-1)))
    return rows, materialise(goal.withColumn("at", at), "mix-sources")


def with_copies(rows: DataFrame, sources: DataFrame, slices: int, tilt: float) -> DataFrame:
    """``rows`` with size, key and u, and a source's columns, and how many copies of each the mix takes."""
    ranked = _ranked(rows, small(sources), slices, tilt)
    extra = (F.col("slice") < F.col("at")) | ((F.col("slice") == F.col("at")) & F.coalesce(F.col("place") <= F.col("last"), F.lit(False)))
    return ranked.withColumn("copies", (F.col("whole") + extra.cast("long")).cast("long"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, slices: int = SLICES, tilt: float = TILT
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken (= copies * size).

    A document's copies are floor(e) or floor(e) + 1 with e = target / source_size, so at most ``most`` where that is
    whole. The words taken differ from the target by at most half the document at the cut. ``tilt`` 0 gives all documents of
    a source the same inclusion, 1 one in proportion to their size. A null or empty text has size 0; a null source is a
    source of its own; repeated rows are documents of their own, but rows of one id and text are taken together. Sizes are
    counted over whole texts; other columns are ignored. The same rows give the same result. An empty table gives an empty
    result.
    """
    rows, sources = plan(docs, weights, most, seed, slices, tilt)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return with_copies(rows, sources, slices, tilt).select("doc_id", "size", "source_size", "target", "copies", taken, "source")


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, slices: int = SLICES, tilt: float = TILT
) -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as ``mix`` takes it."""
    _, sources = plan(docs, weights, most, seed, slices, tilt)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = _sized(docs.select(*(F.col(c).cast(k) for c, k in (("doc_id", "long"), ("source", "string"), ("text", "string"))), whole), seed)
    rows = with_copies(rows, sources, slices, tilt).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
