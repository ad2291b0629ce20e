"""What the operators share: a place for intermediate tables, size-checked broadcasts, small byte helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.shipping import ship
from lectern.sources.tables import spread

#: Words of 64 bits in a sieve at most, 16 MB; one that is full lets more through and holds back nothing that it shouldn't.
SIEVE_WORDS = 1 << 21
#: Where a hash has the six bits that name a bit of its word; the word's number is in the bits below.
_SIEVE_BITS = (24, 30, 36, 42, 48)

#: Rows up to which a narrow table (a few longs a row) may be broadcast; beyond it a shuffle join is planned.
BROADCAST_ROWS = 200_000

_made: list[tuple[SparkSession, str]] = []


def work_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; removed by ``drop``, or when the driver's Python ends."""
    path = f"{work_root(spark)}/lectern/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(clean)
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean() -> None:
    """Removes the intermediate tables of this process."""
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is temporary anyway
            pass
    _made.clear()


def drop(*tables: DataFrame | None) -> None:
    """Removes tables that ``materialise`` made and that no plan reads any more."""
    for df in tables:
        path = getattr(df, "_lectern_path", None)
        if path is not None:
            _delete(df.sparkSession, path)
            _made[:] = [m for m in _made if m[1] != path]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends here, rows and ids are fixed."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffle join, skew left to AQE).

    ``df`` should be materialised, as this counts it.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sieve(keys: DataFrame, name: str) -> Callable[[pa.Array], pa.Array]:
    """A Bloom filter of the 64-bit hashes in column ``name``: true for each of them and, wrongly, for about one in 100 others.

    What it holds back needs no join, at any size of either table; what it lets through is still to be joined. ``keys``
    should be materialised, as this reads it twice. The function is for Python workers, as an ``arrow_udf`` or in a ``map_arrow``.
    """
    ship(keys.sparkSession)
    words = min(SIEVE_WORDS, 1 << (keys.count() // 4).bit_length())
    marks = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(`{name}`, {b}) & 63 as int))" for b in _SIEVE_BITS)
    found = keys.selectExpr(f"cast(`{name}` & {words - 1} as int) as word", f"{marks} as mark").groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    table = np.zeros(words, np.int64)
    table[found["word"].to_numpy()] = found["mark"].to_numpy()

    def may(h: pa.Array) -> pa.Array:
        h = h.to_numpy(zero_copy_only=False)
        mark = np.zeros(len(h), np.int64)
        for b in _SIEVE_BITS:
            mark |= np.int64(1) << ((h >> np.int64(b)) & np.int64(63))
        return pa.array(table[h & np.int64(words - 1)] & mark == mark)

    return may


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_owner = None


def claim(clear) -> None:
    """In a Python worker: ``clear`` empties what the calling operator remembers there; what another one remembered goes now.

    Workers are used again by whatever runs next, so only one operator's memory is held at a time.
    """
    global _owner
    if _owner is not None and _owner != clear:
        _owner()
        _give_back()
    _owner = clear


def _give_back() -> None:
    """Returns what was freed to the system, where the C library can; else it stays with this worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def nothing() -> None:
    """For operators that remember nothing."""


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of any name can't clash; a column that is absent is null."""
    kinds = {"text": "string", "lang": "string", "source": "string", "doc_id": "long"}
    there = {c.lower(): c for c in df.columns}
    return df.select(*(
        (F.col(f"`{there[c]}`").cast(kinds[c]) if c in there else F.lit(None).cast(kinds[c])).alias(c) for c in columns
    ))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one in fewer parts than there are cores is spread over them."""
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
