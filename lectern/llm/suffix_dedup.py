"""Removal of long repeated strings, by sparse suffix sorting.

Of every run of LENGTH bytes (a window) the gram with the least hash is its anchor, so equal windows have equal anchors at
equal places, and one byte in about 170 starts an anchor. Only the suffixes at anchors are sorted. An anchor's context
spans the windows it stands for. Contexts that occur twice as they are are found by aggregation (of the gram's hash and the
context's, 128 bits), and one stands for all; contexts that share an anchor's gram and differ are brought together, where suffixes are ordered deep-shallow: a multikey quicksort
on words of eight bytes to a shallow depth, the gram's, and a blind trie for each group that is equal so far, once for
what follows the anchor and once for what precedes it. Common prefixes to both sides give the repeated windows exactly.

Texts are bytes; matches never cross documents; a window that starts at another place of the same document counts too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import documents, drop, materialise, partitions, sieve
from lectern.shipping import map_arrow

LENGTH, GRAM = 400, 64
#: Bytes of a document that are hashed at once; positions in a piece take the low bits of the sort key.
PIECE, LOW = 1 << 22, 23
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    for b in (_BASE, _INVERSE):
        if len(_powers.get(b, ())) < n:
            p = np.full(max(n, 1 << 17), b, np.uint64)
            p[0] = 1
            _powers[b] = np.cumprod(p, dtype=np.uint64)
    return _powers[_BASE][:n], _powers[_INVERSE][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at each position."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[:-1], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def _least(k: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    n = len(k) - w + 1
    full = np.full(-(-len(k) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(k)] = k
    full = full.reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """hash, place, first and last window of each anchor: a window's anchor is the first of its least grams."""
    found = []
    n = len(data) - length + 1
    for at in range(0, max(n, 0), PIECE):
        piece = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - at), at)
        h = gram_hashes(piece, gram)
        key = ((h >> U(LOW)) << U(LOW)) | np.arange(len(h), dtype=np.uint64)
        place = (_least(key, length - gram + 1) & U((1 << LOW) - 1)).astype(np.int64)
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]]) - 1
        found.append((h[place[lo]].view(np.int64), place[lo] + at, lo + at, hi + at))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4


def _anchored(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    ints = pa.list_(pa.int64())
    names = ["rid", "doc_id", "k", "gram", "whole", "place", "first", "last", "own_start", "own_end"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[ints] * 7]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        rows, held = [], 0
        for rid, doc_id, k, text in zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "k", "text")), strict=True):
            data = text.encode("utf-8", "replace")
            h, place, lo, hi = anchors(data, length, gram)
            view, seen, keep, own = memoryview(data), {}, [], []
            whole = np.zeros(len(h), np.int64)
            for i, (g, a, z) in enumerate(zip(h.tolist(), lo.tolist(), hi.tolist(), strict=True)):
                c = xxhash.xxh3_64_intdigest(view[a : z + length]) - (1 << 63)
                whole[i] = c
                other = seen.setdefault((g, c), i)
                if other == i:
                    keep.append(i)
                else:  # the same context in one document: both are repeated, and one of them stands for both
                    own += [(a, z + length), (int(lo[other]), int(hi[other]) + length)]
            keep = np.array(keep, np.int64)
            own = merged(own)
            rows.append((rid, doc_id, k, h[keep], whole[keep], place[keep], lo[keep], hi[keep], [s for s, _ in own], [e for _, e in own]))
            held += len(h)
            if held > 200_000:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for."""
    for b in batches:
        rows, held = [], 0
        for rid, text, wanted in zip(*(b.column(c).to_pylist() for c in ("rid", "text", "wanted")), strict=True):
            data = text.encode("utf-8", "replace")
            for w in wanted:
                rows.append({"rid": rid, "gram": w["gram"], "place": w["place"], "first": w["first"], "alone": w["alone"], "context": data[w["first"] : w["last"] + length]})
                held += len(rows[-1]["context"])
            if held > 8_000_000:
                yield pa.RecordBatch.from_pylist(rows, _CUT)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _CUT)


_CUT = pa.schema([("rid", pa.int64()), ("gram", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("alone", pa.bool_()), ("context", pa.binary())])


def shallow(strings: list[bytes], depth: int) -> list[np.ndarray]:
    """Groups of strings with the same first ``depth`` bytes, in order: multikey quicksort, eight bytes a key."""
    words = np.frombuffer(b"".join(s[:depth].ljust(depth, b"\0") for s in strings), ">u8").reshape(len(strings), -1).astype(np.uint64)
    done, todo = [], [(np.arange(len(strings)), 0)]
    while todo:
        rows, k = todo.pop()
        while k < words.shape[1] and len(rows) > 1:
            key = words[rows, k]
            pivot = key[len(key) // 2]
            less, same, more = rows[key < pivot], rows[key == pivot], rows[key > pivot]
            todo += [(part, k) for part in (more,) if len(part)]
            if len(less):
                todo.append((same, k + 1))
                rows = less
            else:
                rows, k = same, k + 1
        done.append(rows)
    return done


def common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    d = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (d.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings with long common prefixes: nodes hold a depth and a byte a branch, skipped bytes are not stored.

    A string goes down by the bytes at the nodes' depths without comparing; one comparison with the leaf it comes to
    gives the place where it branches off. Equal strings share a leaf.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # [depth, {byte: node}], or a leaf [-1, rows]
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [-1, [i]]
            return
        node = self.root
        while node[0] >= 0:
            branch = node[1]
            node = branch.get(s[node[0]] if node[0] < len(s) else -1) or next(iter(branch.values()))
        other = self.strings[node[1][0]]
        n = common(s, other)
        if n == len(s) == len(other):
            node[1].append(i)
            return
        at, up, key = self.root, None, None
        while 0 <= at[0] < n:
            up, key = at, s[at[0]]
            at = at[1][key]
        mine = s[n] if n < len(s) else -1
        if at[0] == n:
            at[1][mine] = [-1, [i]]
            return
        new = [n, {mine: [-1, [i]], (other[n] if n < len(other) else -1): at}]
        if up is None:
            self.root = new
        else:
            up[1][key] = new

    def order(self) -> tuple[list[int], list[int]]:
        """Rows in order, and the common prefix of each with the row before it (0 for the first)."""
        rows, lcp, todo = [], [], [(self.root, 0)]
        while todo:
            node, n = todo.pop()
            if node[0] < 0:
                for k, i in enumerate(node[1]):
                    rows.append(i)
                    lcp.append(n if k == 0 else len(self.strings[i]))
            else:
                kids = [node[1][b] for b in sorted(node[1])]
                todo += [(kid, node[0]) for kid in reversed(kids[1:])]
                todo.append((kids[0], n))
        return rows, lcp


def repeated(before: list[bytes], after: list[bytes], length: int) -> list[tuple[int, int] | None]:
    """How far to each side of an anchor a repeated window reaches: (bytes before, bytes after) or None.

    before: what precedes each anchor, reversed; after: what follows from it on.
    """
    n = len(after)
    left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    groups = []
    for strings in (before, after):
        rows, lcp = BlindTrie(strings).order()
        groups.append((rows, lcp))
    if n == 2:
        a, b = groups[0][1][1], min(length, groups[1][1][1])
        return [(a, b)] * 2 if a + b >= length else [None] * 2
    groups = [(np.array(rows), np.array(lcp)) for rows, lcp in groups]

    def classes(side: int, depth: int) -> np.ndarray:
        rows, lcp = groups[side]
        out = np.empty(n, np.int64)
        out[rows] = np.cumsum(lcp < depth)
        return out

    def again(a: int) -> np.ndarray:
        """Which have a window that starts ``a`` bytes before the anchor and occurs twice."""
        _, at, count = np.unique(classes(0, a) * (n + 1) + classes(1, length - a), return_inverse=True, return_counts=True)
        return count[at] > 1

    for a in sorted(set(groups[0][1].tolist()) | {0}, reverse=True):  # the furthest starts end where left parts do
        if a <= length:
            hit = again(a) & (left < 0)
            left[hit] = a
    for b in sorted({min(length, x) for x in groups[1][1].tolist()}, reverse=True):
        hit = again(length - b) & (right < 0)
        right[hit] = b
    return [(int(a), int(b)) if a >= 0 and b >= 0 else None for a, b in zip(left, right, strict=True)]


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Spans (rid, start, stop) of contexts that occur once, from rows sorted by gram hash."""
    rows: list[dict] = []
    out: list[tuple[int, int, int]] = []
    held = 0

    def work():
        after = [r["context"][r["place"] - r["first"] :] for r in rows]
        for group in shallow(after, gram):
            if len(group) < 2 or not any(rows[i]["alone"] for i in group):
                continue
            before = [rows[i]["context"][: rows[i]["place"] - rows[i]["first"]][::-1] for i in group]
            for i, far in zip(group, repeated(before, [after[i] for i in group], length), strict=True):
                if far and rows[i]["alone"]:
                    out.append((rows[i]["rid"], rows[i]["place"] - far[0], rows[i]["place"] + far[1]))

    def batch():
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rid", "start", "stop"])

    for b in batches:
        for r in b.to_pylist():
            if rows and held > 2_000_000 and r["gram"] != rows[-1]["gram"]:
                work()
                rows, held = [], 0
            rows.append(r)
            held += len(r["context"])
        if len(out) > 50_000:
            yield batch()
    if rows:
        work()
    yield batch()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            some, rows = b.slice(k, 1000), []
            for doc_id, text, found in zip(*(some.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data = text.encode("utf-8", "replace")
                spans = merged((s["start"], s["stop"]) for s in found or ())
                at, parts = 0, []
                for s, e in spans:
                    parts.append(data[at:s])
                    at = e
                rest = b"".join([*parts, data[at:]]) if spans else data
                rows.append((doc_id, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace"), rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _REMOVED.types, strict=True)], schema=_REMOVED)


def _others(batches: Iterator[pa.RecordBatch], loses: Callable[[pa.Array], pa.Array]) -> Iterator[pa.RecordBatch]:
    """Rows that surely lose nothing."""
    for b in batches:
        b = b.filter(pc.invert(loses(b.column("h"))))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.nulls(b.num_rows)], ["doc_id", "text", "spans"])


_REMOVED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("kept_bytes", pa.binary()),
])


#: What knows a row again: its id, null or not, and its text's hash. Plain columns, so that one shuffle by them serves an
#: aggregate and the join after it.
_KEY = ["id", "no_id", "k"]


def _keyed(df: DataFrame, *columns: str) -> DataFrame:
    """``columns``, the key of a row with doc_id and k, and a hash of it: ``h``."""
    key = (F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "k")
    return df.select(*columns, *key, F.xxhash64("doc_id", "k").alias("h"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text: what is left (and kept_bytes).

    Each byte covered by a ``length``-byte string that also starts anywhere else is removed, all occurrences of it,
    judged on the input. A null text is an empty one; texts under ``length`` bytes lose nothing; of repeated rows each is
    an occurrence of its own. What is left may break a character: ``text`` has U+FFFD there, kept_sha256 and kept_bytes are
    of the bytes. Whole texts are used, however long; other columns are ignored. An empty table gives an empty result.
    """
    if not 8 <= gram <= length or gram % 8:
        raise ValueError("gram is a multiple of 8 up to length")
    spark = docs.sparkSession
    rows = documents(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("k", F.xxhash64("text"))
    kinds = "rid long, doc_id long, k long, gram array<long>, whole array<long>, place array<long>, first array<long>, last array<long>, own_start array<long>, own_end array<long>"
    table = materialise(
        map_arrow(rows.withColumn("rid", F.monotonically_increasing_id()), lambda it: _anchored(it, length, gram), kinds), "anchors"
    )
    each = table.select("rid", F.explode(F.arrays_zip("gram", "whole", "place", "first", "last")).alias("a")).select("rid", "a.*")
    again = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    each = materialise(each.join(again, "gram"), "shared")

    contexts = each.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "place", "first", "last")).alias("one"))
    contexts = materialise(contexts, "contexts")
    twice = contexts.where("n > 1").select("gram", "whole")
    spans = each.join(twice, ["gram", "whole"]).select("rid", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))

    mixed = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("gram")
    ask = contexts.join(mixed, "gram").select("one.rid", F.struct("gram", "one.place", "one.first", "one.last", (F.col("n") == 1).alias("alone")).alias("w"))
    keys = _keyed(table.select("rid", "doc_id", "k"), "rid")
    ask = materialise(ask.groupBy("rid").agg(F.collect_list("w").alias("wanted")).join(keys, "rid"), "wanted")

    # Texts meet their spans by id and hash; the sieve keeps the texts that nothing asks for out of the shuffle.
    texts = _keyed(rows, "text").where(F.arrow_udf(sieve(ask, "h"), "boolean")("h")).dropDuplicates(_KEY)
    found = map_arrow(texts.join(ask, _KEY).select("rid", "text", "wanted"), lambda it: _cut(it, length), "rid long, gram long, place long, first long, alone boolean, context binary")
    found = found.repartition(partitions(spark), "gram").sortWithinPartitions("gram")
    alone = map_arrow(found, lambda it: _sorted_groups(it, length, gram), "rid long, start long, stop long")
    own = table.where(F.size("own_start") > 0).select("rid", F.explode(F.arrays_zip("own_start", "own_end")).alias("o")).select("rid", F.col("o.own_start").alias("start"), F.col("o.own_end").alias("stop"))
    spans = spans.unionByName(alone).unionByName(own).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = materialise(spans.join(keys, "rid").drop("rid").dropDuplicates(_KEY), "spans")  # rows of one id and text lose the same
    drop(table, each, contexts, ask)
    loses = sieve(spans, "h")
    whole = _keyed(rows, "doc_id", "text")
    some = whole.where(F.arrow_udf(loses, "boolean")("h")).join(spans.drop("h"), _KEY, "left").select("doc_id", "text", "spans")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, kept_bytes binary"
    rest = map_arrow(whole.select("doc_id", "text", "h"), lambda it: _removed(_others(it, loses)), kinds)
    out = map_arrow(some, _removed, kinds).unionByName(rest)
    return out if with_bytes else out.drop("kept_bytes")
