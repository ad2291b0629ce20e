"""MinHash near-duplicates by chosen paths.

Each different shingle set gets a sketch of 128 min-hashes. A tree sends a set down a path: at each node a coordinate,
chosen by a hash of the path, names the branch. Sets with similarity s follow the same branch with probability s. After
START steps the sets of a node are compared exhaustively, on their full sets, if they are few enough for one task; larger
nodes branch on along 1.25 coordinates in the mean, so that sets with s = 0.8 stay together in one branch in expectation.
Independent trees repeat this. A pair of similarity s meets with probability 1 - (1 - s^START)^TREES.

Trees are taken in turns. A turn's links are put together to components before the next turn, which then looks at nodes
that still hold several components only: what one tree has joined costs the others nothing. Tasks keep a union-find of
their node, so a node with k components gives at most k - 1 links, however many pairs it has. What branching has left
apart in nodes that are large at START is closed at the end: the sets outside such a node's commonest component meet all
its sets, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import claim, documents, drop, materialise, partitions
from lectern.shipping import map_arrow

COORDS, START, DEEPEST = 128, 4, 10
#: Trees that are searched between one labelling and the next; 24 in all.
TURNS = (1, 23)
#: A set weighs one, and one more for every UNIT shingles; sets of BLOCK in weight, 4 kB each, are compared in one task.
UNIT, BLOCK = 512, 2048
MEMO = 400_000
U = np.uint64
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[w] = v = xxhash.xxh3_64_intdigest(w)
        return v


_hashes = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 2-word shingles; of the word itself if there is one only."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # of bytes: A-Z and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if len(h) == 1:
        return _mix(h)
    return np.unique(_mix(h[:-1] * U(0x9E3779B97F4A7C15) + ((h[1:] << U(31)) | (h[1:] >> U(33)))))


def sketch(s: np.ndarray) -> np.ndarray:
    """16 bits of each min-hash."""
    a, b = _A[:, None], _B[:, None]
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 1024):
        np.minimum(low, (s[None, k : k + 1024] * a + b).min(1), out=low)
    return (_mix(low) >> U(48)).astype(np.uint16)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim(_hashes.clear)
    for b in batches:
        sets, sketches, n = [], [], []
        for text in b.column("text").to_pylist():
            s = shingles(text)
            n.append(len(s))
            sets.append(xxhash.xxh3_128_digest(s.tobytes()))
            sketches.append(sketch(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("h"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sketches, pa.binary())],
            ["doc_id", "h", "n", "same", "sketch"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDS)


def _step(node: np.ndarray, sk: np.ndarray, salt: int) -> np.ndarray:
    at = _mix(node + U(salt)) % U(COORDS)
    value = sk[np.arange(len(sk)), at.astype(np.int64)].astype(np.uint64)
    return _mix(node * U(0x9E3779B97F4A7C15) ^ _mix(value + (at << U(20)) + U(1)))


def _roots(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    """Where each set is after START steps in each tree."""
    for b in batches:
        sk = _matrix(b.column("sketch"))
        for tree in range(trees):
            node = np.full(len(sk), _mix(np.array([tree + 1], np.uint64))[0], np.uint64)
            for _ in range(START):
                node = _step(node, sk, 17)
            cols = [pa.array(np.full(len(sk), tree, np.int32)), pa.array(node.view(np.int64)), b.column("v"), b.column("w")]
            yield pa.RecordBatch.from_arrays(cols, ["tree", "node", "v", "w"])


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One step on, for a quarter of the nodes along two coordinates."""
    for b in batches:
        sk = _matrix(b.column("sketch"))
        v, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("v", "w"))
        node = b.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
        two = _mix(node + U(5)) % U(4) == 0
        out = np.concatenate([_step(node, sk, 17), _step(node, sk, 71)[two]])
        cols = [out.view(np.int64), np.concatenate([v, v[two]]), np.concatenate([w, w[two]])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "v", "w"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim(_hashes.clear)
    for b in batches:
        for k in range(0, b.num_rows, 256):
            some = b.slice(k, 256)
            got = [shingles(t).tobytes() for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("v"), pa.array(got, pa.binary())], ["v", "full"])


def links_within(v: np.ndarray, label: np.ndarray, odd: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets of different labels that put together all components the pairs with an odd end make.

    A set is compared with all sets of other components at once. Sets of the largest component needn't be: all others are
    odd, so each of them meets it in its own turn.
    """
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(v)), size)
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    _, comp = np.unique(label, return_inverse=True)
    open_, out = odd.astype(bool).copy(), []
    while True:
        count = np.bincount(comp)
        if (count > 0).sum() < 2:
            return out
        most = count.argmax()
        rest = comp != most
        todo = np.flatnonzero(open_ & rest if odd[rest].all() else open_)
        if not len(todo):
            return out
        k = todo[0]
        open_[k] = False
        mine = np.zeros(len(names), bool)
        mine[at[ends[k] - size[k] : ends[k]]] = True
        both = np.bincount(row[mine[at]], minlength=len(v))
        linked = np.flatnonzero((comp != comp[k]) & (100 * both >= percent * (size[k] + size - both)))
        if len(linked):
            joined, first = np.unique(comp[linked], return_index=True)
            out += [(int(v[k]), int(v[j])) for j in linked[first]]
            comp[np.isin(comp, joined)] = comp[k]


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links in each block of rows sorted by block; rows of a block may come in several batches."""
    held: list[tuple[int, bool, bytes, int]] = []
    block, out = None, []

    def work():
        v, first = np.unique(np.array([h[0] for h in held], np.int64), return_index=True)
        if len(v) < 2:
            return
        odd = np.zeros(len(v), bool)
        np.logical_or.at(odd, np.searchsorted(v, [h[0] for h in held]), [h[1] for h in held])
        label = np.array([held[k][3] for k in first], np.int64)
        out.extend(links_within(v, label, odd, [np.frombuffer(held[k][2], np.uint64) for k in first], percent))

    def rows():
        a, b = zip(*out, strict=True) if out else ((), ())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for b in batches:
        for key, *r in zip(*(b.column(c).to_pylist() for c in ("block", "v", "odd", "full", "label")), strict=True):
            if key != block:
                work()
                held.clear()
                block = key
            held.append(tuple(r))
        if len(out) > 50_000:
            yield rows()
    work()
    yield rows()


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of the vertices of ``edges`` (a, b): label is the smallest vertex of the component.

    Alternating large and small stars; each step is an aggregate and a join by vertex, whose hubs AQE splits. The edges
    are written after each round, so a lost executor costs one step; rounds grow with the logarithm of a path's length.
    """
    def spread(e, low):
        m = e.groupBy("u").agg(F.least("u", F.min("w")).alias("m"))
        e = e.join(m, "u")
        e = e.select(F.col("w").alias("u"), "m").where(F.col("u") > F.col("m")) if not low else e.select(F.col("w").alias("u"), "m").where(F.col("u") != F.col("m"))
        if low:
            e = e.unionByName(m.where("u != m").select("u", "m"))
        return e.select(F.col("u"), F.col("m").alias("w")).distinct()

    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct()
    sign = last = None
    while True:
        both = edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        large = spread(both, False)
        edges = materialise(spread(large, True), "stars")
        drop(last)
        last = edges
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w") % (1 << 40))).first()
        if now == sign:
            break
        sign = now
    heads = edges.select(F.col("w").alias("v"), F.col("w").alias("label")).distinct()
    return edges.select(F.col("u").alias("v"), F.col("w").alias("label")).unionByName(heads)


class _Search:
    """Labels of components over the sets (v, w, sketch, doc_id, h), and the turns that put components together."""

    def __init__(self, sets: DataFrame, full: DataFrame, percent: int):
        self.sets, self.full, self.percent = sets, full, percent
        self.parts = partitions(sets.sparkSession)
        self.labels: DataFrame | None = None

    def label(self, rows: DataFrame, col: str = "v", to: str = "label") -> DataFrame:
        """Adds the label of ``col``; a set that nothing is linked to is its own."""
        if self.labels is None:
            return rows.withColumn(to, F.col(col))
        known = self.labels.select(F.col("v").alias(col), F.col("label").alias(to))
        return rows.join(known, col, "left").withColumn(to, F.coalesce(to, col))

    def mixed(self, rows: DataFrame) -> DataFrame:
        """(node, v, w, label, whole) of the nodes that hold several components; whole is the node's weight."""
        rows = self.label(rows)
        nodes = rows.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("w").alias("whole"))
        return materialise(rows.join(nodes.where("low != high").select("node", "whole"), "node"), "mixed")

    def compare(self, blocks: DataFrame) -> None:
        """Compares the sets of each block (block, v, label, odd) and puts the components of linked ones together."""
        rows = blocks.join(self.full, "v").select("block", "v", "label", "odd", "full")
        rows = rows.repartition(self.parts, "block").sortWithinPartitions("block")
        percent = self.percent
        links = materialise(map_arrow(rows, lambda it: _linked(it, percent), "a long, b long"), "links")
        if links.isEmpty():
            return
        if self.labels is None:
            self.labels = materialise(components(links), "labels")
            drop(links)
            return
        over = self.label(self.label(links, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        heads = materialise(components(over), "over")
        old = self.labels.join(heads.select(F.col("v").alias("label"), F.col("label").alias("new")), "label", "left")
        new = heads.join(self.labels.select("v"), "v", "left_anti")
        done = self.labels
        self.labels = materialise(old.select("v", F.coalesce("new", "label").alias("label")).unionByName(new), "labels")
        drop(links, heads, done)

    def turn(self, rows: DataFrame) -> None:
        """Compares the nodes (node, v, w) that are small enough, and sends the sets of the others on."""
        rows = self.mixed(rows)
        made = [rows]
        leaves = rows.where(F.col("whole") <= BLOCK).select("node", "v", "label")
        for depth in range(START, DEEPEST + 1):
            large = rows.where(F.col("whole") > BLOCK)
            if large.isEmpty():
                break
            if depth == DEEPEST:  # sets that agree in as many coordinates: in blocks, in an order of the node's own
                part = F.pmod(F.xxhash64("node", "v"), F.ceil(F.col("whole") / BLOCK).cast("long"))
                leaves = leaves.unionByName(large.select(F.xxhash64("node", part).alias("node"), "v", "label"))
                break
            on = large.select("node", "v", "w").join(self.sets.select("v", "sketch"), "v")
            rows = self.mixed(map_arrow(on.select("node", "v", "w", "sketch"), _branches, "node long, v long, w long").distinct())
            made.append(rows)
            leaves = leaves.unionByName(rows.where(F.col("whole") <= BLOCK).select("node", "v", "label"))
        self.compare(leaves.select(F.col("node").alias("block"), "v", "label", F.lit(True).alias("odd")))
        drop(*made)

    def close(self, large: DataFrame) -> None:
        """Compares what is not of the commonest component of its node (node, v, w) with all sets there, in blocks.

        Where a node, or what is odd in it, weighs more than BLOCK it is sliced, and odd slices meet all slices.
        """
        rows = self.mixed(large)
        sizes = rows.groupBy("node", "label").agg(F.sum("w").alias("part"), F.first("whole").alias("whole"))
        nodes = sizes.groupBy("node").agg(F.max_by("label", F.struct("part", "label")).alias("common"), F.max("part").alias("part"), F.first("whole").alias("all"))
        slices = lambda c: F.ceil(c / BLOCK).cast("int")
        nodes = nodes.select("node", "common", slices(F.col("all")).alias("slices"), slices(F.col("all") - F.col("part")).alias("chunks"))
        rows = rows.join(nodes, "node").withColumn("odd", F.col("label") != F.col("common"))
        mine = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
        whole = rows.select("node", "v", "label", F.lit(False).alias("odd"), mine("slices").alias("s"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"))
        odd = rows.where("odd").select("node", "v", "label", "odd", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s"), mine("chunks").alias("c"))
        self.compare(whole.unionByName(odd).select(F.xxhash64("node", "s", "c").alias("block"), "v", "label", "odd"))


def near_dedup(docs: DataFrame, percent: int = 80, turns: tuple[int, ...] = TURNS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, and key, the xxhash64 of the text.

    Two texts are linked if 100 * intersection >= percent * union of their sets of 2-word shingles, lower-cased; linked
    texts are of one component, named by its smallest doc_id. ``turns``: how many trees are searched between one labelling
    and the next. A null text, or one without words, has the empty set and is linked with nothing; ties and repeated rows
    have one component, and all rows with the kept id are kept. A row with a null id is never kept unless it stands alone
    (its component is then null). Whole texts count, however long they are; other columns are ignored. An empty table gives
    an empty result.
    """
    rows = documents(docs, "doc_id", "text").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    kinds = "doc_id long, h long, n long, same binary, sketch binary"
    signed = materialise(map_arrow(rows, _signed, kinds), "signed")
    same = signed.where("n > 0").groupBy("same").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")).alias("rep"), F.max("sketch").alias("sketch"), F.max("n").alias("n"),
    )
    sets = materialise(
        same.select(
            F.monotonically_increasing_id().alias("v"), "same", F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h"),
            "sketch", (1 + F.col("n") / UNIT).cast("long").alias("w"),
        ), "sets",
    )
    trees = sum(turns)
    roots = map_arrow(sets.select("v", "w", "sketch"), lambda it: _roots(it, trees), "tree int, node long, v long, w long")
    nodes = roots.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("all")).where("n > 1").select("node", "all")
    roots = materialise(roots.join(nodes, "node"), "roots")

    keys = sets.join(roots.select("v").distinct(), "v", "left_semi").select("v", F.col("doc_id").alias("d"), F.col("h").alias("k"))
    texts = rows.join(keys, rows["doc_id"].eqNullSafe(keys["d"]) & (rows["h"] == keys["k"])).select("v", "text").dropDuplicates(["v"])
    full = materialise(map_arrow(texts, _full, "v long, full binary"), "full")

    search = _Search(sets, full, percent)
    tree = 0
    for n in turns:
        search.turn(roots.where(F.col("tree").between(tree, tree + n - 1)).select("node", "v", "w"))
        tree += n
    large = roots.where(F.col("all") > BLOCK).select("node", "v", "w")
    if not large.isEmpty():
        search.close(large)
    drop(roots, full)

    labelled = search.label(sets.select("v", "same", "doc_id"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(least, "label")
    out = signed.drop("sketch").join(named.select("same", F.col("component_id").alias("of")), "same", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("of"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("h").alias("key"))
