"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the benchmark items. A document's words are streamed through it; the current
state and the length of the longest match that ends at a word tell which windows of items end there. Items are taken in
blocks of a bounded number of words, an automaton each, so a large benchmark costs passes and not memory; the driver sees
neither items nor matches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import claim, documents, materialise, small, work_path
from lectern.shipping import map_arrow

#: Words of a text, spans of those that are hit (end exclusive, merged), items.
Match = tuple[int, list[tuple[int, int]], list[int]]
WINDOW = 10
#: Words of items in one automaton; a word takes a few hundred bytes of a worker.
BLOCK_WORDS = 400_000
#: A-Z become lower case; ASCII other than letters and digits becomes space.
_TO = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TO).split() if text else []


class Automaton:
    """Generalised suffix automaton of items' words; windows are runs of ``window`` words, or whole shorter items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window, self.next, self.link, self.size = window, [{}], [-1], [0]
        ends = []
        for _, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            ends.append(path)
        order = sorted(range(len(self.size)), key=self.size.__getitem__)
        #: The state with the window-long suffix of a state's strings.
        self.top = [0] * len(order)
        for v in order[1:]:
            up = self.link[v]
            self.top[v] = self.top[up] if self.size[up] >= window else v
        self.items: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for (item, words), path in zip(items, ends, strict=True):
            if len(words) >= window:
                for v in path[window - 1 :]:
                    self.items.setdefault(self.top[v], set()).add(item)
            elif words:
                v = path[-1]
                while self.size[self.link[v]] >= len(words):
                    v = self.link[v]
                short.setdefault(v, []).append((len(words), item))
        #: Short items that end where a state's strings do, by way of its suffixes.
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(order)
        for v in order[1:]:
            self.short[v] = self.short[self.link[v]] + tuple(short.get(v, ()))
        self.known = self.next[0]
        least = min((min(len(w), window) for _, w in items if w), default=window)
        self.runs = re.compile(b"\x01{%d,}" % least).finditer

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, w, q)
        new = len(size)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(size)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words (end exclusive, merged) inside occurrences of windows; the items whose windows occur."""
        spans: list[list[int]] = []
        found: set[int] = set()
        nxt, link, size, window = self.next, self.link, self.size, self.window
        for run in self.runs(bytes(map(self.known.__contains__, words))):
            v = n = 0
            for i in range(run.start(), run.end()):
                w = words[i]
                while v and w not in nxt[v]:
                    v = link[v]
                    n = size[v]
                v = nxt[v].get(w, 0)
                n = n + 1 if v else 0
                best = 0
                if n >= window:
                    best = window
                    found |= self.items.get(self.top[v], set())
                for k, item in self.short[v]:
                    if k <= n:
                        best = max(best, k)
                        found.add(item)
                if best:
                    start = i + 1 - best
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], found


_held: dict[tuple[str, int], Automaton] = {}


def _automaton(path: str, window: int) -> Automaton:
    """The automaton of a block; a worker holds one at a time."""
    if (path, window) not in _held:
        _held.clear()
        store, at = fs.FileSystem.from_uri(path)
        items: list[tuple[int, list[bytes]]] = []
        for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.path.endswith(".parquet"):
                with store.open_input_file(f.path) as file:
                    table = pq.read_table(file, columns=["item_id", "text"])
                items += [(i, words_of(t)) for i, t in zip(*(table.column(c).to_pylist() for c in ("item_id", "text")), strict=True)]
        _held[path, window] = Automaton(sorted(items), window)
    return _held[path, window]


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> list[str]:
    """Deals the items to blocks of about ``most`` words (five characters each) in the shared folder; a folder a block."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // (5 * most)))
    folder = work_path(benchmark.sparkSession, "benchmark")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))
    dealt.repartition(n, "block").write.partitionBy("block").parquet(folder)
    return [f"{folder}/block={k}" for k in range(n)]


def matches(texts: list[str | None], path: str, window: int) -> list[Match]:
    """Words, spans of hit words and items of each text, for the items of one block."""
    known = _automaton(path, window)
    found = []
    for w in map(words_of, texts):
        spans, items = known.match(w)
        found.append((len(w), _merged(spans), sorted(items, key=str)))
    return found


def _hits(batches: Iterator[pa.RecordBatch], path: str, window: int) -> Iterator[pa.RecordBatch]:
    """Documents with a hit: doc_id, k, the spans' starts and ends, items."""
    claim(_held.clear)
    for b in batches:
        got = matches(b.column("text").to_pylist(), path, window)
        rows = [
            (d, k, [s for s, _ in x], [e for _, e in x], sorted(i))
            for d, k, (_, x, i) in zip(b.column("doc_id").to_pylist(), b.column("k").to_pylist(), got, strict=True) if i
        ]
        cols = zip(*rows, strict=True) if rows else [()] * 5
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), longs, longs, longs), strict=True)], ["d", "j", "starts", "ends", "items"])


def matched(docs: DataFrame, paths: list[str], window: int, function, schema) -> DataFrame:
    """``function`` over ``docs`` (doc_id, text, ...) with a way to get at the matches of a batch.

    With one block a document meets the automaton where it is read. With several each block is a pass of its own over the
    documents, so that a worker builds an automaton once and not once a batch; documents with a hit in any are then put
    together by id and text, as matches follow from the text alone.
    """
    if len(paths) == 1:
        path = paths[0]

        def one(batches):
            claim(_held.clear)
            for b in batches:
                yield function(b, matches(b.column("text").to_pylist(), path, window))

        return map_arrow(docs, one, schema)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", key.alias("k"))
    kinds = "d long, j long, starts array<long>, ends array<long>, items array<long>"
    hits = None
    for path in paths:
        part = map_arrow(rows, lambda it, path=path: _hits(it, path, window), kinds)
        hits = part if hits is None else hits.unionByName(part)
    every = lambda c: F.flatten(F.collect_list(c)).alias(c)
    hits = materialise(hits.distinct().groupBy("d", "j").agg(*map(every, ("starts", "ends", "items"))), "hits")
    names = docs.columns
    both = docs.withColumn("__k", key).join(small(hits), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("__k") == F.col("j")), "left")

    def several(batches):
        for b in batches:
            got = []
            for text, s, e, i in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "ends", "items")), strict=True):
                got.append((len(words_of(text)), _merged(zip(s or (), e or (), strict=True)), sorted(set(i or ()), key=str)))
            yield function(b.select(names), got)

    return map_arrow(both.select(*names, "starts", "ends", "items"), several, schema)


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans of words (of its word list), and one space in place of each."""
    ends = [(m.start(), m.end()) for m in _WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : ends[a][0]])
        at = ends[b - 1][1]
    return " ".join([*(x.rstrip(" ") for x in out), text[at:].lstrip(" ")]).strip() if spans else text


_LOWER = {c: c + 32 for c in range(65, 91)}


def _report(b: pa.RecordBatch, got: list[Match]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            b.column("doc_id"), pa.array([n for n, _, _ in got], pa.int64()),
            pa.array([sum(e - s for s, e in x) for _, x, _ in got], pa.int64()), pa.array([len(x) for _, _, x in got], pa.int64()),
            pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for _, _, x in got], pa.string()),
            pa.array([bool(x) for _, x, _ in got], pa.bool_()),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words; an item without words has no window; items with a null id are left out. Repeated
    rows each give a row, and so do repeated ids; a document may have any length, its words are held once. Other columns
    are ignored. Without items nothing is hit; an empty table gives an empty result. With one block of items nothing is
    shuffled, with several the hits are.
    """
    kinds = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return matched(documents(docs, "doc_id", "text"), blocks(benchmark, block_words), window, _report, kinds)


def remove(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` (doc_id, text and others) with hit spans cut out of ``text``; documents with more than ``most`` of their words hit go.

    Rows without a hit are returned as they are, null and empty texts included.
    """
    def cleaned(b: pa.RecordBatch, got: list[Match]) -> pa.RecordBatch:
        share = [sum(e - s for s, e in x) / n if n else 0.0 for n, x, _ in got]
        new = [without(t, x) if x else t for t, (_, x, _) in zip(b.column("text").to_pylist(), got, strict=True)]
        at = b.schema.get_field_index("text")
        return b.set_column(at, "text", pa.array(new, pa.string())).filter(pa.array([s <= most for s in share], pa.bool_()))

    return matched(docs, blocks(benchmark, block_words), window, cleaned, docs.schema)
