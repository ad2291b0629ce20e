"""Token ids in binary shards: each document a zstandard frame under one shared dictionary, with an offset index.

A shard is
    magic "LTK1", width of an id in bytes (u1), 3 zero bytes, SHA-256 of the dictionary (32 bytes)
    one frame a document, in ascending document order
    index: for each document i8 id, u1 id is null, u8 offset, u4 length of the frame, u4 ids
    footer: u8 offset of the index, u8 documents, u8 ids, magic
all little-endian. The dictionary is a file of its own, named by its hash, next to the shards. A document can be read by
its index row alone. A task writes under a name of its own and renames at the end, so retries and speculative copies
leave whole shards only.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import claim, documents, nothing, partitions
from lectern.shipping import map_arrow

MAGIC = b"LTK1"
HEAD = struct.Struct("<4sB3x32s")
ROW = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("ids", "<u4")])
FOOT = struct.Struct("<QQQ4s")
#: Documents and bytes of them that the dictionary is trained on; it changes sizes, never ids.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 4_000_000, 64 * 1024
#: Distinct pieces that a worker remembers (about 140 bytes each; more would double the table's size), and the length of those
#: that stay when there are more; documents and characters that are encoded at once.
MEMO, FREQUENT, DOCS, AT_ONCE = 1_200_000, 6, 1000, 1_000_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens added.

    A byte-level tokenizer with the usual pattern never joins what lies before a space that a non-space follows with
    what comes after it. Texts are cut there and each distinct piece is encoded once by the library. Other kinds of
    tokenizer get whole texts.
    """

    def __init__(self, path: str, memory: int = MEMO):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", ()))
        )
        begins = [t.startswith("\u0120") for t, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])]
        #: Whether an id's bytes begin with a space.
        self.spaced = np.array(begins if self.cuts else [], bool)
        self.width = 2 if self.library.get_vocab_size() <= 65_536 else 4
        self.known: dict[str, bytes] = {}
        self.memory = memory
        self.odd = re.compile(r" (?:\s|\Z)").search
        self.cut = re.compile(r"(?= \S)").split

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, none of which holds a space: many are encoded in a row, an id that begins with a space begins one."""
        out: list[bytes] = []
        rows = [pieces[k : k + 1000] for k in range(0, len(pieces), 1000)]
        for row, e in zip(rows, self.library.encode_batch_fast([" " + " ".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            at = (np.flatnonzero(self.spaced[ids]) * 4).tolist()
            if len(at) != len(row):
                out += self._plain([" " + p for p in row])
                continue
            b = ids.tobytes()
            out += [b[i:j] for i, j in zip(at, [*at[1:], len(b)], strict=True)]
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if not self.cuts:
            for t in texts:
                yield from self._plain([t])
            return
        for some in _by_size(texts, AT_ONCE):
            odd = [self.odd(t) is not None for t in some]
            # a piece stands for itself with a space before it; the first of a text and those of odd texts are as they are, behind a space as a mark
            pieces = [[" " + p for p in self.cut(t)] if o else t.split(" ") for t, o in zip(some, odd, strict=True)]
            for p, o in zip(pieces, odd, strict=True):
                if not o:
                    p[0] = " " + p[0]
            if len(self.known) > self.memory:
                self.known = {p: b for p, b in self.known.items() if len(p) <= FREQUENT}
                if len(self.known) > self.memory // 2:
                    self.known.clear()
            new = list(set().union(*pieces).difference(self.known))
            first, rest = [p for p in new if p[:1] == " "], [p for p in new if p[:1] != " "]
            self.known.update(zip(first, self._plain([p[1:] for p in first]), strict=True))
            self.known.update(zip(rest, self._pieces(rest), strict=True))
            for p in pieces:
                yield b"".join(map(self.known.__getitem__, p))


def _by_size(texts: list[str], most: int) -> Iterator[list[str]]:
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n >= most:
            yield some
            some, n = [], 0
    if some:
        yield some


def encoder(path: str, memory: int = MEMO) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, memory)
    return _encoders[path]


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A dictionary from the id arrays of about SAMPLE_DOCS different documents, picked by a hash; b"" if too few."""
    import zstandard

    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    short = docs.where(F.length("text").between(1, 20_000)).select("text", F.xxhash64("text").alias("h"))
    picked = short.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["h"]).limit(2 * SAMPLE_DOCS)
    texts, n = [], 0
    for t, _ in sorted(picked.collect(), key=lambda r: r[1]):
        n += len(t)
        if n <= SAMPLE_BYTES:
            texts.append(t)
    enc = encoder(tokenizer)
    samples = [_narrow(b, enc.width) for b in enc.encode(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def _write_shard(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, dictionary: bytes, end_id: int, memory: int):
    import zstandard

    claim(_encoders.clear)
    enc, digest, ctx = encoder(tokenizer, memory), hashlib.sha256(dictionary).digest(), TaskContext.get()
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    store, base = fs.FileSystem.from_uri(folder)
    part, tail = ctx.partitionId(), np.asarray([end_id], "<u4").tobytes()
    name, temp = f"{base}/shard-{part:06d}.ltk", f"{base}/.shard-{part:06d}-{ctx.taskAttemptId()}"
    out, rows, at, total = None, [], HEAD.size, 0
    for batch in (b.slice(k, DOCS) for b in batches for k in range(0, b.num_rows, DOCS)):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for doc_id, b in zip(ids, enc.encode(texts), strict=True):
            if out is None:
                out = store.open_output_stream(temp)
                out.write(HEAD.pack(MAGIC, enc.width, digest))
            b += tail
            frame = press.compress(_narrow(b, enc.width))
            out.write(frame)
            rows.append((doc_id or 0, doc_id is None, at, len(frame), len(b) // 4))
            at, total = at + len(frame), total + len(b) // 4
    if out is not None:
        out.write(np.array(rows, ROW).tobytes())
        out.write(FOOT.pack(at, len(rows), total, MAGIC))
        out.close()
        store.move(temp, name)
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name.rsplit("/", 1)[1], "docs": len(rows), "ids": total}])


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, memory: int = MEMO) -> list[dict]:
    """Writes the ids of every whole text, then ``end_id``, in ascending doc_id order, to ``folder``; returns the manifest.

    The manifest has a row a shard: part, name, docs, ids, start (ids in all shards before it). It is also written, as
    manifest.json. A null or empty text has the end id alone; null ids come first; rows of one id are ordered by a hash
    of their text, and all are written. ``memory``: pieces of text that a worker remembers, about 140 bytes each; it changes
    speed alone. Whole texts are encoded, other columns are ignored. An empty table gives no shard. Documents are dealt by sampled ranges of the id.
    """
    spark = docs.sparkSession
    rows = documents(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    dictionary = train_dictionary(rows, tokenizer)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/dictionary-{hashlib.sha256(dictionary).hexdigest()}.zdict") as f:
        f.write(dictionary)
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    told = map_arrow(rows, lambda it: _write_shard(it, tokenizer, folder, dictionary, end_id, memory), "part long, name string, docs long, ids long"
    )
    shards, start = [], 0
    for r in sorted(told.collect(), key=lambda r: r["part"]):  # a row a shard
        shards.append(r.asDict() | {"start": start})
        start += r["ids"]
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"end_id": end_id, "tokenizer": tokenizer.rsplit("/", 1)[-1], "shards": shards}).encode())
    return shards


def read_shard(folder: str, name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a shard, in order; the file is read a frame at a time."""
    import zstandard

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/{name}") as f:
        magic, width, digest = HEAD.unpack(f.read(HEAD.size))
        f.seek(f.size() - FOOT.size)
        at, n, _, last = FOOT.unpack(f.read(FOOT.size))
        if magic != MAGIC or last != MAGIC:
            raise ValueError(f"{name} is not a whole shard")
        with store.open_input_stream(f"{base}/dictionary-{digest.hex()}.zdict") as d:
            dictionary = d.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {name} is another one")
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        f.seek(at)
        index = np.frombuffer(f.read(n * ROW.itemsize), ROW)
        f.seek(HEAD.size)
        for r in index:
            ids = np.frombuffer(press.decompress(f.read(int(r["length"])), max_output_size=int(r["ids"]) * width), f"<u{width}")
            yield (None if r["null"] else int(r["doc_id"])), ids.astype("<u4")


def _read_shards(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool):
    claim(nothing)  # what the encoder remembered goes here, before other work starts
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        + [("ids", pa.list_(pa.int64()))] * with_ids
    )
    for batch in batches:
        for s in batch.to_pylist():
            start, rows, held = s["start"], [], 0
            for doc_id, ids in read_shard(folder, s["name"]):
                row = {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
                rows.append(row | ({"ids": ids.tolist()} if with_ids else {}))
                start, held = start + len(ids), held + len(ids) * with_ids
                if len(rows) >= 10_000 or held > 1_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_tokens(spark: SparkSession, folder: str, shards: list[dict], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the files; a task a shard."""
    kinds = "part long, name string, docs long, ids long, start long"
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    table = spark.createDataFrame([tuple(s[k] for k in ("part", "name", "docs", "ids", "start")) for s in shards], kinds)
    return map_arrow(table.repartition(max(1, len(shards)), "part"), lambda it: _read_shards(it, folder, with_ids), out)
