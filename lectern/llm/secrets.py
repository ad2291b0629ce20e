"""Secret scans with corpus-wide ownership.

Patterns give base spans. They and further random-looking tokens are candidates; their values' hashes are aggregated over
the corpus by distinct owners (sources) and repositories (documents). A value is a copied example if several owners have it in
texts that differ, or if it is widely copied, in EXAMPLE_REPOS documents or more of any owners; else it looks live. So a copy of
a whole document at another owner makes no example of what it holds. A token that no base span overlaps is added as a span of
kind "owned" if it looks live. Counting goes by (value, owner) first, so a value that a third of the documents hold is summed
where it is read; only the examples' hashes go back to the documents, by broadcast where they are few, else in a join whose
hot values AQE splits.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import documents, materialise, small
from lectern.shipping import map_arrow

#: Fixed values of the base patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "owned")
#: Owners from which on a value is a copied example, if their texts differ, and documents from which on it is one anyway: more
#: than an owner's few uses of a credential, or than copies of a document, come to. What a further token must have.
EXAMPLE_OWNERS, EXAMPLE_REPOS, TOKEN_LENGTH, TOKEN_BITS = 2, 10, 20, 3.5

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
_hex = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more: what the greedy pattern keeps
_token = re.compile(rf"[A-Za-z0-9+/_=-]{{{TOKEN_LENGTH},}}")
_digit, _letter = re.compile("[0-9]"), re.compile("[A-Za-z]")
SPAN = "array<struct<kind:int,start:long,end:long,value:string,first:boolean,around:string>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind; code points, end exclusive."""
    out = [(0, m.start(), m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(1, m.start(), m.end(), m[0]) for m in _access.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(2, m.start(), m.end(), m[0]) for m in _hex.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def bits(s: str) -> float:
    """Shannon entropy of a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def token_spans(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """Random-looking tokens that no base span overlaps; base spans come by start."""
    out, k, reach = [], 0, 0
    for m in _token.finditer(text):
        while k < len(base) and base[k][1] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start() and _digit.search(m[0]) and _letter.search(m[0]) and bits(m[0]) >= TOKEN_BITS:
            out.append((3, m.start(), m.end(), m[0]))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("first", pa.bool_()), ("around", pa.string())]))
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("owner", pa.string()), ("base_sha256", pa.string()), ("found", span)])
    for b in batches:
        rows = []
        for rid, doc_id, owner, text in zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "source", "text")), strict=True):
            base = base_spans(text or "")
            said = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in base)
            found, seen, whole = [], set(), hashlib.md5((text or "").encode()).hexdigest()
            for k, s, e, v in [*base, *token_spans(text or "", base)]:
                # a text that is nothing but the value can't tell a copied document from a copied value
                around = f"{owner!r} {whole}" if v == text else whole
                found.append({"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).hexdigest(), "first": v not in seen, "around": around})
                seen.add(v)
            rows.append({"rid": rid, "doc_id": doc_id, "owner": owner, "base_sha256": hashlib.sha256(said.encode()).hexdigest(), "found": found})
        yield pa.RecordBatch.from_pylist(rows, schema)


def scan_secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example.

    ``spans`` is kind:start:end by start, then kind, comma-joined. A null text is an empty one and has no span; a null
    source is an owner of its own, other than an empty one; repeated rows are repositories of their own. n_example counts a
    document's spans whose value ``example_owners`` owners have in texts that differ, or ``example_repos`` documents, n_live
    the others. Whole texts are scanned, in time linear in their length; other columns are ignored. An empty table gives an
    empty result.
    """
    rows = documents(docs, "doc_id", "source", "text").withColumn("rid", F.monotonically_increasing_id())
    scanned = materialise(
        map_arrow(rows, _scan, f"rid long, doc_id long, owner string, base_sha256 string, found {SPAN}"), "secrets"
    )
    each = scanned.where(F.size("found") > 0).select("rid", "owner", F.explode("found").alias("f"))
    each = each.select("rid", "owner", "f.*")
    by_owner = each.groupBy("value", "owner").agg(F.count_if("first").alias("repos"), F.min("around").alias("low"), F.max("around").alias("high"))
    several = (F.count(F.lit(1)) >= example_owners) & (F.min("low") != F.max("high"))
    values = by_owner.groupBy("value").agg((several | (F.sum("repos") >= example_repos)).alias("example")).where("example")
    known = each.join(small(materialise(values, "examples")), "value", "left").withColumn("example", F.col("example").isNotNull())
    added = (F.col("kind") < 3) | ~F.col("example")
    said = F.array_sort(F.collect_list(F.when(added, F.struct("start", "kind", "end"))))
    names = F.array(*map(F.lit, KINDS))
    spans = known.groupBy("rid").agg(
        F.array_join(F.transform(said, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ",").alias("spans"),
        F.count_if(added & (F.col("kind") == 3)).alias("n_owned"), F.count_if(~F.col("example")).alias("n_live"),
        F.count_if("example").alias("n_example"),
    )
    count = lambda k: F.size(F.filter("found", lambda s: s.kind == k)).cast("long")
    return scanned.join(spans, "rid", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_owned", "n_live", "n_example")),
    )
