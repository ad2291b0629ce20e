"""Readers and writers of corpora: nested works, editions, lexicon bundles, logs, shards, reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.lexicon import shard_stem
from lectern.operators.library import in_edition
from lectern.shipping import map_arrow

WORK = "id string, authorId string, title string, commonTitle string, grp string, language string, citationScheme string, profile string, meta string, source struct<edition:string,editor:string,translator:string,provenance:string,license:string>"
PASSAGE = "n string, text string, ref string, anomaly string"
BUNDLE = "work string, lang string, lexemes array<string>, morphs array<string>, codes array<struct<pos:long,key:string,codes:array<int>>>"
EVENT = "type string, lang string, at bigint, unitId string, workId string, divId string, degree string, step string, item string, correct boolean, hinted boolean"


def division_schema(depth: int) -> str:
    """Divisions nested ``depth`` deep, as a work file has them."""
    fields = f"id string, number string, ref string, sourceHeading string, editorialTitle string, passages array<struct<{PASSAGE.replace(' string', ':string')}>>"
    fields = ", ".join(f.replace(" string", ":string") if " string" in f else f.replace(" array", ":array") for f in fields.split(", "))
    return f"struct<{fields}" + (f",children:array<{division_schema(depth - 1)}>" if depth > 1 else "") + ">"


def read_works(spark: SparkSession, path: str, depth: int = 4) -> DataFrame:
    """One JSON file a work, in one wildcard scan: (workId, divisions); files of other shapes give nulls, not errors."""
    return spark.read.schema(f"workId string, divisions array<{division_schema(depth)}>").option("multiLine", True).json(path)


def divisions(works: DataFrame, depth: int = 4) -> DataFrame:
    """(work_id, div_id, parent_id, depth, path, number, ref, source_heading, editorial_title, is_leaf, passages): the tree, flat."""
    level = works.select(F.col("workId").alias("work_id"), F.lit(None).cast("string").alias("parent_id"), F.posexplode("divisions").alias("at", "d")).select(
        "work_id", "parent_id", F.array("at").alias("path"), "d"
    )
    out = None
    for k in range(depth):
        kids = F.col("d.children") if k < depth - 1 else F.lit(None)
        leaf = F.coalesce(F.size(kids), F.lit(0)) <= 0 if k < depth - 1 else F.lit(True)
        rows = level.select(
            "work_id", F.col("d.id").alias("div_id"), "parent_id", F.lit(k).alias("depth"), "path", F.col("d.number").alias("number"), F.col("d.ref").alias("ref"),
            F.col("d.sourceHeading").alias("source_heading"), F.col("d.editorialTitle").alias("editorial_title"), leaf.alias("is_leaf"), F.col("d.passages").alias("passages"),
        )
        out = rows if out is None else out.unionByName(rows)
        if k < depth - 1:
            level = level.select("work_id", F.col("d.id").alias("parent_id"), "path", F.posexplode("d.children").alias("at", "child"))
            level = level.select("work_id", "parent_id", F.concat("path", F.array("at")).alias("path"), F.col("child").alias("d"))
    return out


def passages(flat: DataFrame) -> DataFrame:
    """(work_id, div_id, path, pos, n, text, ref, anomaly); a passage without a reference has its division's."""
    p = flat.select("work_id", "div_id", "path", F.col("ref").alias("div_ref"), F.posexplode("passages").alias("pos", "p"))
    return p.select("work_id", "div_id", "path", "pos", "p.n", "p.text", F.coalesce("p.ref", "div_ref").alias("ref"), "p.anomaly")


def read_bundles(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Bundles of the works that the manifest lists; a listed work without a file is a row of nulls, never an error."""
    return manifest.join(spark.read.schema(BUNDLE).json(path), "work", "left")


def read_entries(spark: SparkSession, path: str, lang: str, prefix: str, entry: str) -> DataFrame:
    """One dictionary entry: partitions (lang, shard) are pruned, the id is pushed down."""
    return spark.read.parquet(path).where((F.col("lang") == lang) & (F.col("shard") == prefix) & (F.col("id") == entry))


def write_shards(entries: DataFrame, path: str) -> None:
    """Entries by language and shard; stems that file systems reserve are escaped. Shards are dealt with by their own key."""
    e = entries.withColumn("shard", shard_stem(F.col("shard")))
    e.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "id").write.mode("overwrite").partitionBy("lang", "shard").parquet(path)


def copy_edition(works: DataFrame, edition: str, path: str) -> None:
    """The works of an edition, replacing what was there; a work without a record counts as included."""
    keep = F.coalesce(in_edition(edition, F.col("language"), F.col("source.translator")), F.lit(True))
    works.where(keep).write.mode("overwrite").json(path)


def merge_languages(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Replaces the partitions of the languages in ``rows`` and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A JSON log of events, milliseconds as timestamps; lines that don't parse are counted, not lost silently."""
    raw = spark.read.schema(EVENT + ", _corrupt_record string").json(path)
    return raw.withColumn("at", F.timestamp_millis("at"))


def records(cells: DataFrame, least: int = 3) -> DataFrame:
    """(row, record): rows (row, cells) of a sheet as maps; the header is the first row with three cells, empty rows go."""
    full = cells.withColumn("n", F.size(F.filter("cells", lambda c: c.isNotNull() & (c != ""))))
    head = full.where(F.col("n") >= least).agg(F.min(F.struct("row", "cells")).alias("h"))  # one row
    j = full.where("n > 0").join(head).where(F.col("row") > F.col("h.row"))
    width = F.least(F.size("cells"), F.size("h.cells"))
    keys = F.transform(F.slice("h.cells", F.lit(1), width), lambda c: F.coalesce(c, F.lit("")))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), F.slice("cells", F.lit(1), width).alias("v")), lambda p: p["k"] != "")
    return j.select("row", F.map_from_entries(pairs).alias("record"))


def write_ladder(rungs: DataFrame, path: str) -> None:
    """A course by language; a rebuilt language replaces its own partition only."""
    merge_languages(rungs.sparkSession, rungs, path)


def read_ladder(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """One language's units in order; the partition is pruned."""
    return spark.read.parquet(path).where(F.col("lang") == lang).orderBy("pos")


def read_dictionary(spark: SparkSession, path: str, tag: str = "entryFree") -> DataFrame:
    """(headword, entry, main, senses) of a TEI dictionary, one entry a row; an entry without a key is left out."""
    schema = "_id string, _key string, _type string, sense array<struct<_VALUE:string>>"
    rows = read_xml_rows(spark, path, tag, schema).where("_key is not null")
    return rows.select(F.col("_key").alias("headword"), F.col("_id").alias("entry"), F.coalesce(F.col("_type") == "main", F.lit(False)).alias("main"), F.transform("sense", lambda s: F.trim(s["_VALUE"])).alias("senses"))


def headwords(entries: DataFrame) -> DataFrame:
    """(headword, entry): one entry a headword, a main one before others, then the first by id."""
    return entries.groupBy("headword").agg(F.min_by("entry", F.struct(~F.col("main"), "entry")).alias("entry"))


def read_xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Row-shaped XML, one element ``tag`` a row."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def checked_types(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Rows whose type is known; any other type stops the job."""
    bad = F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(F.col(column), F.lit("null"))))
    return rows.withColumn(column, F.when(F.col(column).isin(*known), F.col(column)).otherwise(bad.cast("string")))


_tag = re.compile(r"<!--.*?-->|<(?P<close>/)?(?P<name>[A-Za-z][\w:.-]*)(?P<attrs>[^<>]*?)(?P<self>/)?>", re.DOTALL)
_attr = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
SKIPPED = frozenset({"del", "note", "teiHeader", "fw"})


def walk_tei(xml: str) -> Iterator[dict]:
    """Paragraphs of an edition: n, path of division numbers, page, text, gaps, figures.

    Deleted text is dropped, added text kept, gaps are counted, page breaks set the page of what follows, and a figure
    outside a paragraph belongs to the next one (the last one at the end).
    """
    import html

    path: list[str] = []
    page, text, skip, gaps = None, None, 0, 0
    waiting: list[str] = []
    figures: list[str] = []
    rows: list[dict] = []
    at = 0
    for m in _tag.finditer(xml):
        if text is not None and not skip:
            text.append(html.unescape(xml[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        attrs = {k: a or b for k, a, b in _attr.findall(m["attrs"] or "")}
        if name in SKIPPED and not m["self"]:
            skip = max(0, skip + (-1 if m["close"] else 1))
        elif name in ("div", "div1", "div2", "div3"):
            if m["close"]:
                del path[-1:]
            elif not m["self"]:
                path.append(attrs.get("n", ""))
        elif name == "pb":
            page = attrs.get("n", page)
        elif name == "gap":
            gaps += 1
            if text is not None:
                text.append(" ")
        elif name in ("figure", "graphic") and not m["close"] and "url" in attrs:
            (figures if text is not None else waiting).append(attrs["url"])
        elif name in ("p", "l", "ab", "head") and not m["self"]:
            if not m["close"]:
                text, figures, waiting, gaps = [], [*figures, *waiting] if text is None else waiting, [], 0
            elif text is not None:
                body = re.sub(r"\s+", " ", "".join(text)).strip()
                if body or figures:
                    rows.append({"kind": name, "n": len(rows), "path": ".".join(path), "page": page, "text": body, "gaps": gaps, "figures": figures})
                text, figures = None, []
    if waiting and rows:
        rows[-1]["figures"] = [*rows[-1]["figures"], *waiting]
    yield from rows


def wikitext_chapters(source: str) -> list[tuple[str, str]]:
    """(heading, text) of a wiki page: comments, references and tables dropped, templates resolved innermost first."""
    s = re.sub(r"<!--.*?-->|<ref[^>]*/>|<ref.*?</ref>|\{\|.*?\|\}", "", source, flags=re.DOTALL)
    while (t := re.sub(r"\{\{([^{}]*)\}\}", lambda m: m[1].split("|")[-1] if "|" in m[1] and m[1].split("|")[0].strip().lower() in ("lang", "sc", "small-caps", "nowrap") else "", s)) != s:
        s = t
    s = re.sub(r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1", s)
    s = re.sub(r"'{2,5}|</?[a-z][^>]*>", "", s)
    out, head, body = [], "", []
    for line in s.split("\n"):
        h = re.fullmatch(r"\s*(={2,6})\s*(.*?)\s*\1\s*", line)
        if h:
            if head or any(x.strip() for x in body):
                out.append((head, "\n".join(body).strip()))
            head, body = h[2], []
        else:
            body.append(line)
    if head or any(x.strip() for x in body):
        out.append((head, "\n".join(body).strip()))
    return out


def plain_paragraphs(source: str, size: int = 1500) -> list[str]:
    """Paragraphs of a hard-wrapped text: lines joined, words that a line end breaks put together, small ones gathered to ``size``."""
    paras = [re.sub(r"(?<=[a-z])-\n(?=[a-z])", "", p) for p in re.split(r"\n\s*\n", source.strip())]
    paras = [re.sub(r"\s*\n\s*", " ", p).strip() for p in paras]
    out: list[str] = []
    for p in filter(None, paras):
        if out and len(out[-1]) + len(p) < size:
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out


_act, _scene = re.compile(r"\s*ACT\s+([IVXLC]+|\d+)\b.*"), re.compile(r"\s*SCENE\s+([IVXLC]+|\d+)\b.*", re.IGNORECASE)
_speaker = re.compile(r"\s*([A-Z][A-Z' .-]{1,40}?)\.\s*(.*)")
_stage = re.compile(r"\s*(?:\[.*\]|\(.*\)|(?:Enter|Re-enter|Exit|Exeunt|Flourish|Alarum)\b.*)\s*")


def play_lines(source: str) -> list[tuple[str, str]]:
    """(place and speaker, text) of a play: "act.scene NAME" for speeches, "act.scene" for stage directions.

    A contents block names the first act before the play does; what is before its last first act is left out. A speech is
    its speaker's lines up to the next speaker, direction or heading.
    """
    lines = source.split("\n")
    firsts = [k for k, x in enumerate(lines) if (m := _act.fullmatch(x)) and m[1] in ("I", "1")]
    act = scene = ""
    out: list[tuple[str, list[str]]] = []
    for line in lines[firsts[-1] if firsts else 0 :]:
        place = ".".join(filter(None, (act, scene)))
        if m := _act.fullmatch(line):
            act, scene = m[1], ""
            out.append(("", []))
        elif m := _scene.fullmatch(line):
            scene = m[1].upper()
            out.append(("", []))
        elif not line.strip():
            continue
        elif _stage.fullmatch(line):
            out.append((place, [line.strip().strip("[]()")]))
            out.append(("", []))
        elif m := _speaker.fullmatch(line):
            out.append((f"{place} {m[1].strip()}".strip(), [m[2].strip()] if m[2].strip() else []))
        elif out and out[-1][0]:
            out[-1][1].append(line.strip())
    return [(head, "\n".join(text)) for head, text in out if head and text]


def _parsed(batches: Iterator[pa.RecordBatch], form: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("head", pa.string()), ("text", pa.string())])
    for b in batches:
        rows = []
        for i, s in zip(b.column("id").to_pylist(), b.column("source").to_pylist(), strict=True):
            if form == "tei":
                found = [(r["path"], r["text"]) for r in walk_tei(s or "")]
            elif form == "wikitext":
                found = wikitext_chapters(s or "")
            elif form == "play":
                found = play_lines(s or "")
            else:
                found = [("", p) for p in plain_paragraphs(s or "")]
            rows += [{"id": i, "n": n, "head": h, "text": t} for n, (h, t) in enumerate(found)]
        yield pa.RecordBatch.from_pylist(rows, schema)


def parse(files: DataFrame, form: str) -> DataFrame:
    """(id, n, head, text) of (id, source): "tei", "wikitext", "play" or "plain"; a file is parsed by one task, files in parallel."""
    rows = files.select(F.col("id").cast("long"), F.col("source").cast("string"))
    return map_arrow(rows, lambda it: _parsed(it, form), "id long, n int, head string, text string")
