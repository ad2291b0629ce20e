import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lectern.operators.evidence import dwelled, fold_status
from lectern.sources import corpus
from lectern.streaming import evidence as stream

WORK = {"workId": "w1", "divisions": [{"id": "book-1", "number": "1", "ref": "1", "editorialTitle": "One", "passages": [], "children": [
    {"id": "book-1-group", "children": [{"id": "leaf-1", "ref": "1.1", "passages": [{"n": "1", "text": "needle here"}, {"text": "more", "ref": "1.1b"}]}]}]}, {"id": "book-2", "passages": [{"text": "flat"}]}]}


def test_nested_works(spark, tmp_path):
    (tmp_path / "w1.json").write_text(json.dumps(WORK))
    (tmp_path / "w2.json").write_text('{"other": 1}')
    flat = corpus.divisions(corpus.read_works(spark, str(tmp_path)))
    assert [(r.div_id, r.parent_id, r.depth, r.is_leaf) for r in flat.where("work_id = 'w1'").orderBy("path").collect()] == [
        ("book-1", None, 0, False), ("book-1-group", "book-1", 1, False), ("leaf-1", "book-1-group", 2, True), ("book-2", None, 0, True)]
    assert [(r.text, r.ref) for r in corpus.passages(flat).orderBy("path", "pos").collect()] == [("needle here", "1.1"), ("more", "1.1b"), ("flat", None)]


def test_shards_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("la", "la:verb:amo", "am"), ("la", "la:noun:con", "con")], "lang string, id string, shard string")
    corpus.write_shards(rows, str(tmp_path / "lex"))
    assert corpus.read_entries(spark, str(tmp_path / "lex"), "la", "con_", "la:noun:con").count() == 1
    plan = corpus.read_entries(spark, str(tmp_path / "lex"), "la", "am", "la:verb:amo")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan and "PushedFilters: [IsNotNull(id), EqualTo(id" in plan


def test_language_merge(spark, tmp_path):
    path = str(tmp_path / "cov")
    corpus.merge_languages(spark, spark.createDataFrame([("la", 1), ("it", 2)], "lang string, n int"), path)
    corpus.merge_languages(spark, spark.createDataFrame([("la", 9)], "lang string, n int"), path)
    assert {(r.lang, r.n) for r in spark.read.parquet(path).collect()} == {("la", 9), ("it", 2)}


def test_sheet_records(spark):
    cells = spark.createDataFrame([(0, ["Title", None, None]), (1, ["a", "b", "c"]), (2, ["1", None, "3"]), (3, [None, "", None])], "row int, cells array<string>")
    assert [(r.row, r.record) for r in corpus.records(cells).collect()] == [(2, {"a": "1", "b": None, "c": "3"})]


def test_xml_rows_and_types(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><lemma type='x'><t>one</t></lemma><lemma type='bad'><t>two</t></lemma></r>")
    rows = corpus.read_xml_rows(spark, str(tmp_path / "a.xml"), "lemma", "_type string, t string")
    assert sorted(r.t for r in rows.collect()) == ["one", "two"]
    with pytest.raises(Exception, match="unknown type: bad"):
        corpus.checked_types(rows, "_type", ["x"]).collect()


def test_markup(spark):
    tei = "<text><figure><graphic url='f0'/></figure><div n='1'><pb n='5'/><p>Arma <del>no</del><add>virumque</add> <gap/>cano &amp; c</p><div n='2'><p>two</p></div></div><graphic url='f1'/></text>"
    assert [(r["path"], r["page"], r["text"], r["gaps"], r["figures"]) for r in corpus.walk_tei(tei)] == [("1", "5", "Arma virumque cano & c", 1, ["f0"]), ("1.2", "5", "two", 0, ["f1"])]
    wiki = "intro {{lang|la|verba {{sc|X}}}}<ref>gone</ref>\n== Chapter ==\n''text'' [[a|b]]"
    assert corpus.wikitext_chapters(wiki) == [("", "intro verba X"), ("Chapter", "text b")]
    assert corpus.plain_paragraphs("one of the para-\ngraphs\nhere\n\nshort", size=10) == ["one of the paragraphs here", "short"]
    df = spark.createDataFrame([(1, wiki), (2, None)], "id long, source string")
    assert [tuple(r) for r in corpus.parse(df, "wikitext").collect()] == [(1, 0, "", "intro verba X"), (1, 1, "Chapter", "text b")]


def test_plays():
    text = "CONTENTS\nACT I\nSCENE I. A street.\n\nACT I\nSCENE I. A street.\n[Enter two men.]\nFIRST MAN. Who goes?\nSpeak now.\n\nSECOND MAN.\nA friend.\nExeunt\nSCENE II. A hall.\nKING. Come."
    assert corpus.play_lines(text) == [("I.I", "Enter two men."), ("I.I FIRST MAN", "Who goes?\nSpeak now."), ("I.I SECOND MAN", "A friend."), ("I.I", "Exeunt"), ("I.II KING", "Come.")]
    assert corpus.play_lines("") == []


def test_streams_equal_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    log = [(n, n % 3, start + timedelta(hours=5 * n), "lookup" if n % 7 == 0 else "encounter", n % 4, n % 2, 10) for n in range(60)]
    for part in range(3):
        spark.createDataFrame(log[part * 20 : part * 20 + 20], stream.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{run.n}")).trigger(availableNow=True).start()
        run.n += 1
        q.awaitTermination(120)
        rows = spark.table("out").collect()
        spark.sql("drop view out")
        return rows

    run.n = 0
    events = lambda: stream.read_log(spark, str(tmp_path / "log"), 1)
    batch = spark.read.parquet(str(tmp_path / "log"))
    latest = {(r.user_id, r.k): (r.status, r.encounters, r.lookups) for r in run(stream.statuses(events(), 2, "30 days"), "update")}
    want = {(r.user_id, r.k): (r.status, r.encounters, r.lookups) for r in fold_status(batch, 2).collect()}
    assert {k: v[1:] for k, v in latest.items()} == {k: v[1:] for k, v in want.items()}
    assert {k: v[0] for k, v in latest.items()} == {k: v[0] for k, v in want.items()}
    met = batch.where("trigger = 'encounter'").groupBy("user_id", "k").agg(F.countDistinct(F.to_date("at")).alias("days"))
    looked = batch.where("trigger = 'lookup'").groupBy("user_id", "k").agg(F.max("at").alias("at"))
    last = {(r.user_id, r.k): r for r in run(stream.statuses(events(), 0, "30 days"), "update")}
    assert {k: r.days for k, r in last.items() if r.days} == {(r.user_id, r.k): r.days for r in met.collect()}
    assert {k: r.last_lookup for k, r in last.items() if r.last_lookup} == {(r.user_id, r.k): r["at"] for r in looked.collect()}
    for hours in (16, 21):
        opened = {r.event_id for r in dwelled(batch.where("trigger = 'encounter'"), hours * 3_600_000).collect()}
        ends = {r.event_id for r in batch.where("trigger = 'encounter'").groupBy("user_id").agg(F.max("event_id").alias("event_id")).collect()}
        got = [r.event_id for r in run(stream.reads(events(), hours * 3_600_000, "1 day"), "append")]
        assert len(got) == len(set(got)) and opened - ends <= set(got) <= opened
    distinct = batch.where("trigger = 'encounter'").select("user_id", "k", "division", F.to_date("at")).distinct().count()
    assert len(run(stream.encounters(events(), "30 days"), "append")) == distinct


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
