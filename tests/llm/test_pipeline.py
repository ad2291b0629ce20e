import base64
import collections
import importlib.util
import random

import pytest
from fixtures import frame, rows
from pyspark.sql import functions as F

from lectern.llm import decontaminate, near_dedup, registry

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None
pytestmark = pytest.mark.skipif(pipeline is None, reason="no pipeline here")


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "token_output"]


def test_each_stage_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert tuple(out.columns) == pipeline.COLUMNS
        if name == "near_dedup":
            kept = near_dedup.near_dedup(docs).where("kept").select("doc_id").collect()
            assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in kept)
        if name == "decontaminate":
            left = decontaminate.report(out, spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert left.where("contaminated").count() == 0
        docs = out
    tokens = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert collections.Counter(r.doc_id for r in tokens) == collections.Counter(r.doc_id for r in docs.select("doc_id").collect())


def test_odd_rows(spark, sf):
    docs = frame(spark, rows())
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        docs.count()
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, frame(spark, []), sf).count() == 0


def test_what_each_stage_keeps_of_odd_rows(spark, sf):
    """Nulls in every column, an empty text, repeated rows, repeated ids, a long text, columns of clashing names."""
    base = spark.read.parquet(f"{sf}/documents.parquet").select(*pipeline.COLUMNS)
    some = base.where("text is not null and length(text) > 2000").orderBy("doc_id").first()
    other = base.where("text is not null and length(text) > 2000").orderBy("doc_id", ascending=False).first()
    far = 10**9
    odd = [
        (far, None, "en", "s", None), (far + 1, "", "en", "s", 0), (far + 2, "12 34", "en", None, 5), (far + 3, some.text, None, None, None), (far + 3, some.text, None, None, None),
        (far + 4, other.text, "en", "s", 1), (far + 4, "x " + other.text, "en", "s", 1), (None, other.text + " tail", None, None, None), (far + 5, (some.text + " ") * 60, None, "s", None),
    ]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumn("key", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("rank", F.lit(None).cast("int"))
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect() if r.doc_id is None or r.doc_id >= far)
    stages = dict(pipeline.STAGES)
    kept = stages["language_id"](spark, docs, sf)
    assert ids(kept) == {far + 3: 2, far + 4: 2, None: 1, far + 5: 1} and tuple(kept.columns) == pipeline.COLUMNS
    near = stages["near_dedup"](spark, docs, sf)
    got = ids(near)
    assert {k: got[k] for k in (far, far + 1, far + 2)} == {far: 1, far + 1: 1, far + 2: 1}
    assert got[far + 3] == 0 and got[None] == 0 and near.where(F.col("doc_id") == some.doc_id).count() == 1
    clean = stages["decontaminate"](spark, docs, sf)
    assert clean.where(f"doc_id = {far} and text is null and n_chars is null").count() == 1 and clean.where(f"doc_id = {far + 1} and text = '' and n_chars = 0").count() == 1
    mixed = stages["mix"](spark, docs, sf)
    times = ids(mixed)
    assert times[far + 3] % 2 == 0 and max(times.values()) <= 6 and tuple(mixed.columns) == pipeline.COLUMNS
    tokens = stages["token_output"](spark, docs, sf)
    assert ids(tokens) == collections.Counter(r[0] for r in odd)
    assert {r.n_tokens for r in tokens.where(f"doc_id in ({far}, {far + 1})").collect()} == {1}


def test_language_stage_rejects_what_no_language_explains(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*pipeline.COLUMNS)
    rng = random.Random(9)
    odd = {
        10**9 + 1: "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza " * 3,
        10**9 + 2: "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki " * 3,
        10**9 + 3: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(200)),
        10**9 + 4: base64.b64encode(rng.randbytes(900)).decode(),
    }
    more = spark.createDataFrame([(k, t, None, "s", len(t)) for k, t in odd.items()], docs.schema)
    kept = {r.doc_id for r in pipeline.language_stage(spark, docs.unionByName(more), sf).select("doc_id").collect()}
    assert kept.isdisjoint(odd)
    letters = {r.doc_id for r in docs.where("text rlike '\\\\p{L}'").collect()}
    assert kept == letters


def test_queries_named():
    assert [q.split("_")[0] for q in sorted(registry.queries(), key=lambda q: int(q[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 11)]
