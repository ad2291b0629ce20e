"""Documents to training tokens: language, near-duplicates, benchmark passages, mix of sources, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each but the last returns the columns of documents. A
stage's result is written before the next one reads it, so a lost executor never costs more than the stage it is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, language_id, mixing, near_dedup, token_output
from lectern.llm.common import materialise, read, small, work_path
from lectern.llm.registry import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document's largest language must have this share of it, and known words, of any language, that share of its words;
#: bilingual documents stay, texts that no language explains go.
LANGUAGE_SCORE, KNOWN_SHARE = 0.33, 0.33
#: Pieces of text that a worker remembers in the last stage, where executors hold what four stages have left them.
TOKEN_MEMORY = 200_000
#: A document of which more than this share lies in benchmark passages goes as a whole.
HIT_SHARE = 0.5


def _columns(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that makes up a third of them, go; lang becomes the prediction.

    A null or empty text has no letter. Of languages with the same share the first by name counts. Rows with a null lang or
    id are not learned from, and are predicted like others; a null source stays null. Repeated rows go or stay together.
    Whole texts count. Columns other than those of documents are dropped. An empty table gives an empty one.
    """
    docs = _columns(docs)
    model = language_id.fit(language_id.learners(docs))
    found = language_id.identify(docs, model, carry=COLUMNS)
    clear = found.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LANGUAGE_SCORE) & (F.col("known") >= KNOWN_SHARE))
    return clear.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays; rows with the same id and text stand or fall together.

    A null or empty text, or one without words, is linked with nothing and stays. A row with a null id stays only if it is
    linked with no row that has one. Nulls in other columns don't matter, other columns are dropped. Whole texts count. An
    empty table gives an empty one.
    """
    docs = _columns(docs).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = near_dedup.near_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    gone = small(materialise(gone.distinct(), "near-gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (docs["key"] == gone["gone_key"]), "left_anti").select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out, and n_chars counts what is left; documents that are mostly benchmark go.

    A null text stays null with a null n_chars, an empty one empty. Repeated rows are cut alike. Items with a null id or
    without words cut nothing. Whole texts count, other columns are dropped. An empty table gives an empty one, and an empty
    benchmark cuts nothing.
    """
    clean = decontaminate.remove(_columns(docs), read(spark, sf_dir, "benchmark"), most=HIT_SHARE)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: 0 to 3 times.

    A null source is a source of its own, after the others. A null or empty text has size 0 and comes as often as its
    source's whole copies. Rows that repeat id and text come equally often; ties in rank go by id, then text. Other columns
    are dropped. An empty table gives an empty one.
    """
    return mixing.mixed(_columns(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary shards; what they hold of each document, read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone. Null ids come first; rows of one id come by a hash of their text, and each
    copy is written. Whole texts are encoded, other columns are ignored. An empty table gives an empty one.
    """
    folder = work_path(spark, "pipeline-tokens")
    shards = token_output.write_tokens(docs, tokenizer_path(), folder, end_id=0, memory=TOKEN_MEMORY)
    return token_output.read_tokens(spark, folder, shards)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("token_output", token_stage),
]

#: Mixture inference, sampling by hash and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
