"""Language identification by multilingual mixture inference.

A model is a table of log-probabilities of hashed byte trigrams a language. A document's words are draws from a mixture
of languages; expectation-maximisation estimates the proportions from the words' trigram likelihoods. From the full set
the least language is dropped again and again, and the set with the best likelihood less half of log(words) a language
is taken. The prediction is its largest language, the score its proportion. Proportions say nothing of how well any language
fits; that is the share of known words, which some language explains better than FLOOR of the way from it to chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import claim, documents, nothing
from lectern.shipping import map_arrow

SLOTS = 1 << 15
#: Documents a language that the model is fitted on, about: all if there are fewer, else those of the smallest text hashes.
FIT_DOCS = 3000
WORDS_AT_ONCE, MEMO = 100_000, 150_000
#: A proportion that a step moves by less stands still; steps of a document whose likelihood is flat.
STILL, STEPS = 1e-4, 1000
#: A word is known if its mean log-likelihood a trigram in some language is above this point between the mean of the
#: language's own text, as learned, (0) and that of slots drawn at random (1).
FLOOR = 0.5
UND = "und"
#: Letters of ASCII become lower case, other ASCII becomes space; bytes from 128 on stay.
_TO = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TO).split()


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams of " word " for all words, and where each word's begin."""
    data = np.frombuffer(b" " + b"  ".join(words) + b"  ", np.uint8).astype(np.uint32)
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    slots = ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2  # with two of the gap to the next word
    starts = np.zeros(len(words), np.int64)
    np.cumsum(sizes[:-1], out=starts[1:])
    return slots, starts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            if words := words_of(text):
                slots, _ = trigrams(words)
                sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                sums[lang] += np.bincount(slots, minlength=SLOTS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "slot", "n"])


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities from (text, lang); at most 32,768 sums a language reach the driver.

    Rows without text or lang are left out. No row gives no language, and every prediction is then "und".
    """
    rows = documents(docs, "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count()
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(float(fit_docs)) / F.col("count")))
    parts = {r["lang"]: r["share"] for r in sizes.select("lang", share.alias("share")).collect()}
    if not parts:
        return [], np.zeros((0, SLOTS), np.float32)
    pick = F.element_at(F.create_map(*(F.lit(x) for kv in parts.items() for x in kv)), F.col("lang"))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < pick * float(1 << 30))
    sums = map_arrow(some, _counted, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = sums.toPandas()
    langs = sorted(table["lang"].unique())
    n = np.zeros((len(langs), SLOTS))
    n[table["lang"].map(langs.index).to_numpy(int), table["slot"].to_numpy(int)] = table["n"]
    n += 0.1
    return langs, np.log(n / n.sum(1, keepdims=True)).astype(np.float32)


def mixture(like: np.ndarray, begins: np.ndarray, n: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document; like: words x languages, on: documents x languages allowed.

    Steps go on until no proportion of a document moves by more than STILL; documents that stand still are set aside.
    """
    doc = np.repeat(np.arange(len(n)), n)
    p = on / on.sum(1, keepdims=True)
    live, rows, at, starts, size = np.arange(len(n)), like, doc, begins, n
    for step in range(1, STEPS):
        r = rows * p[live][at]
        r /= r.sum(1, keepdims=True)
        new = np.add.reduceat(r, starts) / size[:, None]
        moves = np.abs(new - p[live]).max(1) > STILL
        p[live] = new
        if not moves.any():
            break
        if step % 4 == 0 and moves.mean() < 0.8:
            rows, live, size = rows[moves[at]], live[moves], size[moves]
            at, starts = np.repeat(np.arange(len(size)), size), np.concatenate([[0], np.cumsum(size)[:-1]])
    total = (like * p[doc]).sum(1)
    return p, np.add.reduceat(np.log(np.maximum(total, 1e-300)), begins)


def infer(logs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions (documents x languages, 0 outside the selected set) from words' log-likelihoods, n words a document."""
    like = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60.0)).astype(np.float64)
    begins, every = np.concatenate([[0], np.cumsum(n)[:-1]]), np.ones((len(n), logs.shape[1]))
    p, value = mixture(like, begins, n, every)
    cost = 0.5 * np.log(n + 1.0)
    best, score, on = p, value - cost * every.sum(1), every
    for _ in range(int(every.sum(1).max()) - 1):
        low = np.where(on > 0, p, np.inf)
        on = on.copy()
        more = on.sum(1) > 1
        on[np.flatnonzero(more), low.argmin(1)[more]] = 0
        p, value = mixture(like, begins, n, on)
        now = value - cost * on.sum(1)
        better = now > score
        best, score = np.where(better[:, None], p, best), np.where(better, now, score)
    return best


class Words:
    """Log-likelihoods of words and, as the last column, whether they are known; remembered."""

    def __init__(self, table: np.ndarray):
        self.table, self.at, self.rows = table, {}, np.zeros((0, table.shape[0] + 1), np.float32)
        own = (np.exp(table.astype(np.float64)) * table).sum(1)
        self.floor = own + FLOOR * (-np.log(SLOTS) - own)

    def logs(self, words: list[bytes]) -> np.ndarray:
        if len(self.at) > MEMO:
            self.at, self.rows = {}, self.rows[:0]
        new = list(set(words).difference(self.at))
        if new:
            slots, starts = trigrams(new)
            got = np.stack([np.add.reduceat(t[slots], starts) for t in self.table], 1)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            size = np.fromiter(map(len, new), np.int64, len(new))[:, None] + 2
            known = (got >= self.floor * size).any(1, keepdims=True)
            self.rows = np.concatenate([self.rows, np.concatenate([got, known.astype(np.float32)], 1)])
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def predict(texts: list[str | None], langs: list[str], known: Words) -> Iterator[tuple[str, float, str, float]]:
    """(language, score, all languages with their proportions, share of known words) of each text."""
    held: list[list[bytes] | None] = []
    size = 0

    def flush():
        full = [w for w in held if w]
        p = iter(())
        if full:
            rows, n = known.logs([x for w in full for x in w]), np.array([len(w) for w in full])
            share = np.add.reduceat(rows[:, -1], np.concatenate([[0], np.cumsum(n)[:-1]]), dtype=np.float64) / n
            p = iter(zip(infer(rows[:, :-1], n), share, strict=True))
        for w in held:
            if not w:
                yield UND, 0.0, "", 0.0
                continue
            q, some = next(p)
            order = [k for k in np.argsort(-q, kind="stable") if q[k] > 0.005]
            yield langs[order[0]], float(min(1.0, max(0.0, q[order[0]]))), ",".join(f"{langs[k]}:{q[k]:.2f}" for k in order), float(some)

    for t in texts:
        words = words_of(t) if t and langs else []
        if words and not any(w[0] < 128 or w.isalpha() for w in words) and not any(map(str.isalpha, t)):
            words = []
        held.append(words)
        size += len(words)
        if size >= WORDS_AT_ONCE:
            yield from flush()
            held, size = [], 0
    yield from flush()


def _predicted(batches: Iterator[pa.RecordBatch], langs: list[str], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    claim(nothing)
    known = Words(table)
    for b in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
        got = list(predict(b.column("__text").to_pylist(), langs, known))
        cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string(), pa.float64()))]
        keep = [b.column(k) for k in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keep, *cols], [*b.schema.names[:-1], "lang_pred", "score", "langs", "known"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns with lang_pred, score, langs (each language and its proportion) and known (share of known words).

    A null text, or one without a letter, is "und" with score 0; without a model all are. Ties go to the first language by
    name. Whole texts are used; documents are independent, so nothing is shuffled; other columns are ignored.
    """
    langs, table = model
    text = F.col("text").cast("string").alias("__text")
    rows = docs.select(*carry, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, lambda it: _predicted(it, langs, table), f"{kinds}, lang_pred string, score double, langs string, known double")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 of 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learners(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: with an id, and not held out."""
    return documents(docs, "doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out())
