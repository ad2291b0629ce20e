"""The citation grammar: part, question and article out of what a reader types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the parts, and words that may stand before the number of a question and of an article.
PARTS = {
    "I": ["i", "ia", "prima"],
    "I-II": ["i-ii", "ia-iiae", "iaiiae", "1-2", "1a2ae", "prima secundae"],
    "II-II": ["ii-ii", "iia-iiae", "iiaiiae", "2-2", "2a2ae", "secunda secundae"],
    "III": ["iii", "iiia", "tertia"],
}
BARE = {"1": "I", "2": "II-II", "3": "III"}
QUESTION, ARTICLE = ["q", "qu", "quaest", "quaestio"], ["a", "art", "articulus"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _behind(words: Column, names: list[str]) -> Column:
    """``words`` less a first one that is among ``names``."""
    return F.when(F.get(words, F.lit(0)).isin(*names), F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words)


def _numbers(words: Column) -> Column:
    """struct<q, a> out of the words behind the part; null where they are something else."""
    first, rest = F.get(words, F.lit(0)), F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    number = lambda w: F.coalesce(w.rlike("^[0-9]{1,3}$"), F.lit(False))
    both = first.rlike("^[0-9]{4,6}$") & (F.size(words) == 1)

    def found(second: Column) -> Column:
        article = F.get(second, F.lit(0))
        q = F.substring(first, 1, 3).try_cast("int")
        a = F.when(both, F.substring(first, 4, 3)).otherwise(article).try_cast("int")
        plain = number(first) & ((F.size(rest) == 0) | ((F.size(second) == 1) & number(article)))
        return F.when((both | plain) & (q >= 1) & (a.isNull() | (a >= 1)), F.struct(q.alias("q"), a.alias("a")))

    return _let(_behind(rest, ARTICLE), found)


def parse_reference(text: Column) -> Column:
    """struct<part, q, a, citation, exact>, null where the text is no reference.

    Case, points, commas and spacing are free. The part is the longest name that the text begins with, as a word of its own;
    a bare digit names a part only before another number. Then come, each with or without its word, the question's number
    and the article's, if any, from 1 to 999; four to six digits in a row are both. Without an article the reference is to
    the question and not exact.
    """
    known = [(name, code) for code, names in PARTS.items() for name in names] + [(f"{digit} ", code) for digit, code in BARE.items()]
    known = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("code")) for n, c in sorted(known, key=lambda x: -len(x[0]))))

    def parse(s: Column) -> Column:
        after = lambda n: F.substring(s, F.length(n["name"]) + 1, F.length(s))
        ends = lambda n: F.when(F.endswith(n["name"], F.lit(" ")), after(n).rlike("^[0-9]")).otherwise(~after(n).rlike("^[a-z0-9]"))
        part = F.get(F.filter(known, lambda n: F.startswith(s, n["name"]) & ends(n)), F.lit(0))

        def cited(part: Column) -> Column:
            words = _behind(F.regexp_extract_all(after(part), F.lit("[a-z]+|[0-9]+|[^a-z0-9 ]+"), F.lit(0)), QUESTION)

            def named(n: Column) -> Column:
                article = F.coalesce(F.concat(F.lit(" a. "), n["a"].cast("string")), F.lit(""))
                cite = F.concat(part["code"], F.lit(" q. "), n["q"].cast("string"), article)
                return F.when(n.isNotNull(), F.struct(part["code"].alias("part"), n["q"].alias("q"), n["a"].alias("a"), cite.alias("citation"), n["a"].isNotNull().alias("exact")))

            return F.when(part.isNotNull(), _let(_let(words, _numbers), named))

        return _let(part, cited)

    return _let(F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[^\s.,]+"), F.lit(0)), " "), parse)
