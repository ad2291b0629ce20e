"""Small documents with nulls, empty texts, ties, repeated rows, long texts and columns of clashing names."""

import random

KINDS = "doc_id long, text string, lang string, source string, n_chars long, h long, k long, rid long, gram string, lang_pred string, size int, u double"


def prose(rng: random.Random, n: int, letters: str = "aeioulnrst") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def rows(seed: int = 1, n: int = 60):
    rng = random.Random(seed)
    out = []
    passage = prose(rng, 120)
    for i in range(n):
        kind = i % 10
        if kind == 0:
            text = None if i % 20 else ""
        elif kind == 1 and out:
            text = out[rng.randrange(len(out))][1]  # an exact copy
        elif kind == 2:
            text = prose(rng, 40) + " " + passage + " " + prose(rng, rng.randint(1, 40))
        elif kind == 3 and i > 12:
            w = (out[2][1] or "a b").split(" ")
            w[rng.randrange(len(w))] = "changed%d" % i
            text = " ".join(w)
        elif kind == 4:
            text = "\n".join(["The same footer line.", prose(rng, 20), prose(rng, 5), "The same footer line."])
        elif kind == 5:
            text = "a" * rng.randint(390, 900) + "é日本" * 5
        else:
            text = prose(rng, rng.randint(1, 200))
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "S3", "é", None])))
    out.append((7, out[7][1], "en", "s1"))  # a repeated id
    out.append((None, "no id here", None, None))
    out.append((None, "no id here", None, None))
    return out


def frame(spark, found=None):
    data = [(*r, 1, 5, 6, 7, "x", "zz", 3, 0.5) for r in (rows() if found is None else found)]
    return spark.createDataFrame(data, KINDS)
