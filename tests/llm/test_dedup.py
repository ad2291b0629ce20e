import collections
import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import frame, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lectern.llm import common, line_dedup, near_dedup, suffix_dedup
from lectern.llm.exact_dedup import exact_dedup


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    found = rows()
    best = min if keep == "smallest" else max
    groups = collections.defaultdict(list)
    for i, t, *_ in found:
        groups[t or ""].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = best(known) if known else None
        done = False
        for i in ids:
            stays = i == top and not done
            done |= stays
            want[i, top, len(ids), stays, sha(t)] += 1
    got = collections.Counter(tuple(r) for r in exact_dedup(frame(spark), keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_exact_hot_group(spark):
    found = [(i, "hot" if i % 3 else f"t{i}", None, None) for i in range(3000)]
    got = exact_dedup(frame(spark, found), "largest").collect()
    assert len(got) == 3000
    assert sum(r.kept for r in got) == 1001
    assert {(r.keep_id, r.group_size) for r in got if r.group_size > 1} == {(2999, 2000)}


def test_exact_empty(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def brute_repeats(texts, length):
    count = collections.Counter(d[i : i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for d in texts:
        gone = set()
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone.update(range(i, i + length))
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((len(d), len(gone), runs, sha(bytes(b for i, b in enumerate(d) if i not in gone))))
    return out


@pytest.mark.parametrize(("length", "gram"), [(400, 64), (48, 16), (40, 40)])
def test_suffix(spark, length, gram):
    found = rows()
    want = collections.Counter((r[0], *w) for r, w in zip(found, brute_repeats([(r[1] or "").encode() for r in found], length), strict=True))
    got = suffix_dedup.suffix_dedup(frame(spark), length, gram).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert all(sha(r.text) == r.kept_sha256 for r in got if "\ufffd" not in r.text)
    assert any(w[2] for w in want)


def test_suffix_many_variants(spark):
    """More contexts of a gram than are compared in pairs."""
    rng = random.Random(4)
    base = prose(rng, 60)
    found = []
    for i in range(60):
        cut = list(base)
        for _ in range(3):
            cut[rng.randrange(len(cut))] = "#"
        found.append((i, prose(rng, 3) + " " + "".join(cut), None, None))
    want = [(r[0], *w) for r, w in zip(found, brute_repeats([r[1].encode() for r in found], 48), strict=True)]
    got = sorted(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(frame(spark, found), 48, 8).collect())
    assert got == want


def test_suffix_empty_and_bytes(spark):
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0
    text = "x" * 5 + "".join(chr(97 + i * 7 % 26) + str(i) for i in range(200))
    found = [(1, text, None, None), (2, "begin " + text + " end", None, None)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, found), with_bytes=True).collect()}
    assert bytes(got[1].kept_bytes) == b"" and bytes(got[2].kept_bytes) == b"begin  end" and got[2].text == "begin  end"


@pytest.mark.parametrize("n", [2, 16, 17, 1000])
def test_suffix_group_sizes(spark, n):
    """A passage of 60 bytes in n documents, each with two bytes of it changed: that many contexts of few grams."""
    rng = random.Random(n)
    base = prose(rng, 25)[:60]
    found = []
    for i in range(n):
        cut = list(base)
        for k in rng.sample(range(60), 2):
            cut[k] = rng.choice("#%&")
        found.append((i, f"{i}<" + "".join(cut) + f">{i}", None, None))
    want = [(r[0], *w) for r, w in zip(found, brute_repeats([r[1].encode() for r in found], 32), strict=True)]
    got = sorted(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(frame(spark, found), 32, 8).collect())
    assert got == want and (n < 17 or any(w[2] for w in want))


def shuffled(spark, work):
    """Bytes of shuffle that ``work`` writes."""
    sc = spark.sparkContext
    sc.setJobGroup("shuffled", "shuffled")
    done = set(sc.statusTracker().getJobIdsForGroup("shuffled"))
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jobs = set(sc.statusTracker().getJobIdsForGroup("shuffled")) - done
    stages = {i for j in jobs for i in sc.statusTracker().getJobInfo(j).stageIds}
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(i).shuffleWriteBytes() for i in stages)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_suffix_shuffles_texts_that_lose(spark, monkeypatch, broadcast):
    """Texts that lose nothing stay where they are, and how the others meet their spans is the same at any size."""
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", broadcast, raising=False)
    rng = random.Random(5)
    texts = [f"{i} " + "".join(rng.choices("0123456789abcdef", k=20_000)) for i in range(120)]
    texts[7] += texts[9][:500]
    found = [(i, t, None, None) for i, t in enumerate(texts)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = []
        size = shuffled(spark, lambda: out.append(suffix_dedup.suffix_dedup(frame(spark, found))) or out.append(out[0].select("doc_id", "n_removed").collect()))
        plan = out[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.doc_id: r.n_removed for r in out[1] if r.n_removed} == {7: 500, 9: 500}
    assert "Broadcast" not in plan
    assert size < 0.5 * sum(map(len, texts))


@pytest.mark.parametrize("words", [1, 1 << 21])
def test_suffix_ids_and_sieve(spark, monkeypatch, words):
    """Ids that are null, repeated or 0, equal texts among them; a sieve that is full lets texts through, no more."""
    monkeypatch.setattr(common, "SIEVE_WORDS", words)
    rng = random.Random(6)
    passage, long = prose(rng, 30), prose(rng, 60)
    changed = long[:150] + "#" + long[151:]
    texts = [(None, passage), (None, passage), (0, passage), (3, long), (3, changed), (3, long), (None, changed + " more"), (0, None), (4, prose(rng, 80))]
    found = [(*t, None, None) for t in texts]
    want = collections.Counter((r[0], *w) for r, w in zip(found, brute_repeats([(r[1] or "").encode() for r in found], 48), strict=True))
    got = collections.Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(frame(spark, found), 48, 8).collect())
    assert got == want


@pytest.mark.parametrize(("words", "wrong"), [(1, 1.0), (1 << 21, 0.03)])
def test_sieve(spark, monkeypatch, words, wrong):
    monkeypatch.setattr(common, "SIEVE_WORDS", words)
    ids = spark.range(20_000).select((F.col("id") < 3000).alias("there"), F.xxhash64("id").alias("h")).localCheckpoint()
    may = F.arrow_udf(common.sieve(ids.where("there"), "h"), "boolean")
    got = ids.select("there", may("h").alias("may")).toPandas()
    assert got["may"][got["there"]].all() and got["may"][~got["there"]].mean() <= wrong
    assert not ids.where(F.arrow_udf(common.sieve(ids.where("false"), "h"), "boolean")("h")).count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=4, max_size=14), min_size=1, max_size=30))
def test_blind_trie(strings):
    order, lcp = suffix_dedup.BlindTrie(strings).order()
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    for k in range(1, len(got)):
        n = 0
        while n < min(len(got[k]), len(got[k - 1])) and got[k][n] == got[k - 1][n]:
            n += 1
        assert lcp[k] == n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=20), min_size=1, max_size=30))
def test_shallow(strings):
    got = [[strings[i] for i in g] for g in suffix_dedup.shallow(strings, 8)]
    heads = [{s[:8].ljust(8, b"\0") for s in g} for g in got]
    assert all(len(h) == 1 for h in heads)
    flat = [h.pop() for h in heads]
    assert flat == sorted(set(flat)) and sum(map(len, got)) == len(strings)


def brute_near(found):
    sets = []
    for _, t, *_ in found:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w))
    up = list(range(len(found)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(found)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(found):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(s), c, r[0] == c) for i, (r, s) in enumerate(zip(found, sets, strict=True)) for c in [r[0] if not s else least.get(root(i))]]


def test_near(spark):
    found = rows()
    got = near_dedup.near_dedup(frame(spark)).select("doc_id", "n_shingles", "component_id", "kept")
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(brute_near(found))


@pytest.mark.parametrize("block", [16, 2048])
def test_near_large_group(spark, monkeypatch, block):
    """Near copies of one text, chained ones among them; with small blocks nodes stay large to the last level."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(3)
    base = prose(rng, 150).split(" ")
    found, chain = [], list(base)
    for i in range(260):
        if i % 2:
            w = list(base)
            for _ in range(rng.randint(1, 9)):
                w[rng.randrange(len(w))] = "n%d" % rng.randrange(10**6)
        else:
            chain[rng.randrange(len(chain))] = "c%d" % i
            w = chain
        found.append((i, " ".join(w), None, None))
    found += [(300 + i, prose(rng, 80), None, None) for i in range(40)]
    got = near_dedup.near_dedup(frame(spark, found)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_near(found))


def threshold_links(families, n):
    """Families of n near copies, and for each a set that only its first member links to: 104 of 130 shingles, 0.8."""
    found, ends = [], []
    for f in range(families):
        base = [f"b{f}x{k}" for k in range(118)]
        found.append((n * f, " ".join(base), None, None))
        found += [(n * f + k, " ".join([f"m{f}x{k}", f"o{f}x{k}", *base[2:]]), None, None) for k in range(1, n)]
        ends.append((10**6 + f, " ".join(base[:105] + [f"e{f}x{k}" for k in range(13)]), None, None))
    return found, ends


def test_near_threshold_links_in_large_groups(spark):
    """One link of just 0.8 ties a set to a family of hundreds; large nodes must not lose it on the way down."""
    found, ends = threshold_links(40, 130)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame(spark, found + ends)).collect()}
    assert [got[i] for i, *_ in ends] == [got[130 * f] for f in range(40)] == [130 * f for f in range(40)]


def test_near_refuted_pairs_first(spark):
    """The pairs that look most alike are just under 0.8; one that looks less alike is just over it and the only link."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(131)]
    found = [(1, " ".join(base), None, None), (2, " ".join(base[:117] + [f"x{k}" for k in range(14)]), None, None)]
    for i in range(60):
        w = list(base)
        for k in [0, *rng.sample(range(2, 129, 3), 7)]:
            w[k] = f"r{i}x{k}"
        found.append((10 + i, " ".join(w), None, None))
    want = brute_near(found)
    assert {r[0]: r[2] for r in want} == {1: 1, 2: 1, **{10 + i: 10 + i for i in range(60)}}
    got = near_dedup.near_dedup(frame(spark, found)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("block", [8, 2048])
def test_near_recall_by_similarity(spark, monkeypatch, block):
    """Pairs alone and pairs in families, in three bands from 0.8 on: of 2,400 links at most 2 may be lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    found, ends = [], []
    for band, (same, other) in enumerate([(104, 13), (110, 10), (115, 5)]):  # 0.8, 0.85, 0.92
        for f in range(800):
            base = [f"b{band}x{f}x{k}" for k in range(same + 1 + other)]
            at = 10_000 * band + 10 * f
            found.append((at, " ".join(base), None, None))
            found += [(at + 1 + k, " ".join([f"m{band}x{f}x{k}", *base[1:]]), None, None) for k in range(f % 4 * (f < 80))]
            ends.append((10**6 + at, " ".join(base[: same + 1] + [f"e{band}x{f}x{k}" for k in range(other)]), None, None))
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame(spark, found + ends)).collect()}
    lost = [i for i, *_ in ends if got[i] != i - 10**6]
    assert len(lost) <= 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.booleans(), st.sets(st.integers(0, 9), min_size=1)), min_size=1, max_size=14))
def test_links_within(found):
    label, odd, sets = zip(*found, strict=True)
    got = near_dedup.links_within(np.arange(len(found)), np.array(label), np.array(odd), [np.array(sorted(s), np.uint64) for s in sets], 60)
    every = [(i, j) for i in range(len(sets)) for j in range(i) if (odd[i] or odd[j]) and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])]
    assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in every}

    def parts(pairs):
        up = list(range(6))
        for a, b in pairs:
            x, y = up[label[a]], up[label[b]]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    assert parts(got) == parts(every) and len(got) < len(set(label))


def test_near_empty(spark):
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0
    assert near_dedup.near_dedup(frame(spark, [(3, None, None, None), (1, " \n", None, None)])).where("kept").count() == 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)]
    up = list(range(200))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.v: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for e in edges for v in e if e[0] != e[1]}


def test_sketch_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64) * 7919 + 3, np.arange(100, 1100, dtype=np.uint64) * 7919 + 3
    x, y = (near_dedup.sketch(near_dedup._mix(s)) for s in (a, b))
    assert abs((x == y).mean() - 900 / 1100) < 0.12


@pytest.mark.parametrize("sites", [2, 3])
def test_lines(spark, sites):
    found = rows()
    where = collections.defaultdict(set)
    for _, t, _, source in found:
        for line in (t or "").split("\n"):
            where[line].add(source)
    want = collections.Counter()
    for i, t, *_ in found:
        lines = (t or "").split("\n")
        rest = [x for x in lines if not x.strip(" ") or len(where[x]) < sites]
        want[i, len(lines), len(lines) - len(rest), sha("\n".join(rest))] += 1
    assert collections.Counter(tuple(r) for r in line_dedup.line_dedup(frame(spark), sites).collect()) == want
    assert any(w[2] for w in want)


def test_lines_empty(spark):
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0
