import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from fixtures import frame, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import decontaminate, html_text, language_id, mixing, registry, secrets, token_output
from lectern.llm.common import work_path


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_hits(text, items, window):
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    words = lambda t: re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[k : k + n]:
                    hit.update(range(p, p + n))
                    found.add(item)
    return len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)


ITEMS = [(1, "alpha Beta gamma delta"), (2, "beta gamma"), (10, "x1 x2 x3 x4 x5 x6 x7"), (3, None), (4, "...") , (5, "alpha beta gamma delta"), (6, "été"), (None, "zz")]


def test_decontaminate(spark):
    rng = random.Random(5)
    vocabulary = "alpha beta gamma delta x1 x2 x3 x4 x5 x6 x7 été other ALPHA".split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(60)] + [None, "", "x1 x2, x3-x4 X5. x6 x7 x1", "no hit", "other " * 200_000 + "beta gamma"]
    found = [(i, t, None, None) for i, t in enumerate(texts)] + [(3, texts[3], None, None)]
    bench = spark.createDataFrame([(*r, 9) for r in ITEMS], "item_id long, text string, doc_id long")
    for window in (3, 5):
        want = collections.Counter((i, *brute_hits(t, [x for x in ITEMS if x[0] is not None], window)) for i, t, *_ in found)
        for block in (400_000, 5):
            assert collections.Counter(tuple(r) for r in decontaminate.report(frame(spark, found), bench, window, block).collect()) == want
    assert decontaminate.report(frame(spark, []), bench).count() == 0
    assert not any(r.n_hit for r in decontaminate.report(frame(spark, found), bench.limit(0)).collect())


@pytest.mark.parametrize("block", [400_000, 4])
def test_decontaminate_remove(spark, block):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "never seen here at all"), (3, "three four five six")], "item_id long, text string")
    found = [(1, "Begin here and go on: One, two three four five six; the end of it all, so far as I know.", None, None), (2, "one two three four five six", None, None), (3, "clean  text", None, None), (4, None, None, None)]
    got = {r.doc_id: r.text for r in decontaminate.remove(frame(spark, found), bench, block_words=block).collect()}
    assert got == {1: "Begin here and go on: ; the end of it all, so far as I know.", 3: "clean  text", 4: None}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=25))
def test_automaton(items, words):
    items = [(k, [w.encode() for w in x]) for k, x in enumerate(items)]
    spans, found = decontaminate.Automaton(items, 3).match([w.encode() for w in words])
    want = brute_hits(" ".join(words), [(k, " ".join(w.decode() for w in x)) for k, x in items], 3)
    assert (sum(e - s for s, e in spans), len(found)) == (want[1], want[2])


PAGE = """<!DOCTYPE html><html><head><title>A  title</title><style>p{}</style></head><body><nav><ul><li>Home<li>About <b>us</b></ul></nav>
<h1>Head</h1><p>One<p>Two<br>three <span style="display: none">no</span><i>four</i><script>var t="</p>";</script>
<div hidden>gone</div><ol start=3><li>c<ul><li>nested</ul><li>d</ol>
<table><tr><th>Name<th>Count<tr><td>apple pie</td><td>3</td></tr><tr><td colspan=2>all</table><pre>  keep
   this</pre><template>x</template>tail &amp; end</body></html>"""


def test_html_layout():
    title, text = html_text.extract(PAGE)
    assert title == "A title"
    assert text.split("\n") == [
        "- Home", "- About us", "", "Head", "", "One", "", "Two", "three four", "", "3. c", "   - nested", "4. d", "",
        "Name       Count", "apple pie  3", "all", "", "  keep", "   this", "", "tail & end",
    ]


@pytest.mark.parametrize("html", [None, "", "   ", "<", "</p>", "<p", "<table><td>", "<div>" * 5000 + "deep", "<script>never closed", "<b></i>x</b>", "&#x110000;&bogus;", "\0"])
def test_html_odd(html):
    title, text = html_text.extract(html)
    assert title == "" and (text == "deep" if html and "deep" in html else True)


@pytest.mark.parametrize(("html", "lines"), [
    ("<table><tbody><td>a</td><td>b</td></tbody></table>", ["a  b"]),
    ("<table><thead><th>h<th>i<tbody><td>a<td>b<tr><td>c</table>", ["h  i", "a  b", "c"]),
    ("<table><tbody><form><tr><td>a</td><td>b</td></tr></form></tbody></table>", ["a  b"]),
    ("<table><tbody>one<tr><td>a</td></tr><div>two</div><tr><td>b</td></tr></tbody></table>", ["one", "two", "a", "b"]),
    ("<table><tbody><tr><td><table><tbody>in<tr><td>a</table></table>", ["in", "a"]),
    ("<table><colgroup>odd<col></colgroup><tr><td>a</table>", ["odd", "a"]),
    ("<table><tbody hidden><td>no</td></tbody><tr><td>a</table>", ["a"]),
    ("<p>let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> be</p>", ["let x=1 2 be"]),
    ("<p>see <svg><title>no</title>no<defs><text>no</text></defs><defs/><g><path d='x'/><text>one <tspan>two</tspan></text></g></svg>.</p>", ["see one two ."]),
    ("<p>a <svg><path d='x'><p>b", ["a", "", "b"]),
    ("<p>a <svg><foreignObject><div>b</div></foreignObject></svg></p>", ["a", "b"]),
])
def test_html_all_visible(html, lines):
    assert html_text.extract(html)[1].split("\n") == lines


@pytest.mark.parametrize(("html", "lines"), [
    ("a<![foo bar>b", ["ab"]), ("<![foo bar", [""]), ("a<!-- open <p>b", ["a"]), ("a<!-->b<!--->c", ["abc"]), ("1 < 2", ["1 < 2"]),
    ("<table><tr><td colspan=%s>x<td>y</table>" % ("9" * 5000), ["x  y"]), ("<ol start=%s><li>x</ol>" % ("9" * 5000), ["1000000000. x"]),
    ("<table><tr><td rowspan=2>aa<td>b<tr><td>c</table>", ["aa  b", "    c"]),
    ("<table><tr><td>x<td>yyyy<td>z<tr><td colspan=2>spanning text<td>q</table>", ["x  yyyy        z", "spanning text  q"]),
    ("<table><tfoot><tr><td>f</tfoot><tbody><tr><td>b<thead><tr><td>h</table>", ["h", "b", "f"]),
    ("<details><summary>S</summary>body</details><details open><summary>T</summary>body</details>", ["S", "T", "body"]),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b></div>", ["yes"]),
    ("<ul><li><pre>a\n\nb</pre><li>c</ul>", ["- a", "", "  b", "- c"]),
    ("<style>.h, #i{display:none} @media print{.k{display:none}} p.v{visibility:hidden}</style><p class=h>no<p id=i>no<p class='k v'>no<p class=k>yes", ["yes"]),
    ("<style>.h{display:none} .h.s{display:block}</style><p class='h s'>yes<p class=h style='display:block'>too", ["yes", "", "too"]),
    ("<textarea><b>x</textarea><script>'</p>'</script>", ["<b>x"]), ("<svg><text><![CDATA[a <b>]]></text></svg>", ["a <b>"]),
    ("<b>" * 3000 + "deep" + "<div>" * 2000 + "er", ["deep", "er"]),
])
def test_html_rules(html, lines):
    assert html_text.extract(html)[1].split("\n") == lines


PIECES = "< > ! [ -- \" ' / = & &# </ <!-- --> <![ <![CDATA[ ]]> <td <tr> <table> <svg> <math> <li> <pre> <title> <style> <select><option> <details> { } @media . # \0 é".split(" ")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*PIECES, "colspan=", "rowspan=9", "style=display:none", "9" * 30, "a", " ", "\n"]), st.text(max_size=5)), max_size=40))
def test_html_never_fails(parts):
    title, text = html_text.extract("".join(parts))
    assert isinstance(title, str) and "\r" not in title and not text.startswith("\n")


BLOCKS, INLINE, GONE = ("div", "p", "h2", "section", "blockquote", "ul", "ol"), ("b", "span", "a"), ("script", "style", "template", "noscript")


@st.composite
def pages(draw, depth=0):
    """(markup, the words that show) of a tree that is built without the renderer."""
    out, words = [], []
    for _ in range(draw(st.integers(0, 4))):
        kind = draw(st.integers(0, 6 if depth < 4 else 1))
        if kind < 2:
            w = draw(st.lists(st.sampled_from(["one", "two", "x&amp;y", "é"]), min_size=1, max_size=3))
            out.append(" " + " ".join(w) + " ")
            words += [x.replace("&amp;", "&") for x in w]
            continue
        inner, shown = draw(pages(depth=depth + 1))
        tag = draw(st.sampled_from(BLOCKS if kind < 5 else INLINE))
        how = draw(st.sampled_from(["", "", "", " hidden", ' style="display:none"', " class=gone"]))
        if kind == 6:
            out.append(f"<table><tr><td>{inner}</table>" if depth < 2 else inner)
            words += shown
        elif tag in ("ul", "ol"):
            out.append(f"<{tag}{how}><li>{inner}</{tag}>")
            words += [] if how else [None, *shown]
        elif tag == "p":
            out.append(f"<div{how}>{inner}</div>")
            words += [] if how else shown
        else:
            out.append(f"<{tag}{how}>{inner}</{tag}>")
            words += [] if how else shown
    if draw(st.booleans()):
        tag = draw(st.sampled_from(GONE))
        out.append(f"<{tag}>no</{tag}>")
    return "".join(out), words


@settings(max_examples=200, deadline=None)
@given(pages())
def test_html_words_of_trees(page):
    """All words that show, in order, and no others; marks of lists aside."""
    markup, words = page
    text = html_text.extract("<style>.gone{display:none}</style>" + markup)[1]
    got = [w for w in text.split() if not re.fullmatch(r"-|\d+\.", w)]
    want = [w for w in words if w]
    if "<table>" in markup:  # cells of several lines stand side by side
        assert collections.Counter(got) == collections.Counter(want)
    else:
        assert got == want


def test_html_long():
    text = html_text.extract("<p>" + "word " * 400_000 + "<table>" + "<tr><td>a<td>b" * 20_000)[1]
    assert len(text.split()) == 440_000
    for bad in ("<a b=\"" * 100_000, "<b>" * 100_000 + "</p>" * 1000, "<style>" + "@a{" * 20_000, "<!--" * 100_000, "&" * 300_000):
        html_text.extract(bad)


def test_html_table(spark):
    data = [(1, "u", PAGE, "t", "x"), (None, None, None, "t", "x"), (1, "u", PAGE, "t", "x"), (4, "u", "", "t", "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, title string, text string")
    got = html_text.extract_pages(pages).collect()
    assert len(got) == 4 and sorted(r.n_lines for r in got) == [0, 0, 22, 22]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_secrets(spark):
    live, copied = "Zx81kQpL0vRt55mNbW2c", "Ab12Cd34Ef56Gh78Ij90"
    found = [
        (1, f'Password = "abcdefgh1" and é API_KEY:{"k" * 9}, short token=abc', None, "a"),
        (2, f"AKIA{'Q' * 12} AKIAQ {'0123456789abcdef' * 2} deadbeef", None, "a"),
        (3, f"see {live} here", None, "a"), (4, f"again {live}", None, "a"), (5, copied, None, "a"), (6, copied, None, "b"), (7, None, None, None), (8, "", None, "a"),
        (9, "ſecret=abcdefghij paſsword=abcdefghij", None, "a"),
    ]
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, found)).collect()}
    assert got[1].spans == "assign:0:21,assign:29:46" and got[1].base_sha256 == sha(got[1].spans) and got[1].n_assign == 2
    assert got[2].spans == "access:0:16,hex:23:55" and (got[2].n_access, got[2].n_hex) == (1, 1)
    assert got[3].spans == "owned:4:24" and got[4].spans == "owned:6:26" and got[3].base_sha256 == sha("")
    assert got[5].spans == got[6].spans == "" and got[5].n_example == 1
    assert got[7].spans == got[8].spans == got[9].spans == ""
    assert secrets.scan_secrets(frame(spark, [])).count() == 0 and secrets.scan_secrets(frame(spark)).count() == len(rows())


def brute_base(text):
    """Leftmost spans of each kind that don't overlap, found by trying each place."""
    names, out = ("password", "passwd", "secret", "token", "apikey", "api_key"), []
    run = lambda i, ok: next((j for j in range(i, len(text) + 1) if j == len(text) or text[j] not in ok), i)
    value = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

    def assign(i):
        for name in names:
            if text[i : i + len(name)].translate(html_text_lower) != name:
                continue
            for quote in ([1, 0] if text[i + len(name) : i + len(name) + 1] in ('"', "'") and i + len(name) < len(text) else [0]):
                j = run(i + len(name) + quote, " ")
                if text[j : j + 1] not in (":", "=") or j >= len(text):
                    continue
                j = run(j + 1, " ")
                j += text[j : j + 1] in ('"', "'") and j < len(text)
                if run(j, value) > j:
                    return j, run(j, value)
        return None

    def plain(start, ok):
        return lambda i: (i, run(i + len(start), ok)) if text.startswith(start, i) and run(i + len(start), ok) > i + len(start) else None

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for kind, find, least in ((0, assign, 8), (1, plain("AKIA", upper), 16), (2, plain("", "0123456789abcdef"), 32)):
        i = 0
        while i < len(text):
            hit = find(i)
            if hit is None:
                i += 1
                continue
            if hit[1] - hit[0] >= least:
                out.append((kind, i, hit[1], text[hit[0] : hit[1]]))
            i = hit[1]
    return sorted(out, key=lambda x: (x[1], x[0]))


html_text_lower = {c: c + 32 for c in range(65, 91)}
PARTS = ["password", "PassWD", "secret", "Token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abcdefgh1", "AKIA", "QWERTY123456", "deadbeef" * 2, "0123456789abcdef", "x", "é", "\n", "-", "Zx81kQpL0vRt55mNbW2c"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25))
def test_secrets_against_brute_force(parts):
    text = "".join(parts)
    base = secrets.base_spans(text)
    assert base == brute_base(text)
    free = [m for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text) if all(e <= m.start() or s >= m.end() for _, s, e, _ in base)]
    want = [(3, m.start(), m.end(), m[0]) for m in free if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and secrets.bits(m[0]) >= 3.5]
    assert secrets.token_spans(text, base) == want


def test_secrets_ownership_against_brute_force(spark):
    rng = random.Random(12)
    values = [f"{x}x81kQpL0vRt55mNbW2{y}" for x in "ABCD" for y in "cde"]
    found = [(k, " and ".join(rng.choices([*values[:6], f"{values[7]}{k}", "plain"], k=3)) + rng.choice(["", " end"]), None, rng.choice(["a", "b", "c", None])) for k in range(40)]
    found += [(100 + k, found[k][1], None, "other") for k in range(5)]
    owners, repos = collections.defaultdict(lambda: collections.defaultdict(set)), collections.Counter()
    for _, t, _, owner in found:
        for v in set(re.findall(r"[A-Za-z0-9]{20,}", t)):
            owners[v][owner].add(t)
            repos[v] += 1
    example = {v: repos[v] >= 10 or (len(by) >= 2 and len(set().union(*by.values())) > 1) for v, by in owners.items()}
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, found)).collect()}
    for i, t, *_ in found:
        every = [m for m in re.finditer(r"[A-Za-z0-9]{20,}", t)]
        live = [m for m in every if not example[m[0]]]
        assert got[i].spans == ",".join(f"owned:{m.start()}:{m.end()}" for m in live)
        assert (got[i].n_live, got[i].n_example) == (len(live), len(every) - len(live))


def test_secrets_long():
    """Ten megabytes with 200,000 base spans and as many tokens, in time that grows with the length alone."""
    text = "".join(f"token={k:08d}zz Zx81kQpL0vRt55mNbW2c{k:08d} " for k in range(200_000))
    assert len(secrets.token_spans(text, secrets.base_spans(text))) == 200_000


def test_secrets_repositories(spark):
    """Widely copied at one owner; a document copied once to another; used twice a document; null and empty sources."""
    wide, few, copied, odd = (f"{x}x81kQpL0vRt55mNbW2c" for x in "ABCD")
    found = [(k, f"page {k} has {wide}", None, "a") for k in range(10)]
    found += [(20 + k, f"page {k} has {few} and {few}", None, "a") for k in range(9)]
    found += [(40, f"the key {copied} is mine", None, "a"), (41, f"the key {copied} is mine", None, "b")]
    found += [(50, f"one {odd}", None, None), (51, f"two {odd}", None, "")]
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, found)).collect()}
    assert {(got[k].n_example, got[k].n_live, got[k].spans) for k in range(10)} == {(1, 0, "")}
    assert {(got[20 + k].n_example, got[20 + k].n_owned) for k in range(9)} == {(0, 2)}
    assert {(got[k].n_example, got[k].n_live, got[k].spans) for k in (40, 41)} == {(0, 1, "owned:8:28")}
    assert {(got[k].n_example, got[k].n_live) for k in (50, 51)} == {(1, 0)}


def brute_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(w[s] for s in names if s not in capped)
        over = [s for s in names if s not in capped and left * w[s] / share > most * sizes[s] + 1e-9]
        if not over:
            return {s: most * sizes[s] if s in capped else left * w[s] / share for s in names}
        capped |= set(over)


@pytest.mark.parametrize("weights", [(1.0, 2.0, 3.0), (1.0, 50.0)])
def test_mix(spark, weights):
    found = rows(n=150)
    sizes = collections.Counter()
    for _, t, _, s in found:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes, weights, 3.0)
    got = mixing.mix(frame(spark, found), weights, slices=8).collect()
    assert len(got) == len(found)
    taken, longest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, found).repartition(3), weights, slices=8).collect()))
    assert sorted(r.taken for r in mixing.mix(frame(spark, found), weights, slices=1024).collect()) == sorted(r.taken for r in got)


def test_mix_inclusion(spark):
    """Of two sizes the larger is taken as many times more often as the root of its size says; the largest are certain."""
    found = [(k, " ".join(["w"] * (4 if k % 2 else 36)), None, "a") for k in range(4000)] + [(9000 + k, "w " * 90_000, None, "b") for k in range(2)]
    found += [(10_000 + k, "w", None, "b") for k in range(3000)]
    got = mixing.mix(frame(spark, found), (1.0, 1.0), most=3.0).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source, r.size].append(r.copies)
    share = {k: np.mean(v) - min(v) for k, v in by.items()}
    whole = {s: min(c for (x, _), v in by.items() if x == s for c in v) for s in "ab"}
    p = {k: np.mean(v) - whole[k[0]] for k, v in by.items()}
    assert 0.02 < p["a", 4] < 0.5 and abs(p["a", 36] / p["a", 4] - 3) < 0.5
    assert max(share.values()) < 1
    scale = mixing.scales(spark.createDataFrame([("s", 100.0, 90, 1), ("s", 100.0, 2, 20)], "source string, rest double, size long, n long"), 1.0).first().scale
    assert abs(90 + 20 * 2 * scale * 2 * 1024 - 100) < 1e-6  # the one of 90 is certain


def test_mixed_rows(spark):
    docs = frame(spark, rows(n=150))
    want = {(r.doc_id, r.source, r.size): r.copies for r in mixing.mix(docs).collect()}
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    count = collections.Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in got.collect())
    times = collections.Counter((r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows(n=150))
    assert count == collections.Counter({k: n * times[k] for k, n in want.items() if n})
    assert mixing.mixed(frame(spark, [])).count() == 0


def test_mix_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None, None), (2, " ", None, "a")])).collect()] == [0, 0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens(spark, name):
    path = registry.tokenizer_path(name)
    found = rows() + [(200 + k, t, None, None) for k, t in enumerate(["  a", "a \n b ", "x <|endoftext|> y", "<|endoftext|>", "\0 \0x", "a  b", " \x1cq", prose(random.Random(1), 30_000)])]
    folder = work_path(spark, "test-tokens")
    shards = token_output.write_tokens(frame(spark, found), path, folder)
    got = token_output.read_tokens(spark, folder, shards, with_ids=True).orderBy("start").collect()
    library = token_output.encoder(path).library
    want = collections.Counter((i, *library.encode(t or "", add_special_tokens=False).ids, 0) for i, t, *_ in found)
    assert collections.Counter((r.doc_id, *r.ids) for r in got) == want
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    with open(folder.removeprefix("file://") + "/manifest.json") as f:
        assert sum(s["ids"] for s in json.load(f)["shards"]) == start


def test_tokens_empty(spark):
    folder = work_path(spark, "test-none")
    shards = token_output.write_tokens(frame(spark, []), registry.tokenizer_path(), folder)
    assert shards == [] and token_output.read_tokens(spark, folder, shards).count() == 0


ALPHABET = {"aa": "abcde", "bb": "efghi", "cc": "ijklé"}


def spoken(rng, lang, n):
    return prose(rng, n, ALPHABET[lang])


def test_language(spark):
    rng = random.Random(6)
    found = [(i, spoken(rng, lang, rng.randint(5, 80)), lang, "s") for i in range(240) for lang in [rng.choice(list(ALPHABET))]]
    model = language_id.fit(language_id.learners(frame(spark, found)))
    assert model[0] == sorted(ALPHABET)
    odd = [(900, None, None, None), (901, "", "aa", None), (902, "123 … 45", None, None), (None, "bcd abc dab", None, None)]
    mixed = [(903, spoken(rng, "aa", 300) + " " + spoken(rng, "cc", 100), None, None)]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, found + odd + mixed), model).collect()}
    out = [i for i, *_ in found if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(got[i].lang_pred == found[i][2] for i in out) / len(out)
    assert right >= 0.95
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[None].lang_pred in ALPHABET and all(0 <= r.score <= 1 for r in got.values())
    shares = {k: float(v) for k, v in (x.split(":") for x in got[903].langs.split(","))}
    assert got[903].lang_pred == "aa" and abs(shares["aa"] - 0.75) < 0.1 and abs(shares["cc"] - 0.25) < 0.1 and shares.get("bb", 0) < 0.05
    pure = language_id.identify(frame(spark, [(1, spoken(rng, "bb", 400), None, None)]), model).first()
    assert (pure.lang_pred, pure.langs) == ("bb", "bb:1.00")
    held = frame(spark, found).select("doc_id", language_id.held_out().alias("h")).collect()
    assert {r.doc_id for r in held if r.h} == set(out)


def test_language_of_many():
    """Seven languages whose words are plain to tell: a document of six keeps all six, one of two only its two."""
    own = np.full((7, 7), -12.0)
    np.fill_diagonal(own, -2.0)
    words = [[k for k in range(6) for _ in range(35 - 6 * k)], [k % 2 for k in range(120)]]
    got = language_id.infer(own[np.array(sum(words, []))], np.array([120, 120]))
    assert np.allclose(got[0], [35 / 120, 29 / 120, 23 / 120, 17 / 120, 11 / 120, 5 / 120, 0], atol=0.01)
    assert np.allclose(got[1], [0.5, 0.5, 0, 0, 0, 0, 0], atol=0.01)


def brute_mixture(logs):
    """EM by the book until nothing moves, from all languages down, on one document's words."""
    like = np.exp(logs - logs.max(1, keepdims=True)).astype(float)
    n, on, best = len(logs), list(range(logs.shape[1])), None
    while on:
        p = np.full(len(on), 1 / len(on))
        for _ in range(20_000):
            r = like[:, on] * p
            p, before = (r / r.sum(1, keepdims=True)).mean(0), p
            if np.abs(p - before).max() < 1e-9:
                break
        score = np.log((like[:, on] * p).sum(1)).sum() - 0.5 * np.log(n + 1) * len(on)
        if best is None or score > best[0]:
            best = score, {on[k]: p[k] for k in range(len(on))}
        on.pop(int(p.argmin()))
    return [best[1].get(k, 0.0) for k in range(logs.shape[1])]


def test_mixture_against_brute_force():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 90, 60)
    logs = []
    for n in sizes:
        truth = rng.dirichlet(np.full(4, 0.4))
        own = rng.choice(4, n, p=truth)
        x = rng.normal(-9, 2, (n, 4))
        x[np.arange(n), own] += rng.normal(5, 3, n)
        logs.append(x)
    got = language_id.infer(np.concatenate(logs), sizes)
    for p, x in zip(got, logs, strict=True):
        want = np.array(brute_mixture(x))
        assert np.abs(p - want).max() < 0.02 and p.argmax() == want.argmax()


def test_language_repeats_and_long_texts(spark):
    rng = random.Random(7)
    found = [(i, spoken(rng, lang, 40), lang, "s") for i in range(90) for lang in [list(ALPHABET)[i % 3]]]
    model = language_id.fit(language_id.learners(frame(spark, found + found[:9])))
    long = spoken(rng, "bb", 150_000)
    odd = [(500, long, None, None), (501, "a" * 2_000_000, None, None), found[0], found[0]]
    got = language_id.identify(frame(spark, odd), model).collect()
    assert len(got) == 4 and {r.lang_pred for r in got if r.doc_id == 500} == {"bb"}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 0}) == 1


def test_language_without_learners(spark):
    model = language_id.fit(frame(spark, [(1, None, "en", None), (2, "abc", None, None)]))
    assert [r.lang_pred for r in language_id.identify(frame(spark, [(1, "abc", None, None)]), model).collect()] == ["und"]
    assert language_id.identify(frame(spark, []), model).count() == 0
