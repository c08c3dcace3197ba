"""Spelling variants, vector codes and main text of pages against plain Python versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.llm import html_extract as h
from rentlens.llm import spelling_variants as sv
from rentlens.llm import vector_codes as vc
from tests.llm.test_pairs import frame

LOWER = {c: c + 32 for c in range(65, 91)}


def vocabulary(rows, shortest=7, least=2, every=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            crc = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = crc % len(run)
            n[run[:at] + run[at + 1:] if crc % every == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(n, ratio=10):
    out, form = {}, {}
    for w, c in n.items():
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * c else None
        out[w] = (c, len(others), form[w], n[best] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def misspelt(seed, n=40):
    rng = random.Random(seed)
    letters = "abcdeñéÀ×ÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "x" * 3000]
    weights = [4 ** (i % 5) for i in range(len(stems))]
    texts = []
    for _ in range(n):
        words = rng.choices(stems, weights, k=60)
        for i in range(0, 60, 7):
            at = rng.randrange(len(words[i]))
            words[i] = words[i][:at] + rng.choice(["", rng.choice(letters), words[i][at] * 2]) + words[i][at + 1:]
        texts.append(rng.choice([" ", "1", ", ", "Ÿ"]).join(w.upper() if rng.random() < 0.2 else w for w in words))
    return texts


def test_spelling_variants(spark):
    texts = misspelt(3)
    rows = list(enumerate(texts)) + [(None, texts[0]), (5, texts[5]), (900, None), (901, ""), (902, "short")]
    want = grouped(vocabulary(rows, every=5))
    assert sum(w[2] is not None for w in want.values()) > 5 and any(w[1] > 1 for w in want.values())
    docs = frame(spark, rows).withColumn("word", F.lit("clash")).withColumn("N", F.lit(1))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in sv.spelling_variants(docs, every=5).collect()}
    assert got == want
    assert sv.spelling_variants(docs.where("false")).count() == 0


def test_spelling_chains_and_ties(spark):
    # a -> b -> c; of two equally common near words the smaller is the form
    counts = {"wordaaa": 2, "wordaab": 30, "wordabb": 400, "wordaac": 30}
    rows = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(counts.items())]
    got = {r.word: (r.n_near, r.form, r.root) for r in sv.spelling_variants(frame(spark, rows), every=1 << 40).collect()}
    assert got == {"wordaaa": (2, "wordaab", "wordabb"), "wordaab": (3, "wordabb", "wordabb"), "wordabb": (1, None, "wordabb"), "wordaac": (2, None, "wordaac")}


@pytest.mark.parametrize("size,k", [(1, 2), (5, 3), (9, 4)])
def test_neighbourhoods_are_full_and_without_repeats(size, k):
    rng = np.random.default_rng(size)
    words = rng.integers(0, k, (20, size))
    got = [[] for _ in words]
    for row, key in sv.neighbour_hashes(words, k):
        for r, x in zip(row, key):
            got[r].append(int(x))

    def whole(word):
        return int(next(sv.neighbour_hashes(np.array([word]).reshape(1, len(word)), k))[1][0])

    for word, keys in zip(words.tolist(), got):
        edits = {tuple(word)} | {tuple(word[:i] + word[i + 1:]) for i in range(size)}
        edits |= {tuple(word[:i] + [c] + word[i + 1:]) for i in range(size) for c in range(k)}
        edits |= {tuple(word[:i] + [c] + word[i:]) for i in range(size + 1) for c in range(k)}
        assert len(keys) == len(edits) and set(keys) == {whole(list(e)) for e in edits if e} | ({0} & set(keys) if () in edits else set())


def coded(rows, parts, entries, rounds, scale):
    """rows (id, ints): codes, errors and codebooks by the rules, in Python's integers."""
    width = len(rows[0][1]) // parts
    cut = [[r[1][p * width:(p + 1) * width] for p in range(parts)] for r in rows]
    first = sorted(range(len(rows)), key=lambda i: rows[i][0])[:entries]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [best(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, of) if o == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    out = {}
    for (i, _), c in zip(rows, cut):
        found = [best(x, book) for x, book in zip(c, books)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, books


@pytest.mark.parametrize("dim,parts,entries,spread", [(24, 8, 16, 0.3), (12, 4, 3, 5.0), (10, 2, 300, 1.0), (8, 8, 5, 1e25)])
def test_vector_codes(spark, dim, parts, entries, spread):
    rng = np.random.default_rng(dim)
    values = [(i * 7 % 401, [float(x) for x in rng.normal(0, spread, dim).astype(np.float32)]) for i in range(400)]
    values[5] = (values[5][0], values[9][1])
    odd = [(500, None), (501, [float("nan")] * dim), (502, [None] + [0.0] * (dim - 1)), (503, [float("inf")] * dim)]
    df = spark.createDataFrame([(i, v, i % 3 or None, "x", 1) for i, v in values + odd], "vec_id long, embedding array<float>, label int, code string, ERROR int")
    ints = [(i, [int(np.floor(x * 4096)) if abs(x) < 1e9 else int(x) * 4096 for x in v]) for i, v in values]
    want, books = coded(ints, parts, entries, 3, 4096)
    trained = vc.train_codebooks(df, parts=parts, entries=entries, rounds=3)
    assert [[list(e) for e in p] for p in trained.entries] == books
    got = vc.with_group_error(vc.vector_codes(df, trained)).collect()
    fits = lambda x: x if x < 1 << 63 else None
    digits = {i: (re.sub("..", lambda m: m.group(), c), fits(e)) for i, (c, e) in want.items()}
    assert {r.vec_id: (r.code, r.error) for r in got} == digits if entries <= 256 else len(got) == 400
    for label in {r.label for r in got}:
        mine = [r for r in got if r.label == label]
        total = fits(sum(want[r.vec_id][1] for r in mine)) if all(r.error is not None for r in mine) else None
        assert {r.label_error for r in mine} == {total}


def test_vector_codes_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(3, [1.0, 2.0], 1), (None, [1.0], 1), (1, [], None), (1, [], None), (2, [0.5, -0.5, 9.0], None)], schema)
    books = vc.train_codebooks(few, parts=2, entries=4, rounds=2)
    assert books.width == 2 and all(len(p) == 4 for p in books.entries)
    got = vc.with_group_error(vc.vector_codes(few, books)).collect()
    assert len(got) == 5 and len({(r.code, r.error) for r in got if r.vec_id == 1}) == 1
    none = vc.train_codebooks(few.where("false"))
    assert vc.with_group_error(vc.vector_codes(few.where("false"), none)).count() == 0


def test_walsh_hadamard_sums_and_order():
    rng = np.random.default_rng(2)
    x, e = rng.integers(-50, 50, (30, 11)), rng.integers(-50, 50, (7, 11))
    e[4] = e[2]  # a tie goes to the first
    near_, d = vc.nearest(x, e)
    whole = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    assert (d == whole.min(axis=1)).all() and (near_ == whole.argmin(axis=1)).all()
    changes = (np.diff(np.sign(vc.walsh(np.eye(16, dtype=np.int64))), axis=0) != 0).sum(axis=0)
    assert changes.tolist() == list(range(16))


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="no-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div id="wrap"><div class="cookie-notice">We use cookies, ok, yes.</div><div class="layout">
<div class="sidebar"><p>Side, side, side, side.</p></div><div class="post-content"><h1>A &lt;title&gt;</h1><p>First,&nbsp;with
 <b>bold</b><br>text &amp; more, and commas.<p>Short<script>var x = "</p>";</script><ul><li>one<li>t<i>w</i>o</ul><div class="ad">Buy, now.</div>
<table><tr><td>a<td>b</table><pre>x   y</pre></div><div class="comments"><article><p>nice, very, very nice post, thanks a lot.</p></article></div>
</div></div><form><p>Sign up, please, now.</p></form><aside>x</aside><footer>&copy; f</footer></body>"""


@pytest.mark.parametrize("page,text", [
    (PAGE, "A <title>\nFirst, with bold text & more, and commas.\nShort\none\ntwo\na\nb\nx y"),
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b &am &amp c", "a\nb &am & c"),
    ("<article><section><p>one, two, three.</p></section><section><p>z</p></section></article><footer>f</footer>", "one, two, three.\nz"),
    ("<div class=banner>only this</div>", "only this"),  # names are not believed if nothing else is there
    ("<nav><a>x</a></nav><footer>f</footer>", ""),
    ("<form><main><p>The whole page in a form.</p></main><input></form>", "The whole page in a form."),
    ("<body><div><p>Long text, with commas, and so on.</p></div><div><p>© 2020</p></div><p>cut <b>off", "Long text, with commas, and so on."),
    ("<article><h1>t</h1><p>x</p><article class='comment'><p>reader, reader, reader</p></article></article>", "t\nx"),
    ("<!-- <p>no</p> --><p>a < b</p><!-- open <p>no</p>", "a < b"),
])
def test_main_text(page, text):
    assert h.main_text(page) == text


def test_main_text_of_long_and_deep_pages():
    assert h.main_text("<p>word, " * 50_000) == "\n".join(["word,"] * 50_000)
    assert h.main_text("<div>" * 20_000 + "deep") == "deep"
    assert h.main_text('<a "x ' * 50_000) is not None
    assert len(h.main_text("<b>x" * 20_000)) == 20_000


def test_html_main_text_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>é😀</p>", "clash"), (1, "u", "<p>é😀</p>", "clash"), (None, None, None, None)], "page_id long, url string, html string, TEXT string")
    got = h.html_main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "u", "é😀", 2), (1, "u", "é😀", 2), (None, None, "", 0)]
    assert h.html_main_text(df.where("false")).count() == 0
