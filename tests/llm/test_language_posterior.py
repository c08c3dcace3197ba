"""op10: the fused posterior of every page against a plain version."""

import math
import re
from collections import defaultdict

import numpy as np

from rentlens.llm import language_id as li
from tests.conftest import SF_CHECK


def plain_posteriors(rows, names, logp):
    """(lang, probability) of each (page_id, url, html), evidence by evidence."""
    n = len(names)
    seen = []
    for _, url, html in rows:
        c = li.cells(li.visible_text(html))
        ll = [float(logp[k][c].sum(dtype=np.float64)) / li.TEMPER if len(c) else 0.0 for k in range(n)]
        ll = [x - max(ll) for x in ll]
        total = sum(math.exp(x) for x in ll)
        first = lambda pattern, s: (lambda m: m.group(1) if m and m.group(1) else None)(re.search(pattern, s or ""))
        host = (first(r"://([^/?#:]*)", url) or "").lower() or None
        seen.append({"text": ll, "share": [math.floor(math.exp(x) / total * 1e6 + 0.5) / 1e6 for x in ll], "host": host,
                     "domain": first(r"([^.]+\.[^.]+)$", host) or host, "suffix": first(r"([^.]+)$", host), "declared": li.declared_language(html),
                     "section": (first(r"://[^/?#]*/([A-Za-z]{2,3})(?:[/?#]|$)", url) or "").lower() or None})
    counts = {kind: defaultdict(lambda: [0.0] * n) for kind in ("host", "domain", "suffix", "section", "declared")}
    for s in seen:
        for kind, of in counts.items():
            if s[kind] is not None:
                of[s[kind]] = [a + b for a, b in zip(of[s[kind]], s["share"])]
    everywhere = [sum(s["share"][k] for s in seen) for k in range(n)]
    root = [(x + 1) / (sum(everywhere) + n) for x in everywhere]
    smooth = lambda own, parent: [(x + li.PARENT_WEIGHT * p) / (sum(own) + li.PARENT_WEIGHT) for x, p in zip(own, parent)]
    out = []
    for s in seen:
        prior = smooth(counts["host"][s["host"]], smooth(counts["domain"][s["domain"]], root)) if s["host"] else root
        belief = [x + math.log(p) for x, p in zip(s["text"], prior)]
        for kind in ("declared", "suffix", "section"):
            if s[kind] is not None:
                given = [sum(v[k] for v in counts[kind].values()) for k in range(n)]
                values = len(counts[kind]) + 1
                belief = [b + math.log((c + 0.5) / (g + 0.5 * values)) for b, c, g in zip(belief, counts[kind][s[kind]], given)]
        best = max(belief)
        out.append((names[belief.index(best)], 1 / sum(math.exp(b - best) for b in belief), sorted(belief)))
    return out


def test_posteriors_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    odd = [(-1, None, None), (-2, "", ""), (-3, "odd", "<html lang=de><p>das haus"), (-4, "http://a.de:80/en/x", "<!-- x"), (-5, "http://LOCALHOST/fr", "<p>le jardin"),
           (-6, "http://x.de/", "<p>" + "garten und haus " * 30_000), (-7, "http://a.de:80/en/x", "<!-- x"), (-8, "://", "<p>1 2 3")]
    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet").select("page_id", "url", "html").unionByName(
        spark.createDataFrame(odd, "page_id long, url string, html string"))
    rows = [tuple(r) for r in pages.collect()]
    assert len(rows) >= 200
    names, logp = li.text_models(docs, 500)
    want = {r[0]: w for r, w in zip(rows, plain_posteriors(rows, names, logp))}
    got = li.language_id(pages, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, probability, belief = want[r.page_id]
        assert abs(r.probability - probability) < 5e-6, r
        assert r.lang == lang or belief[-1] - belief[-2] < 1e-9
