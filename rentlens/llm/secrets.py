"""Secret scans: rule-based spans, and a character convolutional network over further candidates.

Base spans come from three rules (assignments to a secret's name, access keys,
long hex runs) and always stay.  Candidates of the network are the base spans and
all other runs of ``SHORTEST`` or more letters, digits and signs of keys, whatever
their alphabet.  The network reads the candidate and its context (``SIDE``
characters each side), character by character: embedding, convolution with three
widths, maximum over positions inside the candidate and around it, a hidden layer,
one logit.  Of a value longer than ``ROOM`` it reads overlapping windows, and the
highest score counts.

Training.  Positive findings are the base findings as they stand, their values and
random ones of their shape without the name before them, and, in their place and that of an
ordinary run, random letters, random mixed values, and random values of each kind (letters,
digits, mixed) after a secret's name with other words or signs between.  Negative ones are ordinary runs of the text,
words joined by signs, numbers, and ordinary words after a secret's name; a number
is a secret only after such a name, and a run soon after one in the text has no label.  One scan of all documents makes them: of
documents with base findings all, of the others those of a sample by hash of about
``sample_docs``; at most ``sample_rows`` of each label, chosen by hash, train the network.
Three tenths of all documents are held out: a logistic map calibrates the logit on every
finding of theirs, and a kind's threshold is the highest that ``recall`` of their positive
findings of the kind reach, or lower, down to where ``FALSE_ALARMS`` of their negative
ones are beyond it (from grouped counts of logits rounded to 1 / ``CELLS``).

Spans are half-open, in code points.  Null or empty text has none.  Very long
texts are scanned whole.  Rows that repeat give equal results.  If no document has
base findings, only base spans are returned.  Columns of the input pass
through; ``spans`` (array of kind, start, end, base, score) is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import carried, discard, mapped, sliced, written

#: The rules, in the order that breaks ties.
KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Names and what may stand between a name and a value, for made findings.
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "credential")
BETWEEN = (" ", " is ", " -> ", " => ", ": <", "\t", " was ", " (", " := '", "\n")
NAMED = re.compile("|".join(NAMES), re.I)
VALUE_KINDS = ("letters", "digits", "mixed")

#: Shortest run that is a candidate; shortest ordinary run of the training.
SHORTEST, ORDINARY = 12, 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)

SIDE = 20
WIDTH = 88
#: Characters of a value in a window.
ROOM = WIDTH - 2 * SIDE
SPAN_CLASS = 97
TRAIN_STEPS = 1500
#: Random values put in a finding's place, beside its own.
COPIES = 3
#: Where so small a share of the negative findings of a kind is beyond a lower threshold, that one is taken.
FALSE_ALARMS = 0.0005
#: Cells of a unit of logit, in which findings are counted.
CELLS = 100


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def further_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidates of the network that no base span touches."""
    out, taken = [], sorted((s, e) for _, s, e in base)
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if not any(a < e and s < b for a, b in taken):
            out.append((s, e))
    return out


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, number of the span) of each window: characters in and around it, those of the span marked by the second plane."""
    views = [(i, at, min(at + ROOM, e)) for i, (s, e) in enumerate(spans)
             for at in ([s] if e - s <= ROOM else [*range(s, e - ROOM, ROOM // 2), e - ROOM])]
    out = np.zeros((len(views), 2, WIDTH), np.uint8)
    for j, (_, s, e) in enumerate(views):
        line = text[max(0, s - SIDE): s].rjust(SIDE, "\0") + text[s: e + SIDE]
        raw = np.frombuffer(line.encode("ascii", "replace"), np.uint8)[:WIDTH]
        out[j, 0, : len(raw)] = np.where((raw >= 32) & (raw < 127), raw - 31, 0)
        out[j, 1, SIDE: SIDE + e - s] = 1
    return out, np.array([v[0] for v in views], np.int64)


def highest(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The highest of the values of each span; ``of`` ascends and misses none."""
    return np.maximum.reduceat(values, np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))) if len(of) else values


class CharNet:
    """Embedding, convolutions of widths 3, 5 and 7, maxima, a hidden layer; float32 numpy."""

    FILTERS, EMBED, HIDDEN, SIZES = 12, 8, 16, (3, 5, 7)

    def __init__(self, seed: int):
        g = np.random.default_rng(seed)
        self.p = {"embed": g.normal(0, 0.3, (SPAN_CLASS, self.EMBED))}
        for w in self.SIZES:
            self.p[f"w{w}"] = g.normal(0, (2 / (w * (self.EMBED + 1))) ** 0.5, (w * (self.EMBED + 1), self.FILTERS))
            self.p[f"b{w}"] = np.zeros(self.FILTERS)
        n = 2 * self.FILTERS * len(self.SIZES)
        self.p |= {"h": g.normal(0, (2 / n) ** 0.5, (n, self.HIDDEN)), "hb": np.zeros(self.HIDDEN),
                   "o": g.normal(0, (1 / self.HIDDEN) ** 0.5, (self.HIDDEN, 1)), "ob": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, keep: bool = False):
        p, chars, mark = self.p, x[:, 0].astype(np.int64), x[:, 1].astype(np.float32)
        z = np.concatenate([p["embed"][chars], mark[:, :, None]], axis=2)
        pooled, back = [], []
        for w in self.SIZES:
            cols = np.concatenate([z[:, i: WIDTH - w + 1 + i] for i in range(w)], axis=2)
            a = np.maximum(cols @ p[f"w{w}"] + p[f"b{w}"], 0)
            inside = mark[:, w // 2: WIDTH - w + 1 + w // 2, None]
            for part in (a * inside, a * (1 - inside)):
                at = part.argmax(axis=1)
                pooled.append(np.take_along_axis(part, at[:, None], 1)[:, 0])
                back.append((w, cols, at))
        f = np.concatenate(pooled, axis=1)
        h = np.maximum(f @ p["h"] + p["hb"], 0)
        out = (h @ p["o"] + p["ob"])[:, 0]
        return (out, f, h, back, chars) if keep else out

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, seed: int, rate: float = 0.006) -> None:
        """Adam on the logistic loss; half of each batch is positive, and the rate falls to zero."""
        g = np.random.default_rng(seed)
        sides = [np.flatnonzero(y == v) for v in (0, 1)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for step in range(1, steps + 1):
            some = np.concatenate([g.choice(s, 64) for s in sides])
            for k, d in self._gradient(x[some], y[some]).items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                speed = rate * (1 - (step - 1) / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
                self.p[k] -= speed.astype(np.float32)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        out, f, h, back, chars = self.forward(x, keep=True)
        d = ((1 / (1 + np.exp(-out)) - y) / len(y)).astype(np.float32)[:, None]
        g = {"o": h.T @ d, "ob": d.sum(axis=0)}
        dh = (d @ p["o"].T) * (h > 0)
        g |= {"h": f.T @ dh, "hb": dh.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        df = (dh @ p["h"].T) * (f > 0)
        rows, n, e = np.arange(len(y)), self.FILTERS, self.EMBED + 1
        for i, (w, cols, at) in enumerate(back):
            db = df[:, i * n: (i + 1) * n]  # the gradient reaches the position of the maximum alone
            taken = cols[rows[:, None], at]
            g[f"w{w}"] = g.get(f"w{w}", 0) + np.einsum("rfc,rf->cf", taken, db)
            g[f"b{w}"] = g.get(f"b{w}", 0) + db.sum(axis=0)
            dz = db[:, :, None] * p[f"w{w}"].T[None]
            for j in range(w):
                cell = chars[rows[:, None], at + j][:, :, None] * self.EMBED + np.arange(self.EMBED)
                g["embed"] += np.bincount(cell.ravel(), dz[:, :, j * e: j * e + self.EMBED].ravel(), SPAN_CLASS * self.EMBED).reshape(SPAN_CLASS, self.EMBED)
        return g

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i: i + 512]) for i in range(0, len(x), 512)]) if len(x) else np.empty(0, np.float32)


def calibrated(logit: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic map over findings that count ``n`` times, by damped Newton steps with a small ridge."""
    def loss(a: float, b: float) -> float:
        z = a * logit + b
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 5e-3 * ((a - 1) ** 2 + b * b))

    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w, miss = n * q * (1 - q), n * (q - y)
        grad = np.array([(miss * logit).sum() + 1e-2 * (a - 1), miss.sum() + 1e-2 * b])
        hess = np.array([[(w * logit * logit).sum() + 1e-2, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-2]])
        da, db = np.linalg.solve(hess, grad)
        step, before = 1.0, loss(a, b)
        while step > 1e-6 and not loss(a - step * da, b - step * db) <= before:
            step /= 2
        if step <= 1e-6 or max(abs(da), abs(db)) < 1e-9:
            break
        a, b = a - step * da, b - step * db
    return float(a), float(b)


class SecretModel:
    def __init__(self, net: CharNet, slope: float, offset: float, thresholds: dict[str, float]):
        self.net, self.slope, self.offset, self.thresholds = net, slope, offset, thresholds

    def scores(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The score of each span whose windows are ``x``."""
        return 1 / (1 + np.exp(-np.clip(self.slope * highest(self.net.logits(x), of).astype(np.float64) + self.offset, -30, 30)))


def kind_of(value: str) -> str:
    """The kind whose threshold judges a further candidate: what its characters look like."""
    plain = value.strip("+/_=-").replace("-", "").replace("_", "").replace("/", "")
    return "digits" if plain.isdigit() else "letters" if plain.isalpha() else "mixed"


def made(kind: str, g: np.random.Generator) -> str:
    """A random value of a kind."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    sets = {"digits": [digits], "letters": [lower, upper, lower + upper], "mixed": [lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/_-"]}[kind]
    some = sets[int(g.integers(len(sets)))]
    return "".join(some[int(i)] for i in g.integers(0, len(some), int(g.integers(SHORTEST, 41))))


def alike(value: str, g: np.random.Generator) -> str:
    """A random value of the same alphabet and shape."""
    sets = ["0123456789abcdef"] if re.fullmatch("[0-9a-f]+", value) else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    of = {c: s for s in sets for c in s}
    return "".join(of[c][int(g.integers(len(of[c])))] if c in of else c for c in value)


def findings(text: str, seed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labelled findings of a text: (windows, number of a window's finding, label, kind)."""
    g = np.random.default_rng(seed)
    x, of, y, kinds = [], [], [], []

    def add(line: str, s: int, e: int, label: int) -> None:
        some, _ = windows(line, [(s, e)])
        x.append(some)
        of.extend([len(y)] * len(some))
        y.append(label)
        kinds.append(kind_of(line[s:e]))

    def put(s: int, e: int, value: str, label: int, name: str = "") -> None:
        """``value`` in the place of text[s:e], after ``name``."""
        before, after = text[max(0, s - SIDE): s] + name, text[e: e + SIDE]
        add(before + value + after, len(before), len(before) + len(value), label)

    def named() -> str:
        return NAMES[int(g.integers(len(NAMES)))] + BETWEEN[int(g.integers(len(BETWEEN)))]

    base = base_spans(text)
    for kind, s, e in base:
        add(text, s, e, 1)
        value = ASSIGN.match(text, s).group(2) if kind == 0 else text[s:e]
        if kind_of(value) != "digits":  # without its name, a number is a number
            for v in (value, *(alike(value, g) for _ in range(COPIES))):
                put(s, e, v, 1)
        put(s, e, text[s:e].replace(value, alike(value, g)), 1)
    taken = [(s, e) for _, s, e in base]
    # a run soon after a secret's name may be one that no rule finds, and has no label
    free = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % ORDINARY, text)
            if not NAMED.search(text, max(0, m.start() - SIDE), m.start()) and not any(a < m.end() and m.start() < b for a, b in taken)]
    long = [f for f in free if f[1] - f[0] >= SHORTEST]
    picked = [some[i] for some in (free, long) for i in sorted(g.permutation(len(some))[:3])]
    for s, e in picked:
        add(text, s, e, 0)
    for s, e in [*((s, e) for _, s, e in base), *picked[:1]]:
        for of_kind in VALUE_KINDS:
            put(s, e, made(of_kind, g), 1, named())
            if of_kind != "digits":
                put(s, e, made(of_kind, g), 1)
    for s, e in picked[:1]:  # in its place a number, words joined as in references and paths, and a word after a name
        other = free[int(g.integers(len(free)))]
        word = text[other[0]:other[1]]
        digits = "".join(map(str, g.integers(0, 10, int(g.integers(SHORTEST, 21)))))
        put(s, e, digits, 0)
        for sign in "-_/":
            put(s, e, text[s:e] + sign + word + sign + digits[:3], 0)
            put(s, e, text[s:e] + sign + word, 0)
        put(s, e, text[s:e] + word, 0)
        put(s, e, word, 0, named())
        put(s, e, text[s:e] + word, 0, named())
    return (np.concatenate(x) if x else np.zeros((0, 2, WIDTH), np.uint8)), np.array(of, np.int64), np.array(y, np.float64), np.array(kinds)


def training_rows(t: DataFrame, sample_docs: int, sample_rows: int, seed: int, early: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows, label): at most ``sample_rows`` windows of each label of documents of ``t`` (h, text), from one scan.

    All documents with base findings and a hash sample of about ``sample_docs`` of all are in it.
    """
    every = max(1, t.count() // max(sample_docs, 1))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, rows=200, text="text"):
            out: dict[str, list] = {"place": [], "early": [], "y": [], "hit": [], "x": []}
            for h, use, text in zip(*(part.column(c).to_pylist() for c in ("h", "early", "text"))):
                hit = bool(base_spans(text))
                if hit or h % every == 0:
                    x, of, y, _ = findings(text, [seed, h & (1 << 63) - 1])
                    out["x"] += [w.tobytes() for w in x]
                    out["y"] += [int(v) for v in y[of]]
                    out["place"] += np.random.default_rng([h & (1 << 63) - 1, seed]).integers(0, 1 << 62, len(x)).tolist()
                    out["early"] += [use] * len(x)
                    out["hit"] += [hit] * len(x)
            yield out

    rows = mapped(t.select("h", F.expr(early).alias("early"), "text"), run, "place long, early boolean, y int, hit boolean, x binary")
    rows = written(rows, "findings")
    some = rows.where("early")
    if some.where("hit").isEmpty():  # the only base findings are held out
        some = rows
    got = [] if some.where("hit").isEmpty() else [
        r for label in (1, 0) for r in some.where(F.col("y") == label).select("place", "x", "y").orderBy("place", "x").limit(sample_rows).collect()]
    discard(rows)
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.uint8).reshape(len(got), 2, WIDTH)
    return x, np.array([r.y for r in got], np.float64)


def held_counts(t: DataFrame, net: CharNet, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(logit, label, kind, n) over the findings of all texts of ``t``, from grouped counts of logits rounded to 1/CELLS."""
    held = t.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, rows=200, text="text"):
            cells: dict[tuple, int] = {}
            for h, text in zip(part.column("h").to_pylist(), part.column("text").to_pylist()):
                x, of, y, kinds = findings(text, [seed, h & (1 << 63) - 1])
                logit = highest(held.value.logits(x), of)
                for cell in zip(np.rint(np.clip(logit, -30, 30) * CELLS).astype(int).tolist(), y.tolist(), kinds.tolist()):
                    cells[cell] = cells.get(cell, 0) + 1
            logit, y, kind = map(list, zip(*cells)) if cells else ([], [], [])
            yield {"cell": logit, "y": y, "kind": kind, "n": list(cells.values())}

    # at most 60 * CELLS cells for each label and kind
    rows = mapped(t.select("h", "text"), run, "cell long, y double, kind string, n long").groupBy("cell", "y", "kind").agg(F.sum("n").alias("n")).sort("kind", "y", "cell").collect()
    return tuple(np.array([r[i] for r in rows]) for i in (0, 1, 2, 3))


def fitted(docs: DataFrame, sample_docs: int, recall: float, seed: int, sample_rows: int = 40_000) -> SecretModel | None:
    """The network of a bounded sample of labelled findings, calibrated on the findings of all documents held out.

    Three tenths of the documents (by hash) are held out, unless that leaves no base findings to
    train on or no findings to calibrate with; then all documents serve.  None without base findings.
    """
    t = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").withColumn("h", F.xxhash64("text"))
    late, early = (f"pmod(xxhash64(h, {int(seed)}), 10) {sign} 3" for sign in ("<", ">="))
    x, y = training_rows(t, sample_docs, sample_rows, seed, early)
    if len(set(y)) < 2:
        return None
    net = CharNet(seed)
    net.train(x, y, TRAIN_STEPS, seed)
    cell, y, kinds, n = held_counts(t.where(late), net, seed)
    if any(not ((y == 1) & (kinds == kind)).any() for kind in VALUE_KINDS) or len(set(y)) < 2:
        cell, y, kinds, n = held_counts(t, net, seed)
    logit, n = cell / CELLS, n.astype(np.float64)
    slope, offset = calibrated(logit, y, n)
    model = SecretModel(net, slope, offset, {})
    score = 1 / (1 + np.exp(-np.clip(slope * (logit - 0.5 / CELLS) + offset, -30, 30)))  # a cell's lower end
    for kind in VALUE_KINDS:
        good = (y == 1) & (kinds == kind)
        order = np.argsort(score[good])
        upto = np.cumsum(n[good][order])
        needed = float(score[good][order][np.searchsorted(upto, (1 - recall) * upto[-1], "right")])
        bad = (y == 0) & (kinds == kind)
        order = np.argsort(-score[bad])
        above = np.searchsorted(np.cumsum(n[bad][order]), FALSE_ALARMS * n[bad].sum(), "right")
        quiet = np.nextafter(score[bad][order][above], 1) if above < len(order) else 0.5
        model.thresholds[kind] = min(needed, float(quiet))
    return model


def secret_scan(docs: DataFrame, sample_docs: int = 4000, recall: float = 0.98, seed: int = 11, model: SecretModel | None = None) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, base, score), by start, then kind."""
    names = carried(docs, ["spans"])
    docs = docs.select(*names)
    model = model or fitted(docs, sample_docs, recall, seed)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    types = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        net = held.value
        for part in sliced(batch, text="text"):
            texts = part.column("text").to_pylist()
            base = [base_spans(t) if t else [] for t in texts]
            more = [further_candidates(t, b) if t and net else [] for t, b in zip(texts, base)]
            every = [[(s, e) for _, s, e in b] + m for b, m in zip(base, more)]
            score = iter(())
            if net and any(every):
                parts, first = [], 0
                for t, e in zip(texts, every):
                    if e:
                        x, of = windows(t, e)
                        parts.append((x, of + first))
                        first += len(e)
                score = iter(net.scores(*(np.concatenate(p) for p in zip(*parts))).tolist())
            out = []
            for t, b, m in zip(texts, base, more):
                spans = [{"kind": KINDS[k], "start": s, "end": e, "base": True, "score": next(score, None)} for k, s, e in b]
                for s, e in m:
                    p = next(score)
                    if p >= net.thresholds[kind_of(t[s:e])]:
                        spans.append({"kind": "net", "start": s, "end": e, "base": False, "score": p})
                out.append(sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield {**{c: part.column(c) for c in names}, "spans": out}

    return mapped(docs, run, ", ".join(f"`{c}` {types[c]}" for c in names)
                  + ", spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")


def redacted(scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``scanned`` with every span of its text replaced by ``mark`` (overlapping spans by one), without ``spans``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done, s):
        piece = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"]), F.lit(mark))
        return F.struct(F.when(s["start"] >= done["at"], piece).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    whole = F.aggregate("spans", start, step, lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    return scanned.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text"))).drop("spans")
