"""R5 with learned bins and limit, against a plain version."""

import math
import random
import statistics
from collections import Counter, defaultdict

from rentlens.operators.drift import js_drift_calibrated, reference_edges

END = "2024-01-11"


def rows(seed=5):
    rng, out = random.Random(seed), []
    for day in range(1, 21):
        for _ in range(400 if day != 7 else 40):
            x = rng.gauss(2.0 if day == 15 else 0.0, 1.0)
            out.append((f"2024-01-{day:02d} 10:00:00", None if rng.random() < (0.5 if day == 18 else 0.02) else round(x, 2)))
    return out


def distance(p, q):
    n, m = sum(p.values()), sum(q.values())
    total = 0.0
    for k in set(p) | set(q):
        a, b = p[k] / n, q[k] / m
        total += sum(0.5 * z * math.log2(z / ((a + b) / 2)) for z in (a, b) if z > 0)
    return math.sqrt(max(total, 0))


def test_equals_a_plain_version(spark):
    data = rows()
    df = spark.createDataFrame(data, "ts string, x double").selectExpr("cast(ts as timestamp_ntz) AS ts", "x")
    known = sorted(x for t, x in data if t < END and x is not None)
    edges = sorted({known[max(1, len(known) - math.floor(len(known) - k / 10 * len(known))) - 1] for k in range(1, 10)})
    assert reference_edges(df, "ts", "x", END) == edges
    days = defaultdict(Counter)
    for t, x in data:
        days[t[:10]][None if x is None else sum(e <= x for e in edges)] += 1
    reference = sum((c for d, c in days.items() if d < END), Counter())
    own = [distance(c, reference - c) for d, c in days.items() if d < END]
    limit = statistics.mean(own) + 3 * statistics.stdev(own)
    got = {r.chunk: r for r in js_drift_calibrated(df, "ts", "x", END).collect()}
    assert set(got) == {d for d in days if d >= END}
    for d, r in got.items():
        want = distance(days[d], reference)
        assert abs(r.js_distance - want) < 1e-9 and abs(r.alert_limit - limit) < 1e-9 and r.alert == (want > limit)
    assert {d for d, r in got.items() if r.alert} >= {"2024-01-15", "2024-01-18"}
    fixed = js_drift_calibrated(df, "ts", "x", END, edges=[0.0], alert_above=0.9)
    assert fixed.where("alert_limit = 0.9 and not alert").count() == 10


def test_little_or_no_reference(spark):
    df = spark.createDataFrame([("2024-01-10", 1.0), ("2024-01-12", 1.0), ("2024-01-12", float("nan")), (None, 1.0)], "ts string, x double").selectExpr("cast(ts as timestamp_ntz) AS ts", "x")
    one = js_drift_calibrated(df, "ts", "x", END).collect()
    assert [(r.chunk, r.n, r.alert_limit, r.alert) for r in one] == [("2024-01-12", 2, None, None)] and one[0].js_distance > 0
    none = js_drift_calibrated(df, "ts", "x", "2024-01-01").collect()
    assert {r.chunk for r in none} == {"2024-01-10", "2024-01-12"} and all(r.js_distance is None for r in none)
    assert js_drift_calibrated(df.where("false"), "ts", "x", END).count() == 0
