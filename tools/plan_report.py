"""Summarise the physical plan of every registered query into PLANS.md.

    python -m tools.plan_report [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import re
import sys


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def summary(p: str) -> dict:
    tree = p.split("\n\n", 1)[0]
    count = lambda pat: len(re.findall(pat, tree))
    scans = re.findall(r"Location: InMemoryFileIndex \[([^\]]*)\]\n(?:.*\n)*?ReadSchema: (struct<[^\n]*>)", p)
    tables = []
    for loc, schema in scans:
        name = loc.rstrip("/").split("/")[-1].split(",")[0]
        cols = re.findall(r"(\w+):", schema)
        tables.append(f"{name}({len(cols)})")
    return {
        "shuffles": len(re.findall(r"(?<!Broadcast)Exchange \(\d+\)", tree)),
        "broadcasts": count(r"BroadcastExchange"),
        "smj": count(r"SortMergeJoin"), "bhj": count(r"BroadcastHashJoin"),
        "partial_agg": len(re.findall(r"Functions \[\d+\]: \[partial_", p)),
        "group_limit": count(r"WindowGroupLimit"), "python": count(r"MapInPandas"),
        "scans": ", ".join(sorted(set(tables))),
    }


def main(argv: list[str]) -> None:
    sys.path.insert(0, ".")
    from rentlens.plans.catalog import QUERIES
    from rentlens.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    spark = build_session(master="local[8]", extra={"spark.sql.shuffle.partitions": "16"})
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `python -m tools.plan_report {sf_dir}` (local[8], AQE on; plans before AQE "
          "re-optimisation). `shuffles` counts Exchange nodes other than broadcasts; `partial` counts "
          "hash aggregates with partial (map-side) functions; `limit` counts WindowGroupLimit nodes; `scans` lists "
          "each parquet scan with the number of columns it reads.\n")
    print("| query | shuffles | broadcasts | SMJ | BHJ | partial | limit | python | scans |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in sorted(QUERIES.items()):
        s = summary(formatted(fn(spark, sf_dir)))
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['smj']} | {s['bhj']} | {s['partial_agg']} | "
              f"{s['group_limit']} | {s['python']} | {s['scans']} |")
    print(NOTES)


NOTES = """
## Reading the table at 100 TB

* **Listing queries** derive the listings from `orders ⋈ customer ⋈ nation` in the query itself:
  each reads the few columns it needs and pushes `IsNotNull` into the scans (`tests/test_plans.py`).
  A pipeline that uses them often writes them once with `sources.tables.land(df, path)`.
* **Dimensions** (customer, nation, geocode) carry no hint: Catalyst's byte threshold and AQE choose
  broadcast or shuffle.  Beyond the threshold the plan is a sort-merge join, and AQE splits a hot
  customer (`tests/test_skew.py` forces this and checks `skew=true`).
* **Facility distances** are equi-joins of distinct points and facilities on sphere cells.
* **Aggregates** (`partial` > 0) combine map-side before their one shuffle; no query collects a
  group.  `bargain_topk` has `WindowGroupLimit` twice: partial before the exchange, final after.
* **python** = 1 only for the three HTML queries (one `MapInPandas` each); everything else stays in
  JVM codegen.  `html_extract_listings` adds the exchange of the fixture's renderer.
* Queries that write and read back (CSV, dated partitions, model store, run log, streams) show the
  plan of the read-back table.
"""


if __name__ == "__main__":
    main(sys.argv[1:])
