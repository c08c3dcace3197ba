"""Physical-plan properties of every registered query (at sf0.001).

No cartesian product or nested-loop join, no row-at-a-time Python UDF
anywhere; the flagship's per-ward top-k is limited before its shuffle;
listing scans read only the columns they need.
"""

import contextlib
import io
import re

import pytest

from pyspark.sql.readwriter import DataFrameWriter

from rentlens.plans.catalog import QUERIES
from tests.conftest import SF_SMALL

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
PYTHON_ALLOWED = {"html_find_all", "html_find_first", "html_extract_listings"}


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    """Plan of each query's result, and of every frame that it writes on the way."""
    out: dict[str, list[str]] = {}
    written: list[str] = []
    sinks = {}

    def noted(f):
        def write(self, *args, **kw):
            written.append(plan(self._df))
            return f(self, *args, **kw)
        return write

    for name in ("parquet", "csv", "json", "save"):
        sinks[name] = getattr(DataFrameWriter, name)
        setattr(DataFrameWriter, name, noted(sinks[name]))
    try:
        for n, fn in QUERIES.items():
            written.clear()
            out[n] = [plan(fn(spark, SF_SMALL)), *written]
    finally:
        for name, f in sinks.items():
            setattr(DataFrameWriter, name, f)
    assert sum(len(p) > 1 for p in out.values()) >= 5
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_or_row_udf(plans, name):
    for p in plans[name]:
        for bad in FORBIDDEN:
            assert bad not in p, f"{name}: {bad}"
        if name not in PYTHON_ALLOWED:
            assert "MapInPandas" not in p and "ArrowEvalPython" not in p, name


def test_flagship_limits_before_shuffle(plans):
    p = plans["bargain_topk"][0]
    head = p.split("\n\n")[0]
    lines = head.splitlines()
    partial = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line]
    exch = [i for i, line in enumerate(lines) if "Exchange" in line and "Broadcast" not in line]
    assert len(partial) == 2 and exch and partial[0] < exch[0] < partial[1]
    args = re.findall(r"\(\d+\) WindowGroupLimit\nInput[^\n]*\nArguments: ([^\n]*)", p)
    assert len(args) == 2 and args[0].endswith("Partial") and args[1].endswith("Final"), args


def test_derivation_prunes_and_pushes_down(spark):
    from rentlens.operators.clean import clean_listings
    from rentlens.operators.value import ward_value_summary
    from rentlens.sources.tables import raw_listings
    p = plan(ward_value_summary(clean_listings(raw_listings(spark, SF_SMALL))))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", p)
    orders = [s for s in schemas if "o_orderkey" in s]
    assert orders and all("o_totalprice" not in s and "o_orderstatus" not in s for s in orders)
    assert "PushedFilters: [IsNotNull(o_custkey)]" in plan(clean_listings(raw_listings(spark, SF_SMALL)))
