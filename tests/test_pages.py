"""Rendering and reading of listing pages: few bytes cross the shuffle, the text is dealt over many tasks, tags are matched once."""

from rentlens.functions import html as H
from rentlens.operators.extract import CONTAINER, DETAIL, LISTING_SELECTORS, PAGE_WARD
from rentlens.plans.pages import render_listing_pages
from rentlens.schema import RAW_COLUMNS


def test_rows_are_dealt_before_they_are_rendered(spark):
    raw = spark.range(100).selectExpr("id AS listing_id", *[f"'{c}' AS {c}" for c in RAW_COLUMNS])
    pages = render_listing_pages(raw, per_page=20)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a partition a number even for few rows: neither joined by size nor dealt again as text
    assert {r[0]: r[1].count('class="cassetteitem"') for r in pages.collect()} == dict.fromkeys(range(5), 20)
    assert pages.rdd.getNumPartitions() == n
    plan = pages._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)


def test_attributes_are_read_only_where_a_class_is_asked_for(monkeypatch):
    """Each selector's attempt used to go through every field of every open container."""
    calls = []
    read = H.attributes
    monkeypatch.setattr(H, "attributes", lambda text: calls.append(text) or read(text))
    H._short_matches.cache_clear()
    item = '<div class="cassetteitem" data-id="{}"><ul><li class="cassetteitem_detail-col3"><div>1</div><div>2</div></li></ul><span class="cassetteitem_madori">x</span></div>'
    paths = {**LISTING_SELECTORS, "year_built": [DETAIL, ("div", None)], "floor": [DETAIL, ("div", None), ("+div", None)]}
    found, _ = H.read_containers("<div class='designateline-box-txt02'>w</div>" + "".join(item.format(i) for i in range(50)), CONTAINER, paths, {"ward": PAGE_WARD})
    assert [c.attrs["data-id"] for c in found] == [str(i) for i in range(50)]
    assert {(f["year_built"], f["floor"], f["apartment_type"], f["rent_price"]) for f in map(H.field_texts, found)} == {("1", "2", "x", None)}
    assert len(calls) < 3 * 50
