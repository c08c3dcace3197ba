"""Extraction from HTML documents held in a DataFrame column.

Each operator is one ``mapInPandas`` pass; a document is parsed, its rows are
taken and the parse is dropped before the next one, so a worker holds one page
and at most ``CHUNK`` result rows.  Partitions of the page table are processed
independently, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rentlens.functions.html import field_texts, parse_html, path_text, read_containers
from rentlens.schema import RAW_COLUMNS


#: Result rows handed on at a time.
CHUNK = 2000


def _in_chunks(rows: Iterator[list], names: list[str]) -> Iterator[pd.DataFrame]:
    held: list[list] = []
    for row in rows:
        held.append(row)
        if len(held) == CHUNK:
            yield pd.DataFrame(held, columns=names)
            held = []
    yield pd.DataFrame(held, columns=names)


def _keep_fields(df: DataFrame, keep: list[str]) -> list[T.StructField]:
    return [df.schema[c] for c in keep]


def html_find_all(df: DataFrame, html_col: str, tag: str, cls: str | None = None,
                  attrs: tuple[str, ...] = (), keep: list[str] | None = None) -> DataFrame:
    """One row per matching element, in document order (``position`` from 1)."""
    keep = keep or []
    schema = T.StructType(_keep_fields(df, keep) + [T.StructField("position", T.IntegerType())]
                          + [T.StructField(a, T.StringType()) for a in attrs]
                          + [T.StructField("text", T.StringType())])
    names = [f.name for f in schema.fields]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
        for pdf in batches:
            for *kept, html in pdf.itertuples(index=False, name=None):
                for i, n in enumerate(parse_html(html).find_all(tag, cls), start=1):
                    yield [*kept, i, *[n.attrs.get(a) for a in attrs], n.text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_chunks(rows(batches), names)

    return df.select(*keep, html_col).mapInPandas(run, schema)


def html_find_first(df: DataFrame, html_col: str, selectors: dict[str, list[tuple[str, str | None]]],
                    keep: list[str] | None = None) -> DataFrame:
    """Per document, the text of the first element on each selector path (null if absent)."""
    keep = keep or []
    schema = T.StructType(_keep_fields(df, keep) + [T.StructField(n, T.StringType()) for n in selectors])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
        for pdf in batches:
            for *kept, html in pdf.itertuples(index=False, name=None):
                root = parse_html(html)
                yield [*kept, *[path_text(root, path) for path in selectors.values()]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_chunks(rows(batches), schema.names)

    return df.select(*keep, html_col).mapInPandas(run, schema)


# The selectors of one listing container (first match inside
# the container).  Class strings of several tokens must equal the whole attribute.
CONTAINER = ("div", "cassetteitem")
LISTING_SELECTORS: dict[str, list[tuple[str, str | None]]] = {
    "rent_price": [("tbody", None), ("ul", None), ("span", None)],
    "address": [("div", None), ("ul", None), ("li", None)],
    "sqr_m": [("span", "cassetteitem_menseki")],
    "name_place": [("div", "cassetteitem_content-title")],
    "rei_price": [("span", "cassetteitem_price cassetteitem_price--gratuity")],
    "shikikin": [("span", "cassetteitem_price cassetteitem_price--deposit")],
    "maintenence_price": [("span", "cassetteitem_price cassetteitem_price--administration")],
    "nearest_eki": [("div", "cassetteitem_detail-text")],
    "apartment_type": [("span", "cassetteitem_madori")],
    "house_type": [("span", "ui-pct ui-pct--util1")],
}
# The detail cell: its first child element is the age, the second the storeys.
DETAIL = ("li", "cassetteitem_detail-col3")
# Page-level variants: the ward in the page's head, the name in the container's first list item.
PAGE_WARD = [("div", "designateline-box-txt02")]
FIRST_ITEM = [("div", None), ("li", None)]


def extract_listings(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None,
                     id_attr: str | None = "data-id", ward_from: str = "address", name_from: str = "title") -> DataFrame:
    """One raw 13-field listing row per container, in page order.

    The age and storey texts are the first and second element of the detail cell
    (not a fixed-width slice of its text).  ``ward_from`` 'page' takes the ward from
    the page's head instead of the address; ``name_from`` 'item' takes the name from
    the container's first list item.  A missing element gives null.
    """
    if ward_from not in ("address", "page") or name_from not in ("title", "item"):
        raise ValueError("ward_from is 'address' or 'page'; name_from is 'title' or 'item'")
    keep = keep or []
    id_field = [T.StructField("listing_id", T.LongType())] if id_attr else []
    schema = T.StructType(_keep_fields(pages, keep) + id_field + [T.StructField("position", T.IntegerType())]
                          + [T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
    paths = {**LISTING_SELECTORS, "year_built": [DETAIL, ("div", None)], "floor": [DETAIL, ("div", None), ("+div", None)]}
    if name_from == "item":
        paths["name_place"] = FIRST_ITEM

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
        for pdf in batches:
            for *kept, html in pdf.itertuples(index=False, name=None):
                found, head = read_containers(html, CONTAINER, paths, {"ward": PAGE_WARD})
                for i, c in enumerate(found, start=1):
                    f = field_texts(c)
                    f["ku_name"] = head["ward"] if ward_from == "page" else f["address"]
                    ident = [int(c.attrs[id_attr]) if c.attrs.get(id_attr) else None] if id_attr else []
                    yield [*kept, *ident, i, *[f[k] for k in RAW_COLUMNS]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_chunks(rows(batches), schema.names)

    return pages.select(*keep, html_col).mapInPandas(run, schema)
