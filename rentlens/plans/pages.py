"""Fixture: result pages rendered from derived listings, for the extraction queries to read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def html_escape(c):
    """Escape text for HTML element content / attribute values."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _el(tag: str, cls: str | None, value) -> F.Column:
    """Element with escaped text, or '' when the value is null (element missing)."""
    open_tag = f'<{tag} class="{cls}">' if cls else f"<{tag}>"
    return F.when(value.isNull(), F.lit("")).otherwise(
        F.concat(F.lit(open_tag), html_escape(value), F.lit(f"</{tag}>")))


def render_listing_pages(raw: DataFrame, per_page: int = 20) -> DataFrame:
    """Render raw listings as result pages, ``per_page`` containers each.

    Pages are formed by ``listing_id div per_page``; with a unique key no
    page holds more than ``per_page`` containers, so each group is bounded.
    Every container also carries a decoy span whose class only partly
    matches, an unclosed <p>, an entity and a second <tbody>.
    """
    c = F.col
    container = F.concat(
        F.lit('<div class="cassetteitem" data-id="'), c("listing_id").cast("string"), F.lit('">'),
        F.lit('<div class="cassetteitem_content">'),
        _el("div", "cassetteitem_content-title", c("name_place")),
        F.lit('<ul class="cassetteitem_detail"><li class="cassetteitem_detail-col1">'),
        F.coalesce(html_escape(c("address")), F.lit("")), F.lit("</li>"),
        F.lit('<li class="cassetteitem_detail-col2">'), _el("div", "cassetteitem_detail-text", c("nearest_eki")),
        F.lit("</li>"),
        F.lit('<li class="cassetteitem_detail-col3">'), _el("div", None, c("year_built")),
        _el("div", None, c("floor")), F.lit("</li></ul>"),
        _el("span", "ui-pct ui-pct--util1", c("house_type")),
        F.lit("<p>note &amp; more</div>"),
        F.lit('<span class="cassetteitem_price cassetteitem_price--gratuity cassetteitem_price--x">decoy</span>'),
        F.lit("<table><tbody><tr><td><ul><li>"),
        _el("span", "cassetteitem_price cassetteitem_price--rent", c("rent_price")), F.lit("</li></ul><ul><li>"),
        _el("span", "cassetteitem_price cassetteitem_price--administration", c("maintenence_price")),
        F.lit("</li></ul></td><td><ul><li>"),
        _el("span", "cassetteitem_price cassetteitem_price--deposit", c("shikikin")),
        _el("span", "cassetteitem_price cassetteitem_price--gratuity", c("rei_price")),
        F.lit("</li></ul></td><td><ul><li>"),
        _el("span", "cassetteitem_madori", c("apartment_type")),
        _el("span", "cassetteitem_menseki", c("sqr_m")),
        F.lit("</li></ul></td></tr></tbody><tbody><tr><td><ul><li><span>second body</span>"
              "</li></ul></td></tr></tbody></table></div>"),
    )
    # the rows are dealt to their pages before they are rendered, as text they are many times larger; the number is
    # fixed, as partitions joined by their few bytes would leave few tasks for the rendering and what reads the pages
    page = F.floor(c("listing_id") / per_page).cast("long").alias("page_id")
    dealt = raw.select("*", page).repartition(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")
    return (dealt.select("page_id", c("listing_id"), container.alias("container"))
               .groupBy("page_id")
               .agg(F.array_sort(F.collect_list(F.struct("listing_id", "container"))).alias("items"))
               .select("page_id", F.concat(
                   F.lit("<!DOCTYPE html><html><head><title>results</title></head><body>"
                         '<div class="designateline-box-txt02">東京都</div>'),
                   F.array_join(F.transform("items", lambda x: x["container"]), ""),
                   F.lit("</body></html>")).alias("html")))
