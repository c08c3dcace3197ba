"""C11: the listing clean step, one filter plus one projection.

Order of the original: fill the nulls of fees and deposits, drop rows without area, strip LF
from every text column, parse area / money / ward / age / storeys, drop the
coordinates if present, split the station text into walk minutes and name.
Catalyst collapses it into a single stage with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.functions import parse as P
from rentlens.schema import CLEAN_COLUMNS, RAW_COLUMNS

MONEY = ["rei_price", "shikikin", "maintenence_price"]  # '-' and null mean none
DROP_IF_PRESENT = ["Lon", "Lat"]


def _stripped(df: DataFrame) -> dict[str, Column]:
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out[f.name] = P.strip_newlines(c) if isinstance(f.dataType, T.StringType) else c
    return out


def _parsed(s: dict[str, Column], mode: str) -> dict[str, Column]:
    exprs = {c: s[c] for c in ("address", "name_place", "apartment_type", "house_type") if c in s}
    exprs["rent_price"] = P.parse_rent(s["rent_price"], mode)
    for m in MONEY:
        exprs[m] = P.parse_money(s[m], mode)
    exprs["sqr_m"] = P.parse_area(s["sqr_m"], mode)
    exprs["ku_name"] = P.parse_ward(s["ku_name"])
    exprs["year_built"] = P.parse_building_age(s["year_built"], mode)
    exprs["floor"] = P.parse_storeys(s["floor"], mode)
    exprs["eki_walk"] = P.parse_station_walk(s["nearest_eki"], mode)
    exprs["eki_name"] = P.parse_station_text(s["nearest_eki"])
    return exprs


def clean_listings(df: DataFrame, mode: str = "fail") -> DataFrame:
    """Raw text listings → typed listings (clean schema, extra columns kept in front)."""
    s = _stripped(df)
    exprs = _parsed(s, mode)
    passthrough = [c for c in df.columns if c not in RAW_COLUMNS and c not in DROP_IF_PRESENT]
    cols = [s[c].alias(c) for c in passthrough]
    cols += [exprs[c].alias(c) for c in CLEAN_COLUMNS if c in exprs]
    return df.where(F.col("sqr_m").isNotNull()).select(*cols)


#: Cleaned column -> raw column whose text it is parsed from.
SOURCES = {"sqr_m": "sqr_m", "year_built": "year_built", "floor": "floor", "eki_walk": "nearest_eki",
           **{m: m for m in ["rent_price", *MONEY]}}


def judged_listings(df: DataFrame) -> DataFrame:
    """Permissive clean of every row plus ``rejected``: names of the fields whose text did not parse, and ``sqr_m`` where there is none."""
    s = _stripped(df)
    exprs = _parsed(s, "permissive")
    flags = [F.when(exprs[c].isNull() & (s[src].isNotNull() | F.lit(c == "sqr_m")), F.lit(c)) for c, src in SOURCES.items()]
    rejected = F.filter(F.array(*flags), lambda x: x.isNotNull())
    passthrough = [c for c in df.columns if c not in RAW_COLUMNS and c not in DROP_IF_PRESENT]
    cols = [s[c].alias(c) for c in passthrough]
    cols += [exprs[c].alias(c) for c in CLEAN_COLUMNS if c in exprs]
    return df.select(*cols, rejected.alias("rejected"))


def clean_with_rejects(df: DataFrame) -> DataFrame:
    """Permissive clean plus ``rejected`` = names of fields whose text did not parse.

    Split downstream with ``where(size('rejected') == 0)``; both halves come
    from one scan.
    """
    return judged_listings(df.where(F.col("sqr_m").isNotNull()))
