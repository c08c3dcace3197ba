"""Parsers for listing-site text: price, area, age, storeys, walk, ward.

All are native column expressions.  Literal splitting uses ``split_part``
and literal replacement uses ``replace``, so listing text is never read as
a regex.  ``mode='fail'`` casts with the session's ANSI semantics (a bad
value aborts the job, as the original scripts do); ``mode='permissive'``
uses ``try_cast`` so that a bad value becomes null and can be routed to a
rejects table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers in the listing text.
MAN_YEN = "万円"      # 10,000 yen
YEN = "円"
AREA_UNIT = "m"      # area text reads like 25.51m2
NEW_BUILD = "新築"   # newly built → age 0
AGE_PREFIX = "築"
YEAR = "年"
ABOVE_GROUND = "地上"
STOREY = "階"
WALK = "歩"
MINUTE = "分"
STATION = "駅"
TOKYO = "東京都"
WARD = "区"
NEWLINE = "\n"
MISSING = ("-", "nan")

MODES = ("fail", "permissive")


def _lit(s: str) -> Column:
    return F.lit(s)


def _to(c: Column, dtype: str, mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    return c.try_cast(dtype) if mode == "permissive" else c.cast(dtype)


def _part(c: Column, delim: str, n: int) -> Column:
    """n-th (1-based) part of ``c`` split on the literal ``delim``; '' when absent."""
    return F.split_part(c, _lit(delim), F.lit(n))


def strip_newlines(c: Column) -> Column:
    """Remove LF characters (CR is kept, as in the source)."""
    return F.replace(c, _lit(NEWLINE), _lit(""))


def parse_area(c: Column, mode: str = "fail") -> Column:
    """Text before the first 'm' as double (``25.51m2`` → 25.51)."""
    return _to(_part(c, AREA_UNIT, 1), "double", mode)


def _strip_money(c: Column) -> Column:
    return F.replace(F.replace(c, _lit(MAN_YEN), _lit("")), _lit(YEN), _lit(""))


def parse_money(c: Column, mode: str = "fail") -> Column:
    """Money as listed; '-' and null → 0.0, else strip 万円 then 円."""
    return (F.when(c.isNull() | (c == "-"), F.lit(0.0))
             .otherwise(_to(_strip_money(c), "double", mode)))


def parse_rent(c: Column, mode: str = "fail") -> Column:
    """C2 for the rent: a missing rent stays null (only fees and deposits default to 0.0)."""
    return _to(_strip_money(c), "double", mode)


def parse_fee_yen(c: Column, mode: str = "fail") -> Column:
    """Text before 円 as double (``9000円`` → 9000.0)."""
    return _to(_part(c, YEN, 1), "double", mode)


def parse_money_to_yen(c: Column, mode: str = "fail") -> Column:
    """C4: money normalised to whole yen; 万円 amounts are multiplied by 10,000."""
    num = _to(_strip_money(c), "double", mode)
    yen = F.when(c.endswith(MAN_YEN), num * F.lit(10000.0)).otherwise(num)
    return F.when(c.isNull() | (c == "-"), F.lit(0.0)).otherwise(F.round(yen, 0))


def parse_building_age(c: Column, mode: str = "fail") -> Column:
    """C5: '-' → 0; text with 新築 → 0 (新築 read as '0'); else drop 年 and 築."""
    new_build = _to(F.replace(c, _lit(NEW_BUILD), _lit("0")), "int", mode)
    aged = _to(F.replace(F.replace(c, _lit(YEAR), _lit("")), _lit(AGE_PREFIX), _lit("")), "int", mode)
    return (F.when(c == "-", F.lit(0))
             .when(c.contains(NEW_BUILD), new_build)
             .otherwise(aged))


def parse_storeys(c: Column, mode: str = "fail") -> Column:
    """Storeys above ground (``地下1地上13階建`` → 13); blank or null → 0."""
    s = strip_newlines(c)
    text = (F.when(s.contains(ABOVE_GROUND), _part(_part(s, ABOVE_GROUND, 2), STOREY, 1))
             .otherwise(_part(s, STOREY, 1)))
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(_to(text, "int", mode))


def _missing(c: Column) -> Column:
    return c.isNull() | c.isin(*MISSING)


def parse_station_walk(c: Column, mode: str = "fail") -> Column:
    """Minutes on foot, between the first 歩 and the next 分; '-'/'nan'/null → 0."""
    return (F.when(_missing(c), F.lit(0))
             .otherwise(_to(_part(_part(c, WALK, 2), MINUTE, 1), "int", mode)))


def parse_station_text(c: Column) -> Column:
    """Text before the first 歩, trailing space kept; '-'/'nan'/null → '0'."""
    return F.when(_missing(c), _lit("0")).otherwise(_part(c, WALK, 1))


def parse_station_name(c: Column) -> Column:
    """Text before 駅 (``線/木場駅 歩6分`` → ``線/木場``)."""
    return _part(c, STATION, 1)


def split_line_station(c: Column) -> tuple[Column, Column]:
    """(line, station) from the text before 駅, split on '/'."""
    name = parse_station_name(c)
    return _part(name, "/", 1), F.when(name.contains("/"), _part(name, "/", 2))


def parse_ward(c: Column) -> Column:
    """Text after 東京都 and before 区; null when 東京都 is absent."""
    return F.when(c.contains(TOKYO), _part(_part(c, TOKYO, 2), WARD, 1))


def text_slice_from(c: Column, start: int) -> Column:
    """Python-style ``text[start:]`` (0-based start)."""
    return F.substr(c, F.lit(start + 1))
