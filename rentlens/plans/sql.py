"""SQL building blocks for the oracles, runnable by DuckDB over the
driver tables.  The clean step is re-expressed here in plain SQL (not
generated from the Spark code) so the check is independent; only the
listing recipe text is shared, since it is test-data derivation.
"""

from __future__ import annotations

from rentlens.sources.tables import ODD_COLUMNS, listing_select_sql

NL = "chr(10)"


def _s(c: str) -> str:
    return f"replace({c}, {NL}, '')"


def _money(c: str) -> str:
    s = _s(c)
    return (f"CASE WHEN {s} IS NULL OR {s} = '-' THEN 0.0 "
            f"ELSE CAST(replace(replace({s}, '万円', ''), '円', '') AS DOUBLE) END")


def _rent(c: str) -> str:
    return f"CAST(replace(replace({_s(c)}, '万円', ''), '円', '') AS DOUBLE)"


RAW_CTE = (
    "raw_listings AS (SELECT " + listing_select_sql() +
    " FROM (SELECT o_orderkey AS k, o_custkey, o_orderdate FROM orders) o"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
)

_FLOOR_TEXT = (f"CASE WHEN strpos({_s('floor')}, '地上') > 0 "
               f"THEN split_part(split_part({_s('floor')}, '地上', 2), '階', 1) "
               f"ELSE split_part({_s('floor')}, '階', 1) END")
_EKI = _s("nearest_eki")

CLEAN_CTE = f"""clean_listings AS (SELECT listing_id, scraped_at,
 {_rent('rent_price')} AS rent_price,
 {_s('address')} AS address,
 CAST(split_part({_s('sqr_m')}, 'm', 1) AS DOUBLE) AS sqr_m,
 {_s('name_place')} AS name_place,
 {_money('rei_price')} AS rei_price,
 {_money('shikikin')} AS shikikin,
 {_money('maintenence_price')} AS maintenence_price,
 {_s('apartment_type')} AS apartment_type,
 CASE WHEN {_s('year_built')} = '-' THEN 0
      WHEN strpos({_s('year_built')}, '新築') > 0 THEN CAST(replace({_s('year_built')}, '新築', '0') AS INTEGER)
      ELSE CAST(replace(replace({_s('year_built')}, '年', ''), '築', '') AS INTEGER) END AS year_built,
 CASE WHEN strpos({_s('ku_name')}, '東京都') > 0
      THEN split_part(split_part({_s('ku_name')}, '東京都', 2), '区', 1) END AS ku_name,
 CASE WHEN ({_FLOOR_TEXT}) IS NULL OR ({_FLOOR_TEXT}) = '' THEN 0
      ELSE CAST({_FLOOR_TEXT} AS INTEGER) END AS floor,
 {_s('house_type')} AS house_type,
 CASE WHEN {_EKI} IS NULL OR {_EKI} IN ('-', 'nan') THEN 0
      ELSE CAST(split_part(split_part({_EKI}, '歩', 2), '分', 1) AS INTEGER) END AS eki_walk,
 CASE WHEN {_EKI} IS NULL OR {_EKI} IN ('-', 'nan') THEN '0'
      ELSE split_part({_EKI}, '歩', 1) END AS eki_name
 FROM raw_listings WHERE sqr_m IS NOT NULL)"""


def with_listings(body: str, ctes: str = "") -> str:
    """Prefix ``body`` with the raw and clean listing CTEs (plus extra CTEs)."""
    extra = f",\n{ctes}" if ctes else ""
    return f"WITH {RAW_CTE},\n{CLEAN_CTE}{extra}\n{body}"


ODD_CTE = "odd_listings AS (SELECT " + ", ".join(ODD_COLUMNS).replace("STRING", "VARCHAR") + " FROM raw_listings)"

FIT_ALL = ("fit AS (SELECT regr_slope(rent_price, sqr_m) AS slope, "
           "regr_intercept(rent_price, sqr_m) AS intercept FROM clean_listings)")


def residualised(source: str, keep: list[str], xs: list[str], y: str, fit_where: str, name: str = "scored") -> str:
    """CTEs that give ``name``: rows of ``source`` with ``predicted`` and ``residual`` of least squares of y on xs.

    Each regressor in turn is taken out of the later ones and of y by simple
    regressions on the rows of ``fit_where``; what is taken out of y adds up to
    the multiple regression's prediction.
    """
    cols = [f"x{i}" for i in range(len(xs))]
    kept = ", ".join(keep)
    out = [f"{name}0 AS MATERIALIZED (SELECT {kept}, CAST({y} AS DOUBLE) AS y, CAST({y} AS DOUBLE) AS r, CAST(0 AS DOUBLE) AS p, "
           + ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for x, c in zip(xs, cols))
           + f", ({fit_where}) AND {y} IS NOT NULL AS used FROM {source})"]
    for k, z in enumerate(cols):
        rest = cols[k + 1:]
        fits = [f"regr_slope({c}, {z}) AS s_{c}, regr_intercept({c}, {z}) AS i_{c}" for c in [*rest, "r"]]
        out.append(f"{name}_fit{k} AS MATERIALIZED (SELECT {', '.join(fits)}, regr_sxx(r, {z}) AS sxx FROM {name}{k} WHERE used)")
        take = [f"{c} - (i_{c} + s_{c} * {z}) AS {c}" for c in [*rest, "r"]]
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {kept}, y, used, p + (i_r + s_r * {z}) AS p, {', '.join(take)} "
                   f"FROM {name}{k} CROSS JOIN {name}_fit{k})")
    out.append(f"{name} AS (SELECT {kept}, p AS predicted, y - p AS residual, used FROM {name}{len(cols)})")
    return ",\n".join(out)


def summary_sql(source: str, xs: dict[str, str], y: str) -> tuple[str, str]:
    """(CTEs, SELECT) of term, coef, std_err, n, r2 for all regressors (name → column) from one chain.

    The chain's slopes are the unit upper triangular matrix of the regressors on
    the cleared ones; its inverse, row by row from the last, gives the
    coefficients and, with the cleared sums of squares, their variances.
    """
    names, p = list(xs), len(xs)
    chain = residualised(source, ["id"], list(xs.values()), y, "true", "w")
    rows = []
    for k in range(p - 1, -1, -1):  # u{k}_{j}: row k of the inverse
        below = "".join(f", u{m}_{j}" for m in range(k + 1, p) for j in range(m, p))
        row = ["1.0 AS u%d_%d" % (k, k)] + [
            "-(" + " + ".join(f"f.s_x{m} * u{m}_{j}" for m in range(k + 1, j + 1)) + f") AS u{k}_{j}" for j in range(k + 1, p)]
        keep = "".join(f", c{j}, d{j}" for j in range(k + 1, p))
        origin = f" CROSS JOIN inverse{k + 1}" if k < p - 1 else ""
        rows.append(f"inverse{k} AS MATERIALIZED (SELECT f.s_r AS c{k}, f.sxx AS d{k}, {', '.join(row)}{keep}{below} FROM w_fit{k} f{origin})")
    whole = (f"whole AS MATERIALIZED (SELECT count(*) AS n, sum(residual * residual) AS rss, "
             f"(SELECT regr_syy({y}, {y}) FROM {source}) AS tss FROM w)")
    coef = lambda k: " + ".join(f"u{k}_{j} * c{j}" for j in range(k, p))
    var = lambda k: " + ".join(f"u{k}_{j} * u{k}_{j} / d{j}" for j in range(k, p))
    selects = [f"SELECT '{name}' AS term, {coef(k)} AS coef, sqrt(rss / (n - {p + 1}) * ({var(k)})) AS std_err, n, 1 - rss / tss AS r2 "
               "FROM inverse0 CROSS JOIN whole" for k, name in enumerate(names)]
    return ",\n".join([chain, *rows, whole]), "\nUNION ALL\n".join(selects)


def coefficient_sql(source: str, xs: list[str], y: str, fit_where: str) -> tuple[str, str]:
    """(CTEs, SELECT) of term, coef, std_err, t_value: each regressor is put last in a chain of its own."""
    ctes, selects = [], []
    p = len(xs)
    for j, x in enumerate(xs):
        order = [c for c in xs if c != x] + [x]
        # the last regressor, cleared of the others, against y cleared of the others
        chain = residualised(source, ["listing_id"], order, y, fit_where, f"k{j}_")
        ctes.append(chain)
        last = f"k{j}_{p - 1}"
        selects.append(
            f"SELECT '{x}' AS term, b AS coef, sqrt((syy - b * b * sxx) / (n - {p + 1}) / sxx) AS std_err, m AS mean_x, n "
            f"FROM (SELECT regr_slope(r, x{p - 1}) AS b, regr_sxx(r, x{p - 1}) AS sxx, regr_syy(r, x{p - 1}) AS syy, "
            f"regr_count(r, x{p - 1}) AS n, (SELECT avg({x}) FROM {source} WHERE ({fit_where}) AND {y} IS NOT NULL) AS m FROM {last} WHERE used)")
    return ",\n".join(ctes), "\nUNION ALL\n".join(selects)
