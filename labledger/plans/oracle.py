"""DuckDB SQL for each registered key (same column names as the Spark result)."""

from __future__ import annotations

from labledger.sources.fixtures import ORDER_LINES_SQL

ORACLE: dict[str, str] = {}


def W(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH order_lines AS ({ORDER_LINES_SQL}){extra}\n{body}"


def sql(key: str, body: str, *ctes: str) -> None:
    ORACLE[key] = W(body, *ctes)


PENDING = "date_received IS NULL"
DSUM = "CAST(sum(coalesce(total, 0)) AS DOUBLE)"

sql("pending_orders", f"SELECT req_id, item, date_ordered FROM order_lines WHERE {PENDING}")
sql("received_orders", f"SELECT req_id, item, date_received FROM order_lines WHERE NOT ({PENDING})")
sql("visible_rows", "SELECT req_id, lab, CAST(total AS DECIMAL(18,2)) AS total FROM order_lines WHERE lab = 'AMERICA'")
sql("order_search", f"""SELECT req_id, vendor, "grant", po_source FROM order_lines
WHERE coalesce(regexp_matches(vendor, 'supplier#0000000[1-3]', 'i'), false)
  AND coalesce(regexp_matches("grant", 'build', 'i'), false)
  AND coalesce(po_source = 'ShopBlue', false) AND {PENDING}""")
sql("order_search_counts", f"""SELECT CAST(count_if(coalesce(contains(lower(vendor), '0001'), false)
  AND coalesce(po_source = 'Stock Room', false) AND NOT ({PENDING})) AS BIGINT) AS shown, count(*) AS total FROM order_lines""")
sql("positive_totals", "SELECT count(*) AS rows FROM order_lines WHERE total > 0")
sql("min_support", "SELECT item, vendor, count(*) AS n_rows FROM order_lines GROUP BY item, vendor HAVING count(*) >= 2")
sql("validate_orders", """SELECT reason, count(*) AS rows FROM (SELECT CASE
  WHEN item IS NULL OR trim(item) = '' THEN 'Item name is required'
  WHEN coalesce(qty <= 0, true) THEN 'Quantity must be greater than 0'
  WHEN coalesce(unit_price <= 0, true) THEN 'Price must be greater than 0'
  WHEN vendor IS NULL OR trim(vendor) = '' THEN 'Vendor name is required'
  ELSE 'OK' END AS reason FROM order_lines) GROUP BY reason""")

sql("kpi_overview", f"""SELECT count(*) AS orders, {DSUM} AS spend, CAST(count_if({PENDING}) AS BIGINT) AS pending,
  CAST(count_if(NOT ({PENDING})) AS BIGINT) AS received FROM order_lines""")
sql("kpi_analytics", f"""SELECT count(*) AS orders, {DSUM} AS spend, count(DISTINCT vendor) AS vendors,
  CAST(count_if({PENDING}) AS BIGINT) AS pending FROM order_lines""")
sql("spend_by_grant", f"""SELECT "grant", {DSUM} AS total_spent, count(req_id) AS orders FROM order_lines
WHERE "grant" IS NOT NULL AND "grant" <> '' GROUP BY "grant" ORDER BY total_spent DESC, "grant" """)
sql("assigned_spend_total", f"""SELECT {DSUM} AS assigned_total FROM order_lines WHERE "grant" IS NOT NULL AND "grant" <> '' """)
sql("spend_by_project", f"""SELECT rf_project, "grant", {DSUM} AS total_spent, count(req_id) AS orders FROM order_lines
WHERE rf_project IS NOT NULL AND rf_project <> '' AND "grant" IS NOT NULL
GROUP BY rf_project, "grant" ORDER BY total_spent DESC, rf_project, "grant" """)
sql("split_summary", """SELECT split_orders, total_orders,
  CASE WHEN total_orders > 0 THEN CAST(split_orders AS DOUBLE) / CAST(total_orders AS DOUBLE) * 100 ELSE 0.0 END AS split_share_pct,
  coalesce(split_total, 0.0) AS split_total
FROM (SELECT CAST(count_if(split_pct IS NOT NULL AND split_pct <> '') AS BIGINT) AS split_orders, count(*) AS total_orders,
  CAST(sum(CASE WHEN split_pct IS NOT NULL AND split_pct <> '' THEN coalesce(total, 0) END) AS DOUBLE) AS split_total
  FROM order_lines)""")
sql("top_items", "SELECT item, count(*) AS orders FROM order_lines WHERE item IS NOT NULL GROUP BY item ORDER BY orders DESC, item LIMIT 8")
sql("top_vendors", "SELECT vendor, count(*) AS orders FROM order_lines WHERE vendor IS NOT NULL GROUP BY vendor ORDER BY orders DESC, vendor LIMIT 8")
sql("monthly_spend", """SELECT strftime(date_ordered, '%Y-%m') AS month, CAST(sum(total) AS DOUBLE) AS spend
FROM order_lines WHERE date_ordered IS NOT NULL AND total IS NOT NULL GROUP BY 1""")
sql("grant_spend_all_time", """SELECT "grant", CAST(sum(total) AS DOUBLE) AS spend FROM order_lines
WHERE date_ordered IS NOT NULL AND total IS NOT NULL AND "grant" IS NOT NULL GROUP BY "grant" """)
sql("year_total", f"""SELECT year AS current_year, {DSUM} AS year_total FROM
  (SELECT *, CAST(year(date_ordered) AS INTEGER) AS year FROM order_lines WHERE date_ordered IS NOT NULL)
WHERE year = (SELECT max(CAST(year(date_ordered) AS INTEGER)) FROM order_lines WHERE date_ordered IS NOT NULL) GROUP BY year""")
sql("missing_price_check", f"""SELECT rows, total_sum, (total_sum = 0 AND rows > 0) AS has_price_issue FROM
  (SELECT count(*) AS rows, {DSUM} AS total_sum FROM order_lines)""")
sql("column_profile", """SELECT 'qty' AS column_name, 'double' AS dtype, count(qty) AS non_null, CAST(sum(qty) AS DOUBLE) AS col_sum FROM order_lines
UNION ALL SELECT 'unit_price', 'decimal(18,4)', count(unit_price), CAST(sum(unit_price) AS DOUBLE) FROM order_lines
UNION ALL SELECT 'total', 'decimal(18,2)', count(total), CAST(sum(total) AS DOUBLE) FROM order_lines""")

sql("recent_orders", """SELECT req_id,
  CASE WHEN length(item) > 50 THEN concat(substring(item, 1, 50), '...') ELSE item END AS item,
  vendor, CAST(total AS DOUBLE) AS total,
  CASE WHEN date_received IS NULL THEN 'Pending' ELSE 'Received' END AS status
FROM order_lines ORDER BY date_ordered DESC NULLS LAST, req_id LIMIT 5""")
sql("pending_top5", f"""SELECT h.*, c.pending_total, greatest(c.pending_total - 5, 0) AS more_pending FROM
  (SELECT req_id, substring(item, 1, 40) AS item, date_ordered FROM order_lines WHERE {PENDING} ORDER BY req_id LIMIT 5) h,
  (SELECT count(*) AS pending_total FROM order_lines WHERE {PENDING}) c""")
sql("ranked_reports", f"""SELECT rf_project, "grant", {DSUM} AS total_spent, count(req_id) AS orders FROM order_lines
WHERE rf_project IS NOT NULL AND rf_project <> '' AND "grant" IS NOT NULL
GROUP BY rf_project, "grant" ORDER BY total_spent DESC, rf_project, "grant" LIMIT 5""")

YG = """yg AS (SELECT CAST(year(date_ordered) AS INTEGER) AS year, "grant", sum(coalesce(total, 0)) AS spend_dec FROM order_lines
  WHERE date_ordered IS NOT NULL AND "grant" IS NOT NULL AND "grant" <> '' GROUP BY 1, 2)"""
GRID = """grid AS (SELECT y.year, g."grant", coalesce(yg.spend_dec, 0) AS spend_dec
  FROM (SELECT DISTINCT year FROM yg) y CROSS JOIN (SELECT DISTINCT "grant" FROM yg) g
  LEFT JOIN yg ON yg.year = y.year AND yg."grant" = g."grant")"""
sql("year_grant_grid", "SELECT year, \"grant\", CAST(spend_dec AS DOUBLE) AS spend FROM grid", YG, GRID)
sql("year_grant_pivot", "SELECT year, \"grant\", CAST(spend_dec AS DOUBLE) AS spend FROM grid", YG, GRID)
UNASSIGNED = """unassigned AS (SELECT CAST(year(date_ordered) AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS "grant", sum(coalesce(total, 0)) AS spend_dec
  FROM order_lines WHERE date_ordered IS NOT NULL AND ("grant" IS NULL OR "grant" = '') GROUP BY 1)"""
sql("year_grant_margins", """SELECT year, "grant", GROUPING_ID(year, "grant") AS level, CAST(sum(spend_dec) AS DOUBLE) AS spend
FROM (SELECT * FROM grid UNION ALL SELECT * FROM unassigned) GROUP BY CUBE (year, "grant")""", YG, GRID, UNASSIGNED)
sql("year_ordinal", "SELECT year, CAST(dense_rank() OVER (ORDER BY year) - 1 AS INTEGER) AS year_ordinal FROM (SELECT DISTINCT year FROM yg)", YG)
PROJ = """proj AS (
  SELECT "grant", n AS n_years, last_spend, projected,
    CASE WHEN n >= 2 AND last_spend > 0 THEN (projected - last_spend) / last_spend * 100 ELSE 0.0 END AS growth_pct
  FROM (
    SELECT "grant", n, last_spend,
      CASE WHEN n >= 2 THEN greatest((CAST(sy AS DOUBLE) - slope * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) + slope * CAST(n AS DOUBLE), 0.0)
           ELSE last_spend END AS projected
    FROM (
      SELECT "grant", n, sx, sy, CAST(last_dec AS DOUBLE) AS last_spend,
        CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) AS slope
      FROM (
        SELECT "grant", count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(spend_dec) AS sy,
          sum(CAST(x AS DECIMAL(10,0)) * spend_dec) AS sxy, arg_max(spend_dec, x) AS last_dec
        FROM (SELECT grid.*, o.year_ordinal AS x FROM grid JOIN
              (SELECT year, dense_rank() OVER (ORDER BY year) - 1 AS year_ordinal FROM (SELECT DISTINCT year FROM yg)) o
              ON o.year = grid.year)
        GROUP BY "grant"))))"""
CUR = "cur AS (SELECT max(CAST(year(date_ordered) AS INTEGER)) AS current_year FROM order_lines WHERE date_ordered IS NOT NULL)"
sql("yearly_projection", """SELECT "grant", CAST(current_year AS INTEGER) AS current_year, n_years, last_spend,
  round(projected, 6) AS projected, round(growth_pct, 6) AS growth_pct,
  CASE WHEN growth_pct > 5 THEN 'Up' WHEN growth_pct < -5 THEN 'Down' ELSE 'Stable' END AS trend
FROM proj, cur""", YG, GRID, PROJ, CUR)
sql("projection_total", f"""SELECT CAST(cur.current_year AS INTEGER) AS current_year, t.total_current,
  round(p.total_projected, 6) AS total_projected,
  round(CASE WHEN t.total_current > 0 THEN (p.total_projected - t.total_current) / t.total_current * 100 ELSE 0.0 END, 6) AS change_pct
FROM cur
JOIN (SELECT CAST(year(date_ordered) AS INTEGER) AS year, {DSUM} AS total_current FROM order_lines WHERE date_ordered IS NOT NULL GROUP BY 1) t
  ON t.year = cur.current_year
CROSS JOIN (SELECT sum(round(round(projected, 6), 2)) AS total_projected FROM proj) p""", YG, GRID, PROJ, CUR)

# ---- forecasts ---------------------------------------------------------------
def NPR(expr: str, d: int) -> str:
    """rint(x * 10^d) / 10^d with ties to even, spelled out for DuckDB."""
    y = f"(({expr}) * {float(10 ** d)})"
    return f"((CASE WHEN {y} - floor({y}) = 0.5 THEN 2 * round({y} / 2) ELSE round({y}) END) / {float(10 ** d)})"


AS_OF_SQL = "DATE '2001-08-02'"
DAYS = """d2 AS (SELECT item, date_ordered, first_req,
  lag(date_ordered) OVER (PARTITION BY item ORDER BY date_ordered) AS prev
  FROM (SELECT item, date_ordered, min(req_id) AS first_req FROM order_lines WHERE date_ordered IS NOT NULL GROUP BY 1, 2))"""
sql("days_between_orders", """SELECT o.req_id, o.item, o.date_ordered,
  CAST(CASE WHEN o.req_id = d2.first_req THEN date_diff('day', d2.prev, o.date_ordered) ELSE 0 END AS INTEGER) AS days_diff
FROM order_lines o JOIN d2 ON o.item = d2.item AND o.date_ordered = d2.date_ordered""", DAYS)
sql("item_order_gap", """SELECT item, count(*) AS n_rows, max(date_ordered) AS last_order,
  CASE WHEN count(date_ordered) >= 2 THEN CAST(date_diff('day', min(date_ordered), max(date_ordered)) AS DOUBLE)
       / CAST(count(date_ordered) - 1 AS DOUBLE) END AS mean_gap_days
FROM order_lines GROUP BY item""")
sql("usual_vendor", """SELECT item, first(vendor ORDER BY n DESC, vendor) AS usual_vendor FROM
  (SELECT item, vendor, count(*) AS n FROM order_lines WHERE vendor IS NOT NULL GROUP BY 1, 2) GROUP BY item""")
sql("reorder_predictions", f"""SELECT item,
  CAST(last_order + whole AS DATE) AS predicted_reorder_date,
  CAST(greatest(date_diff('day', {AS_OF_SQL}, last_order) + whole, 0) AS INTEGER) AS days_until_reorder,
  {NPR('CAST(sum_qty AS DOUBLE) / CAST(n_qty AS DOUBLE)', 1)} AS avg_quantity,
  coalesce(usual_vendor, 'Unknown') AS recommended_vendor,
  {NPR('avg_days', 1)} AS order_frequency_days,
  CASE WHEN greatest(date_diff('day', {AS_OF_SQL}, last_order) + whole, 0) <= 7 THEN 'Urgent'
       WHEN greatest(date_diff('day', {AS_OF_SQL}, last_order) + whole, 0) <= 30 THEN 'Soon' ELSE 'Normal' END AS urgency
FROM (SELECT *, CAST(floor(avg_days) AS INTEGER) AS whole FROM
  (SELECT *, CAST(date_diff('day', first_order, last_order) AS DOUBLE) / CAST(n_dated - 1 AS DOUBLE) AS avg_days FROM
    (SELECT item, sum(n) AS n_rows, sum(nd) AS n_dated, min(d0) AS first_order, max(d1) AS last_order,
       sum(sq) AS sum_qty, sum(nq) AS n_qty,
       first(vendor ORDER BY n DESC, vendor) FILTER (WHERE vendor IS NOT NULL) AS usual_vendor
     FROM (SELECT item, vendor, count(*) AS n, count(date_ordered) AS nd, min(date_ordered) AS d0,
             max(date_ordered) AS d1, sum(CAST(qty AS DECIMAL(24,4))) AS sq, count(qty) AS nq
           FROM order_lines GROUP BY item, vendor)
     GROUP BY item)
   WHERE n_rows >= 2 AND n_dated >= 2))
ORDER BY days_until_reorder, item""")
MONTHS = """mm AS (SELECT date_trunc('month', date_ordered) AS month, sum(total) AS s FROM order_lines
  WHERE date_ordered IS NOT NULL AND total IS NOT NULL GROUP BY 1)"""
sql("spend_moving_avg", """SELECT strftime(month, '%Y-%m') AS month, CAST(s AS DOUBLE) AS spend,
  CASE WHEN rn >= least(m, 3) THEN CAST(CASE least(m, 3) WHEN 1 THEN s WHEN 2 THEN s + lag1 ELSE s + lag1 + lag2 END AS DOUBLE)
       / CAST(least(m, 3) AS DOUBLE) END AS moving_avg
FROM (SELECT *, row_number() OVER (ORDER BY month) AS rn, lag(s, 1) OVER (ORDER BY month) AS lag1,
             lag(s, 2) OVER (ORDER BY month) AS lag2 FROM mm), (SELECT count(*) AS m FROM mm)""", MONTHS)
sql("spend_recent_trend", """SELECT n_months, CASE WHEN n_months >= 3 THEN (CAST(last AS DOUBLE) - CAST(third_last AS DOUBLE)) / 3 END AS trend
FROM (SELECT count(*) AS n_months, sum(CASE WHEN rn = 1 THEN s END) AS last, sum(CASE WHEN rn = 3 THEN s END) AS third_last
      FROM (SELECT *, row_number() OVER (ORDER BY month DESC) AS rn FROM mm))""", MONTHS)
sql("spend_forecast", """SELECT m AS n_months, CAST(h.horizon AS INTEGER) AS horizon,
  strftime(last_month + to_months(CAST(h.horizon AS INTEGER)), '%Y-%m') AS forecast_month,
  round(avg + trend * CAST(h.horizon AS DOUBLE), 6) AS amount,
  round(CASE WHEN m >= 2 THEN avg ELSE CAST(all_total AS DOUBLE) / CAST(n_orders AS DOUBLE) END, 6) AS monthly_avg,
  round(CASE WHEN m >= 2 THEN avg * 3.0 + trend * 6.0 ELSE CAST(all_total AS DOUBLE) END, 6) AS total_forecast
FROM (SELECT st.m, last_month, all_total, n_orders, CAST(s_win AS DOUBLE) / CAST(least(st.m, 3) AS DOUBLE) AS avg,
        CASE WHEN st.m >= 3 THEN (CAST(s_last AS DOUBLE) - CAST(s_third AS DOUBLE)) / 3 ELSE 0.0 END AS trend
      FROM (SELECT count(*) AS m, sum(CASE WHEN rn <= 3 THEN s END) AS s_win, sum(CASE WHEN rn = 1 THEN s END) AS s_last,
              sum(CASE WHEN rn = 3 THEN s END) AS s_third, max(month) AS last_month
            FROM (SELECT *, row_number() OVER (ORDER BY month DESC) AS rn FROM mm)) st,
           (SELECT sum(total) AS all_total, count(*) AS n_orders FROM order_lines
            WHERE date_ordered IS NOT NULL AND total IS NOT NULL) al) j
LEFT JOIN (SELECT unnest(range(1, 4)) AS horizon) h ON j.m >= 2""", MONTHS)
WEEKS = """wk AS (SELECT item, CAST(date_trunc('week', date_ordered) AS DATE) AS week FROM order_lines WHERE date_ordered IS NOT NULL)"""
sql("weekly_order_count", "SELECT item, week, count(*) AS orders FROM wk GROUP BY item, week", WEEKS)
SMOOTH = """sm AS (SELECT gid, item, CAST(len(ys) AS INTEGER) AS n_weeks,
    list_reduce(ys, lambda acc, x: 0.3::DOUBLE * x + 0.7::DOUBLE * acc) AS level, ys[1] AS first
  FROM (SELECT gid, item, list(CAST(y AS DOUBLE) ORDER BY week) AS ys FROM
        (SELECT 0 AS gid, item, week, count(*) AS y FROM wk GROUP BY item, week
         UNION ALL SELECT 1 AS gid, NULL AS item, week, count(*) AS y FROM wk GROUP BY week) GROUP BY gid, item))"""
sql("demand_smoothing", f"""SELECT CASE WHEN gid = 0 THEN 'item' ELSE 'all' END AS scope, item, n_weeks,
  CASE WHEN n_weeks >= 4 THEN {NPR('level', 2)} END AS current_weekly_avg FROM sm""", WEEKS, SMOOTH)
sql("demand_forecast", f"""SELECT CASE WHEN gid = 0 THEN 'item' ELSE 'all' END AS scope, item, n_weeks,
  CASE WHEN n_weeks >= 4 THEN 'ok' ELSE 'insufficient' END AS status,
  CASE WHEN n_weeks >= 4 THEN {NPR('level', 2)} END AS current_weekly_avg,
  CASE WHEN n_weeks >= 4 THEN {NPR('list_reduce(list_transform(range(12), lambda i: level), lambda a, x: a + x, 0.0::DOUBLE)', 0)} END AS predicted_total,
  CASE WHEN n_weeks >= 4 THEN CASE WHEN level > first THEN 'increasing' ELSE 'decreasing' END END AS trend
FROM sm""", WEEKS, SMOOTH)

# ---- sourcing ----------------------------------------------------------------
VST = """vst AS (SELECT item, vendor,
    CAST(sum(CAST(unit_price AS DECIMAL(24,4))) AS DOUBLE) / CAST(count(unit_price) AS DOUBLE) AS avg_price,
    count(req_id) AS order_count, count(date_received) AS delivered_count,
    CAST(count(date_received) AS DOUBLE) / CAST(count(req_id) AS DOUBLE) AS reliability
  FROM order_lines WHERE vendor IS NOT NULL GROUP BY item, vendor)"""
sql("vendor_item_stats", "SELECT * FROM vst", VST)
ITEMST = """ist AS (SELECT item, sum(qty) AS total_qty,
    CAST(sum(CAST(qty AS DECIMAL(24,4))) AS DOUBLE) / CAST(count(qty) AS DOUBLE) AS avg_qty, count(*) AS order_count,
    CAST(sum(CAST(unit_price AS DECIMAL(24,4))) AS DOUBLE) / CAST(count(unit_price) AS DOUBLE) AS avg_price
  FROM order_lines GROUP BY item)"""
sql("item_order_stats", "SELECT * FROM ist", ITEMST)
sql("vendor_price_spread", """SELECT item, vendor, avg_price, min(avg_price) OVER (PARTITION BY item) AS min_price,
  max(avg_price) OVER (PARTITION BY item) AS max_price FROM vst""", VST)
RANK = """rk AS (SELECT item, vendor, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, vendor) AS rank FROM
  (SELECT v.item, v.vendor,
     (1 - (v.avg_price - r.min_price) / (r.max_price - r.min_price + 1)) * 0.6 + v.reliability * 0.4 AS score
   FROM vst v
   JOIN (SELECT item FROM order_lines GROUP BY item HAVING count(*) >= 2) n ON n.item = v.item
   JOIN (SELECT item, min(avg_price) AS min_price, max(avg_price) AS max_price FROM vst GROUP BY item) r ON r.item = v.item))"""
sql("top3_vendors", "SELECT item, CAST(rank AS INTEGER) AS rank, vendor FROM rk WHERE rank <= 3", VST, RANK)
sql("vendor_ranking", "SELECT item, CAST(rank AS INTEGER) AS rank, vendor, score FROM rk WHERE rank <= 3", VST, RANK)
sql("bulk_opportunities", f"""SELECT item, {NPR('avg_qty', 1)} AS current_avg_qty, {NPR('avg_qty * 3', 1)} AS suggested_qty,
  order_count AS order_frequency, avg_qty * 3 * avg_price * 0.1 AS potential_savings, '10%' AS estimated_discount
FROM ist WHERE order_count >= 3 AND avg_qty * 3 * avg_price * 0.1 > 100
ORDER BY potential_savings DESC, item""", ITEMST)

# ---- cleaning on the raw-text fixture ------------------------------------------
from labledger.sources.fixtures import (  # noqa: E402
    INVENTORY_SQL, LINE_ITEM_SQL, NOTED_SQL, ORDER_LINES_RAW_SQL, PO_SUMMARY_SQL, STORED_SQL)

RAW = ORDER_LINES_RAW_SQL


def P8(x: str) -> str:
    return (f"(CASE WHEN ({x}) IS NULL OR trim({x}) = '' THEN '' "
            f"ELSE CAST(TRY_CAST(trunc(TRY_CAST({x} AS DOUBLE)) AS BIGINT) AS VARCHAR) END)")


def P9(x: str) -> str:
    d = f"TRY_CAST({x} AS DOUBLE)"
    return (f"(CASE WHEN {d} IS NOT NULL AND NOT isnan({d}) AND NOT isinf({d}) "
            f"THEN printf('%.0f%%', {NPR(d, 0)}) ELSE '' END)")


def P10(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN '' ELSE replace(split_part({x}, ' ', 1), '/', '-') END)"


def P4(x: str) -> str:
    return f"coalesce(CAST(try_strptime({x}, '%Y-%m-%d') AS DATE), CAST(try_strptime({x}, '%m-%d-%Y') AS DATE))"


def P6(x: str) -> str:
    return (f"(CASE WHEN ({x}) IS NULL THEN '' WHEN contains({x}, ' - ') THEN substring(trim(split_part({x}, ' - ', 1)), 1, 100) "
            f"ELSE trim(substring({x}, 1, 100)) END)")


def P7(x: str) -> str:
    v = f"substring({x}, 1, 100)"
    return (f"(CASE WHEN {v} IS NULL THEN '' WHEN contains({v}, 'Contract no value') "
            f"THEN trim(replace({v}, 'Contract no value', '')) ELSE {v} END)")


def P11(x: str) -> str:
    d = f"TRY_CAST(trim(replace(replace({x}, 'EA', ''), 'CS', '')) AS DOUBLE)"
    return f"(CASE WHEN isnan({d}) THEN 1.0 ELSE coalesce({d}, 1.0) END)"


def P12(q: str, p: str, t: str) -> tuple[str, str, str]:
    qd = f"TRY_CAST({q} AS DOUBLE)"
    qq = f"coalesce(CASE WHEN isnan({qd}) THEN NULL ELSE {qd} END, 1.0)"
    pp = f"coalesce(TRY_CAST({p} AS DECIMAL(18,4)), CAST(0 AS DECIMAL(18,4)))"
    tt = f"coalesce(TRY_CAST({t} AS DECIMAL(18,2)), CAST(CAST({qq} AS DECIMAL(18,4)) * {pp} AS DECIMAL(18,2)))"
    return qq, pp, tt


def P13(x: str) -> str:
    return (f"(CASE WHEN contains({x}, 'Original Req#:') "
            f"THEN trim(split_part(split_part({x}, 'Original Req#:', 2), '.', 1)) END)")


def ORIG(x: str) -> str:
    return f"trim(replace({x}, chr(160), ''))"


def BLANK(o: str) -> str:
    return f"(({o}) IS NULL OR ({o}) IN ('', '*', 'nan'))"


def POKEY(x: str) -> str:
    t = f"trim({x})"
    return f"(CASE WHEN {t} LIKE '%.0' THEN substring({t}, 1, length({t}) - 2) ELSE {t} END)"


SPLIT_NUM = "replace(split_pct, '%', '')"


def TRUNC(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN concat(substring({x}, 1, {n}), '...') ELSE {x} END)"


sql("line_total", """SELECT req_id, CAST(round(CAST(qty AS DECIMAL(18,4)) * CAST(unit_price AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) AS line_total
FROM order_lines""")
sql("receipt_status", "SELECT req_id, CASE WHEN date_received IS NULL OR date_received = '' THEN 'Pending' ELSE 'Received' END AS status FROM order_lines_raw", RAW)
sql("coerce_amount", "SELECT req_id, CASE WHEN isnan(TRY_CAST(total AS DOUBLE)) THEN 0.0 ELSE coalesce(TRY_CAST(total AS DOUBLE), 0.0) END AS total_amt FROM order_lines_raw", RAW)
sql("coerce_date", f"SELECT req_id, {P4(P10('date_ordered'))} AS date_ordered FROM order_lines_raw", RAW)
sql("date_parts", """SELECT req_id, CAST(year(date_ordered) AS INTEGER) AS year, CAST(date_trunc('month', date_ordered) AS DATE) AS month_start,
  CAST(date_trunc('week', date_ordered) AS DATE) AS week_start FROM order_lines""")
sql("clean_item_name", f"SELECT req_id, {P6('item')} AS item FROM order_lines_raw", RAW)
sql("clean_vendor", f"SELECT req_id, {P7('vendor')} AS vendor FROM order_lines_raw", RAW)
sql("integer_id_text", f"SELECT req_id, {P8('cat_no')} AS cat_id, {P8(chr(34) + 'grant' + chr(34))} AS grant_id FROM order_lines_raw", RAW)
sql("split_percent_text", f"SELECT req_id, {P9('split_pct')} AS split_raw, {P9(SPLIT_NUM)} AS split_num FROM order_lines_raw", RAW)
sql("normalize_date_text", f"SELECT req_id, {P10('date_ordered')} AS date_text FROM order_lines_raw", RAW)
sql("parse_pack_qty", f"SELECT req_id, {P11('qty')} AS qty FROM order_lines_raw", RAW)
_q, _p, _t = P12("qty", "unit_price", "total")
sql("amount_fallbacks", f"SELECT req_id, {_q} AS qty, {_p} AS unit_price, {_t} AS total FROM order_lines_raw", RAW)
sql("extract_origin_req", f"SELECT req_id, {P13('notes')} AS orig FROM noted", NOTED_SQL)
sql("origin_note", f"""SELECT line_no, CASE WHEN {BLANK(ORIG('req_raw'))} THEN '' ELSE 'Original Req#: ' || {ORIG('req_raw')} END AS note FROM inv""",
    INVENTORY_SQL)
sql("truncate_text", f"SELECT req_id, {TRUNC('item', 30)} AS item30, {TRUNC('item', 40)} AS item40, {TRUNC('vendor', 10)} AS vendor10 FROM order_lines")
sql("owner_to_lab", """SELECT email, CASE WHEN email = 'admin@example.edu' THEN 'Admin' WHEN email LIKE '%@example.edu' THEN 'Main Lab'
  WHEN NOT contains(email, '@') THEN 'Unknown Lab'
  ELSE upper(substring(split_part(split_part(email, '@', 2), '.', 1), 1, 1)) || lower(substring(split_part(split_part(email, '@', 2), '.', 1), 2)) || ' Lab' END AS lab
FROM (SELECT DISTINCT lower(replace(ordered_by, '#', '.')) || '@' ||
  CASE WHEN lab = 'AMERICA' THEN 'example.edu' ELSE lower(replace(lab, ' ', '')) || '.org' END AS email FROM order_lines)""")
sql("owner_labs", """SELECT DISTINCT email, CASE WHEN lab <> 'EUROPE' THEN least(lab, 'Lab of ' || lab) ELSE 'Europe Lab' END AS lab FROM (
  SELECT lab, lower(replace(ordered_by, '#', '.')) || '@' ||
    CASE WHEN lab = 'AMERICA' THEN 'example.edu' ELSE lower(replace(lab, ' ', '')) || '.org' END AS email FROM order_lines)""")
sql("column_subset", """SELECT req_id, item, vendor, CAST(total AS DOUBLE) AS total, po_no, date_ordered,
  CASE WHEN date_received IS NULL THEN 'Pending' ELSE 'Received' END AS alert FROM order_lines""")


def derived(key: str, parent: str, cols: str) -> None:
    ORACLE[key] = f"SELECT {cols} FROM ({ORACLE[parent]}) AS parent"


derived("urgency_bucket", "reorder_predictions", "item, days_until_reorder, urgency")
derived("trend_bucket", "yearly_projection", '"grant", growth_pct, trend')
derived("next_periods", "spend_forecast", "horizon, forecast_month")
derived("add_fractional_days", "reorder_predictions", "item, predicted_reorder_date, days_until_reorder")
sql("finite_only", """SELECT req_id, qty AS f_qty, CAST(unit_price AS DOUBLE) AS f_price, CAST(total AS DOUBLE) AS f_total
FROM order_lines WHERE qty IS NOT NULL AND isfinite(qty) AND unit_price IS NOT NULL AND total IS NOT NULL""")

# ---- import fixtures and joins -------------------------------------------------------
LIP = f"""lip AS (SELECT *, {P6('item_raw')} AS item_clean, {POKEY('po_raw')} AS k_po,
    substring({P6('item_raw')}, 1, 30) AS k_item FROM li
  WHERE coalesce(TRY_CAST(price_raw AS DOUBLE) > 0, false))"""
SKEYS = f"""skeys AS (SELECT DISTINCT {POKEY('po_no')} AS k_po, substring(coalesce(item, ''), 1, 30) AS k_item FROM stored)"""
sql("request_id", "SELECT line_no, printf('REQ-010802-%03d', row_number() OVER (ORDER BY line_no)) AS req_id FROM lip WHERE length(item_clean) >= 3",
    LINE_ITEM_SQL, LIP)
sql("import_anti_join", """SELECT line_no, k_po, k_item FROM lip WHERE length(item_clean) >= 3
  AND NOT EXISTS (SELECT 1 FROM skeys s WHERE s.k_po = lip.k_po AND s.k_item = lip.k_item)""",
    STORED_SQL, LINE_ITEM_SQL, LIP, SKEYS)
sql("import_dup_count", """SELECT lines, lines - duplicates AS new_items, duplicates, in_file_duplicates FROM
  (SELECT count(*) AS lines, CAST(count_if(s.k_po IS NOT NULL) AS BIGINT) AS duplicates FROM lip
     LEFT JOIN skeys s ON s.k_po = lip.k_po AND s.k_item = lip.k_item),
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS in_file_duplicates FROM
     (SELECT lip.k_po, lip.k_item, count(*) AS n FROM lip LEFT JOIN skeys s ON s.k_po = lip.k_po AND s.k_item = lip.k_item
      WHERE s.k_po IS NULL AND length(item_clean) >= 3 GROUP BY 1, 2))""",
    STORED_SQL, LINE_ITEM_SQL, LIP, SKEYS)
sql("first_per_key", """SELECT k_po, k_item, min(line_no) AS line_no FROM lip WHERE length(item_clean) >= 3
  AND NOT EXISTS (SELECT 1 FROM skeys s WHERE s.k_po = lip.k_po AND s.k_item = lip.k_item) GROUP BY 1, 2""",
    STORED_SQL, LINE_ITEM_SQL, LIP, SKEYS)
_lq, _lp, _lt = P12("qty_raw", "price_raw", "total_raw")
MAPLI = f"""mli AS (SELECT line_no, k_po, k_item, item_clean, substring(item_clean, 1, 200) AS item,
    {_lq} AS qty, {_lp} AS unit_price, {_lt} AS total,
    nullif({P7('vendor_raw')}, '') AS vendor, cat_raw AS cat_no,
    nullif({P8('grant_raw')}, '') AS "grant", nullif({P8('project_raw')}, '') AS rf_project,
    nullif({P9('split_raw')}, '') AS split_pct, 'ShopBlue' AS po_source, nullif({POKEY('po_raw')}, '') AS po_no,
    by_raw AS ordered_by, {P4(P10('date_raw'))} AS date_ordered, 'Admin' AS lab,
    ({P8('grant_raw')} IS NULL OR {P8('project_raw')} IS NULL) AS bad
  FROM lip)"""
sql("map_line_items", """SELECT line_no, item, qty, unit_price, total, vendor, cat_no, "grant", rf_project, split_pct,
  po_source, po_no, ordered_by, date_ordered, lab FROM mli WHERE length(item_clean) >= 3""", LINE_ITEM_SQL, LIP, MAPLI)
DISP = """disp AS (SELECT m.*, CASE WHEN length(item_clean) < 3 THEN 'unnamed'
    WHEN s.k_po IS NOT NULL THEN 'duplicate' WHEN bad THEN 'quarantined' END AS pre
  FROM mli m LEFT JOIN skeys s ON s.k_po = m.k_po AND s.k_item = m.k_item),
firsts AS (SELECT min(line_no) AS line_no FROM disp WHERE pre IS NULL
  GROUP BY coalesce(k_po, '#' || CAST(line_no AS VARCHAR)), k_item)"""
ORDER_COLS_SQL = """req_id, item, qty, unit_price, total, vendor, cat_no, "grant", rf_project, split_pct, po_source, po_no,
  notes, ordered_by, date_ordered, date_received, received_by, location, lab"""
sql("import_line_items", f"""SELECT {ORDER_COLS_SQL} FROM (
  SELECT printf('REQ-010802-%03d', row_number() OVER (ORDER BY line_no)) AS req_id, item, qty, unit_price, total, vendor,
    cat_no, "grant", rf_project, split_pct, po_source, po_no, CAST(NULL AS VARCHAR) AS notes, ordered_by, date_ordered,
    CAST(NULL AS DATE) AS date_received, CAST(NULL AS VARCHAR) AS received_by, CAST(NULL AS VARCHAR) AS location, lab
  FROM disp WHERE pre IS NULL AND line_no IN (SELECT line_no FROM firsts))""",
    STORED_SQL, LINE_ITEM_SQL, LIP, SKEYS, MAPLI, DISP)

sql("stream_import", "SELECT item, po_no, total FROM disp WHERE pre IS NULL AND line_no IN (SELECT line_no FROM firsts)",
    STORED_SQL, LINE_ITEM_SQL, LIP, SKEYS, MAPLI, DISP)
sql("import_outcomes", """SELECT disposition, count(*) AS rows FROM (
  SELECT CASE WHEN length(item_clean) < 3 THEN 'unnamed' WHEN bad THEN 'quarantined'
    WHEN pre IS NULL AND line_no IN (SELECT line_no FROM firsts) THEN 'imported' ELSE 'duplicate' END AS disposition FROM disp
  UNION ALL SELECT 'unpriced' FROM li WHERE NOT coalesce(TRY_CAST(price_raw AS DOUBLE) > 0, false)) GROUP BY disposition""",
    STORED_SQL, LINE_ITEM_SQL, LIP, SKEYS, MAPLI, DISP)

POSK = f"""posk AS (SELECT *, {POKEY('po_raw')} AS k_po FROM pos),
spos AS (SELECT DISTINCT {POKEY('po_no')} AS k_po FROM stored WHERE po_no IS NOT NULL)"""
sql("po_anti_join", """SELECT k_po, supplier_raw AS "Supplier" FROM posk WHERE k_po NOT IN (SELECT k_po FROM spos)""",
    STORED_SQL, PO_SUMMARY_SQL, POSK)
sql("scan_po_summary", """SELECT po_raw AS "PO Number", supplier_raw AS "Supplier", amount_raw AS "Total Amount",
  owner_raw AS "PO Owner" FROM pos""", PO_SUMMARY_SQL)
IMPPO = """imppo AS (SELECT printf('REQ-010802-%03d', row_number() OVER (ORDER BY export_month, CAST(po_raw AS BIGINT))) AS req_id,
    '[Add item details]' AS item, CAST(1.0 AS DOUBLE) AS qty,
    CAST(coalesce(TRY_CAST(amount_raw AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS unit_price,
    coalesce(TRY_CAST(amount_raw AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2))) AS total,
    supplier_raw AS vendor, CAST(NULL AS VARCHAR) AS cat_no, CAST(NULL AS VARCHAR) AS "grant",
    CAST(NULL AS VARCHAR) AS rf_project, CAST(NULL AS VARCHAR) AS split_pct, 'ShopBlue' AS po_source, k_po AS po_no,
    CAST(NULL AS VARCHAR) AS notes, owner_raw AS ordered_by, CAST(NULL AS DATE) AS date_ordered,
    CAST(NULL AS DATE) AS date_received, CAST(NULL AS VARCHAR) AS received_by, CAST(NULL AS VARCHAR) AS location,
    'Admin' AS lab
  FROM posk WHERE k_po NOT IN (SELECT k_po FROM spos))"""
sql("import_po_summary", f"SELECT {ORDER_COLS_SQL} FROM imppo", STORED_SQL, PO_SUMMARY_SQL, POSK, IMPPO)
sql("append_orders", """SELECT req_id, item, total, lab FROM stored UNION ALL SELECT req_id, item, total, lab FROM imppo""",
    STORED_SQL, PO_SUMMARY_SQL, POSK, IMPPO)
sql("delete_matching", """SELECT rows_before, rows_after, rows_before - rows_after AS deleted FROM
  (SELECT count(*) AS rows_before FROM (SELECT vendor, po_no, item FROM stored UNION ALL SELECT vendor, po_no, item FROM imppo)),
  (SELECT count(*) AS rows_after FROM (SELECT vendor, po_no, item FROM stored UNION ALL SELECT vendor, po_no, item FROM imppo)
   WHERE NOT (coalesce(regexp_matches(vendor, 'supplier#0000000(1|2)', 'i'), false) OR coalesce(po_no = '7', false)
              OR coalesce(starts_with(item, '['), false)))""",
    STORED_SQL, PO_SUMMARY_SQL, POSK, IMPPO)

INVP = f"""invp AS (SELECT *, {ORIG('req_raw')} AS orig, trim(split_part({ORIG('req_raw')}, '.', 1)) AS k_orig FROM inv
  WHERE item_raw IS NOT NULL AND length(item_raw) > 2),
sorig AS (SELECT DISTINCT {P13('notes')} AS k_orig FROM stored WHERE {P13('notes')} IS NOT NULL),
invpass AS (SELECT * FROM invp WHERE {BLANK('orig')} OR k_orig NOT IN (SELECT k_orig FROM sorig))"""
sql("origin_req_anti_join", "SELECT line_no, sheet, orig FROM invpass", STORED_SQL, INVENTORY_SQL, INVP)
_iq = P11("count_raw")
_ia = "coalesce(TRY_CAST(amount_raw AS DECIMAL(18,4)), CAST(0 AS DECIMAL(18,4)))"
_it = f"coalesce(TRY_CAST(total_raw AS DECIMAL(18,2)), CAST(CAST({_iq} AS DECIMAL(18,4)) * {_ia} AS DECIMAL(18,2)))"
MAPINV = f"""minv AS (SELECT sheet, line_no, substring(item_raw, 1, 200) AS item, {_iq} AS qty, {_ia} AS unit_price,
    {_it} AS total, vendor_raw AS vendor, CASE WHEN sheet = 'Sheet1' THEN NULL ELSE sheet END AS "grant",
    'ShopBlue' AS po_source,
    nullif(CASE WHEN {BLANK(ORIG('req_raw'))} THEN '' ELSE 'Original Req#: ' || {ORIG('req_raw')} END, '') AS notes,
    'Admin' AS lab, orig, k_orig FROM {{src}})"""
sql("map_inventory", """SELECT sheet, line_no, item, qty, unit_price, total, vendor, "grant", po_source, notes, lab FROM minv""",
    INVENTORY_SQL, INVP.split(",\nsorig")[0], MAPINV.replace("{src}", "invp"))
sql("import_inventory", f"""SELECT {ORDER_COLS_SQL} FROM (
  SELECT printf('REQ-010802-%03d', row_number() OVER (ORDER BY sheet, line_no)) AS req_id, item, qty, unit_price, total,
    vendor, CAST(NULL AS VARCHAR) AS cat_no, "grant", CAST(NULL AS VARCHAR) AS rf_project, CAST(NULL AS VARCHAR) AS split_pct,
    po_source, CAST(NULL AS VARCHAR) AS po_no, notes, CAST(NULL AS VARCHAR) AS ordered_by, CAST(NULL AS DATE) AS date_ordered,
    CAST(NULL AS DATE) AS date_received, CAST(NULL AS VARCHAR) AS received_by, CAST(NULL AS VARCHAR) AS location, lab
  FROM minv WHERE (sheet, line_no) IN (
    SELECT min((sheet, line_no)) FROM minv
    GROUP BY CASE WHEN {BLANK('orig')} THEN sheet || chr(0) || CAST(line_no AS VARCHAR) END, CASE WHEN NOT {BLANK('orig')} THEN k_orig END))""",
    STORED_SQL, INVENTORY_SQL, INVP, MAPINV.replace("{src}", "invpass"))
sql("scan_inventory", """SELECT sheet, req_raw AS "Req#", item_raw AS "Item", count_raw AS "#", amount_raw AS "Amount",
  total_raw AS "Total", vendor_raw AS "Vendor", CAST(line_no AS VARCHAR) AS "Line" FROM inv""", INVENTORY_SQL)
sql("scan_line_items", """SELECT po_raw AS "PO #", item_raw AS "Item", vendor_raw AS "Vendor", qty_raw AS "Quantity",
  price_raw AS "Unit Price ($)", total_raw AS "Line Total ($)", grant_raw AS "Grant", project_raw AS "RF Project",
  split_raw AS "Split %", cat_raw AS "Catalog #", by_raw AS "Ordered By", date_raw AS "Date Ordered",
  CAST(line_no AS VARCHAR) AS "Line" FROM li""", LINE_ITEM_SQL)

# ---- maintenance ---------------------------------------------------------------------------
sql("enter_orders", """SELECT printf('REQ-010802-%03d', row_number() OVER (ORDER BY req_id)) AS req_id, item, qty,
  CAST(round(CAST(qty AS DECIMAL(18,4)) * CAST(unit_price AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) AS total, vendor
  FROM order_lines WHERE qty > 2 AND unit_price > 0
    AND trim(coalesce(item, '')) <> '' AND trim(coalesce(vendor, '')) <> ''""")
sql("store_entries", """SELECT CASE WHEN reason IS NULL THEN printf('REQ-010802-%03d', row_number() OVER (PARTITION BY reason IS NULL ORDER BY req_id)) END AS req_id,
  item, qty, reason FROM (SELECT req_id, item, CASE WHEN qty <= 2 THEN 0 ELSE qty END AS qty, CASE
  WHEN item IS NULL OR trim(item) = '' THEN 'Item name is required'
  WHEN coalesce(qty <= 2, true) THEN 'Quantity must be greater than 0'
  WHEN coalesce(unit_price <= 0, true) THEN 'Price must be greater than 0'
  WHEN vendor IS NULL OR trim(vendor) = '' THEN 'Vendor name is required' END AS reason FROM order_lines)""")
sql("adopt_orders", """SELECT req_id, item, NULL AS reason FROM order_lines WHERE date_ordered < DATE '1996-01-01'
  UNION ALL SELECT req_id, item, CASE WHEN date_ordered < DATE '1996-01-01' THEN 'Known id' WHEN qty <= 2 THEN 'Repeated id' END
  FROM (SELECT * FROM order_lines UNION ALL SELECT * FROM order_lines WHERE qty <= 2)""")
sql("receive_all", """SELECT req_id, CASE WHEN date_received IS NULL THEN DATE '2001-08-02' ELSE date_received END AS date_received,
  CASE WHEN date_received IS NULL THEN 'clerk' ELSE received_by END AS received_by FROM order_lines""")
sql("recalculate_totals", """SELECT req_id, CAST(CAST(coalesce(qty, 1.0) AS DECIMAL(18,4)) * coalesce(unit_price, CAST(0 AS DECIMAL(18,4)))
  AS DECIMAL(18,2)) AS total FROM order_lines""")
EDITS_SQL = """e0 AS (SELECT req_id, qty + 1 AS e_qty, unit_price AS e_price, 'edited' AS e_notes, 'shelf ' || lab AS e_location,
    lab <> 'ASIA' AS e_mark FROM order_lines WHERE date_ordered >= DATE '2001-07-01'),
edits AS (SELECT * FROM e0 UNION ALL SELECT * FROM e0 WHERE e_qty = 2),
once AS (SELECT * FROM edits WHERE req_id IN (SELECT req_id FROM edits GROUP BY req_id HAVING count(*) = 1)),
edited AS (SELECT o.req_id, o.item,
    CASE WHEN e.req_id IS NOT NULL THEN e.e_qty ELSE o.qty END AS qty,
    CASE WHEN e.req_id IS NOT NULL THEN CAST(CAST(e.e_qty AS DECIMAL(18,4)) * CAST(e.e_price AS DECIMAL(18,4)) AS DECIMAL(18,2))
         ELSE o.total END AS total,
    CASE WHEN e.req_id IS NOT NULL THEN e.e_notes ELSE o.notes END AS notes,
    CASE WHEN e.req_id IS NOT NULL THEN e.e_location ELSE o.location END AS location,
    CASE WHEN e.req_id IS NOT NULL THEN CASE WHEN e.e_mark THEN DATE '2001-08-02' END ELSE o.date_received END AS date_received,
    CASE WHEN e.req_id IS NOT NULL THEN CASE WHEN e.e_mark THEN 'clerk' END ELSE o.received_by END AS received_by
  FROM order_lines o LEFT JOIN once e ON e.req_id = o.req_id)"""
sql("edit_order", "SELECT req_id, qty, total, notes, location, date_received, received_by FROM edited", EDITS_SQL)
sql("keyed_update", "SELECT req_id, item, qty, total, notes FROM edited WHERE req_id IN (SELECT req_id FROM edits)", EDITS_SQL)
sql("key_lookup", """SELECT req_id, item, CAST(total AS DOUBLE) AS total FROM order_lines
  WHERE date_ordered = (SELECT max(date_ordered) FROM order_lines)""")
sql("delete_by_id", "SELECT req_id FROM order_lines WHERE req_id IS DISTINCT FROM (SELECT min(req_id) FROM order_lines)")

# ---- sources ---------------------------------------------------------------------------------
sql("scan_orders", "SELECT * FROM order_lines")
sql("schema_backfill", "SELECT * REPLACE (CAST(NULL AS VARCHAR) AS rf_project, CAST(NULL AS VARCHAR) AS split_pct) FROM order_lines")
sql("required_projection", "SELECT * FROM order_lines")
sql("write_snapshot", "SELECT * FROM order_lines")
sql("delete_all", "SELECT * FROM order_lines WHERE false")
sql("export_csv", "SELECT * FROM order_lines")
sql("verify_after_write", "SELECT count(*) AS rows, CAST(sum(total) AS DOUBLE) AS spend FROM order_lines")
sql("preview", """SELECT h.*, c.total_rows FROM (SELECT req_id, item, vendor, CAST(total AS DOUBLE) AS total FROM order_lines
  ORDER BY req_id LIMIT 20) h, (SELECT count(*) AS total_rows FROM order_lines) c""")

# ---- anomaly ----------------------------------------------------------------------------------
_z = []
for _c in ["qty", "unit_price", "total"]:
    _mean = f"(s_{_c} / n)"
    _var = f"(q_{_c} / n - {_mean} * {_mean})"
    _z.append(f"round((CAST({_c} AS DOUBLE) - {_mean}) / (CASE WHEN {_var} > 0 THEN sqrt({_var}) ELSE 1.0 END), 9) AS z_{_c}")
_st = ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(24,6))) AS DOUBLE) AS s_{c}, "
                f"CAST(sum(CAST({c} AS DECIMAL(24,6)) * CAST({c} AS DECIMAL(24,6))) AS DOUBLE) AS q_{c}"
                for c in ["qty", "unit_price", "total"])
sql("standardize", f"""SELECT req_id, {', '.join(_z)} FROM
  (SELECT * FROM order_lines WHERE total > 0 AND qty IS NOT NULL AND isfinite(qty) AND unit_price IS NOT NULL) f,
  (SELECT count(*) AS n, {_st} FROM order_lines WHERE total > 0 AND qty IS NOT NULL AND isfinite(qty) AND unit_price IS NOT NULL) st""")
sql("feature_moments", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, n, round(s_{c} / n, 6) AS mean, round(sqrt(q_{c} / n - (s_{c} / n) * (s_{c} / n)), 6) AS sd FROM st"""
    for c in ["qty", "unit_price", "total"]),
    f"st AS (SELECT count(*) AS n, {_st} FROM order_lines WHERE qty IS NOT NULL AND isfinite(qty) AND unit_price IS NOT NULL AND total IS NOT NULL)")
sql("minmax_invert", """SELECT req_id, coalesce(1 - CASE WHEN mx <> mn THEN (CAST(total AS DOUBLE) - CAST(mn AS DOUBLE))
  / CAST(mx - mn AS DOUBLE) END, 0.0) AS inv FROM order_lines, (SELECT min(total) AS mn, max(total) AS mx FROM order_lines)""")
sql("contamination_cut", """SELECT req_id, CAST(total AS DOUBLE) AS total FROM order_lines
  WHERE CAST(total AS DOUBLE) < (SELECT quantile_cont(CAST(total AS DOUBLE), 0.1) FROM order_lines)""")

sql("contamination_cut_sketch", """SELECT lab, count(*) AS n, true AS within FROM (
  SELECT lab, total FROM order_lines UNION ALL SELECT NULL, total FROM order_lines) WHERE total IS NOT NULL GROUP BY lab""")
sql("distinct_vendors_sketch", """SELECT lab, count(DISTINCT vendor) AS vendors, true AS within FROM (
  SELECT lab, vendor FROM order_lines UNION ALL SELECT NULL, vendor FROM order_lines) GROUP BY lab""")

# ---- single predicates and small pieces -----------------------------------------------------
sql("vendor_match", "SELECT req_id, vendor FROM order_lines WHERE coalesce(regexp_matches(vendor, 'supplier#00000001[0-9]', 'i'), false)")
sql("grant_match", """SELECT req_id, "grant" FROM order_lines WHERE coalesce(regexp_matches("grant", '^(auto|mach)', 'i'), false)""")
sql("source_equals", "SELECT req_id, po_source FROM order_lines WHERE coalesce(po_source = 'Stock Room', false)")
sql("priced_lines", """SELECT line_no, TRY_CAST(price_raw AS DOUBLE) AS price FROM li
  WHERE TRY_CAST(price_raw AS DOUBLE) IS NOT NULL AND TRY_CAST(price_raw AS DOUBLE) > 0""", LINE_ITEM_SQL)
sql("named_lines", "SELECT line_no, item_clean FROM lip WHERE item_clean IS NOT NULL AND length(item_clean) >= 3",
    LINE_ITEM_SQL, LIP)
sql("dated_rows", f"SELECT req_id, {P4(P10('date_ordered'))} AS d FROM order_lines_raw WHERE {P4(P10('date_ordered'))} IS NOT NULL", RAW)
sql("assigned_only", "SELECT req_id, rf_project FROM order_lines WHERE rf_project IS NOT NULL AND rf_project <> ''")
sql("import_total", """SELECT CAST(sum(TRY_CAST(total_raw AS DECIMAL(18,2))) AS DOUBLE) AS import_total, count(*) AS lines
  FROM li WHERE coalesce(TRY_CAST(price_raw AS DOUBLE) > 0, false)""", LINE_ITEM_SQL)
sql("map_po_summary", f"""SELECT {POKEY('po_raw')} AS po_no, '[Add item details]' AS item, CAST(1.0 AS DOUBLE) AS qty,
  coalesce(TRY_CAST(amount_raw AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2))) AS total, supplier_raw AS vendor,
  owner_raw AS ordered_by, 'ShopBlue' AS po_source FROM pos""", PO_SUMMARY_SQL)

# ---- dispatch ---------------------------------------------------------------------------------
ORACLE["detect_export_format"] = " UNION ALL ".join(
    f"SELECT '{name}' AS export, count(*) AS imported FROM ({ORACLE['import_' + name]})" for name in ("line_items", "po_summary", "inventory"))
sql("_report_lines", """SELECT 'line_items' AS export, coalesce(pre, CASE WHEN line_no IN (SELECT line_no FROM firsts) THEN 'imported' ELSE 'duplicate' END) AS disposition,
  count(*) AS rows FROM disp GROUP BY 2 UNION ALL SELECT 'line_items', 'unpriced', (SELECT count(*) FROM li) - (SELECT count(*) FROM lip)""",
    STORED_SQL, LINE_ITEM_SQL, LIP, SKEYS, MAPLI, DISP)
sql("_report_summary", """SELECT 'po_summary' AS export, 'imported' AS disposition, count(*) AS rows FROM imppo
  UNION ALL SELECT 'po_summary', 'duplicate', (SELECT count(*) FROM pos) - (SELECT count(*) FROM imppo)""", STORED_SQL, PO_SUMMARY_SQL, POSK, IMPPO)
sql("_report_inventory", f"""SELECT 'inventory' AS export, 'imported' AS disposition, count(*) AS rows FROM ({ORACLE['import_inventory']})
  UNION ALL SELECT 'inventory', 'unnamed', (SELECT count(*) FROM inv) - (SELECT count(*) FROM invp)
  UNION ALL SELECT 'inventory', 'duplicate', (SELECT count(*) FROM invp) - (SELECT count(*) FROM ({ORACLE['import_inventory']}))""", STORED_SQL, INVENTORY_SQL, INVP)
ORACLE["import_report"] = " UNION ALL ".join(f"SELECT * FROM ({ORACLE.pop('_report_' + n)}) WHERE rows > 0" for n in ("lines", "summary", "inventory"))
# The same rows with stored keys laid out by key, and with stored rows reduced by a bit set.
for _name in ("import_line_items", "import_po_summary", "import_inventory"):
    ORACLE[f"{_name}_keyed"] = ORACLE[_name]
ORACLE["import_anti_join_prefiltered"] = ORACLE["import_anti_join"]
