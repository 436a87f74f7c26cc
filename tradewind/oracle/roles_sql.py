"""Role views in DuckDB SQL over the pre-registered input tables (mirror of sources/roles.py)."""

from __future__ import annotations

_HALF = "CASE WHEN month({d}) <= 6 THEN 'Spring-Summer' ELSE 'Fall-Winter' END"
_SD = "CAST(l.l_shipdate AS DATE)"

ROLE_SQL: dict[str, str] = {}

ROLE_SQL["sales_fact"] = f"""
SELECT l.l_orderkey AS order_id,
       CAST(l.l_partkey AS VARCHAR) AS material,
       p.p_name AS material_description,
       p.p_type AS category,
       c.c_mktsegment AS forecast_group,
       CASE WHEN n.n_regionkey <> 0 THEN 'US' ELSE 'INTL' END AS sales_org,
       n.n_name AS region,
       o.o_orderpriority AS order_type,
       o.o_orderstatus AS order_status,
       CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS past_original_ship,
       {_SD} AS transaction_dt,
       CAST(year(l.l_shipdate) AS INTEGER) AS transaction_year,
       CAST(month(l.l_shipdate) AS INTEGER) AS transaction_month,
       {_SD} + CAST(10 * l.l_linenumber AS INTEGER) AS request_ship_dt,
       CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_quantity AS BIGINT) ELSE CAST(0 AS BIGINT) END AS ship_qty,
       CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_extendedprice AS DECIMAL(18,2))
            ELSE CAST(0 AS DECIMAL(18,2)) END AS ship_amt,
       CASE WHEN l.l_linestatus = 'O' THEN CAST(l.l_quantity AS BIGINT) ELSE CAST(0 AS BIGINT) END AS open_qty,
       CASE WHEN l.l_linestatus = 'O' THEN CAST(l.l_extendedprice AS DECIMAL(18,2))
            ELSE CAST(0 AS DECIMAL(18,2)) END AS open_amt,
       CASE WHEN l.l_linestatus = 'O' AND l.l_discount < CAST(0.05 AS DOUBLE) THEN CAST(l.l_quantity AS BIGINT)
            ELSE CAST(0 AS BIGINT) END AS ship_open_qty
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey"""

ROLE_SQL["open_orders"] = f"""
SELECT l.l_orderkey AS order_id,
       CAST(l.l_partkey AS VARCHAR) AS material,
       l.l_suppkey AS cust_po,
       CASE WHEN l.l_suppkey % 2 = 0 THEN 'P1' ELSE 'P2' END AS plant,
       {_SD} AS afs_req_dt,
       {_SD} + 21 AS sched_req_dt,
       {_SD} + 28 AS req_deliv_dt,
       {_SD} + CAST(5 * l.l_linenumber AS INTEGER) AS cancel_dt,
       CASE WHEN l.l_linestatus = 'F' THEN CAST(0 AS BIGINT) ELSE CAST(l.l_quantity AS BIGINT) END AS open_qty
FROM lineitem l"""

ROLE_SQL["available_to_sell"] = f"""
SELECT CASE WHEN l.l_suppkey % 2 = 0 THEN 'P1' ELSE 'P2' END AS plant,
       CAST(l.l_partkey AS VARCHAR) AS material,
       p.p_name AS material_description,
       p.p_type AS category,
       {_SD} AS avail_dt,
       CAST(l.l_quantity AS BIGINT) AS quantity
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE l.l_linestatus = 'O'"""

ROLE_SQL["sell_through"] = f"""
SELECT CAST(l.l_partkey AS VARCHAR) AS material,
       p.p_name AS material_description,
       c.c_mktsegment AS retailer,
       CAST(date_trunc('week', {_SD}) AS DATE) AS week_start,
       CAST(sum(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS units_sold,
       CAST(sum(l.l_linenumber) AS BIGINT) AS units_on_hand
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY 1, 2, 3, 4"""

ROLE_SQL["forecast"] = f"""
SELECT CAST(date_trunc('month', sd) AS DATE) + CAST((l_suppkey % 2) * 14 AS INTEGER) AS file_date,
       dem AS demand_date,
       CASE WHEN l_returnflag = 'R' THEN 'SalesForecast' ELSE 'Demand' END AS module,
       c_mktsegment AS forecast_group,
       CASE WHEN n_regionkey <> 0 THEN 'US' ELSE 'INTL' END AS sales_org,
       CASE WHEN l_discount < CAST(0.09 AS DOUBLE) THEN 1 ELSE 0 END AS current_flag,
       n_name AS region,
       CAST(year(dem) AS INTEGER) AS calendar_year,
       CAST(month(dem) AS INTEGER) AS calendar_month,
       {_HALF.format(d='dem')} AS calendar_season,
       CAST(l_partkey AS VARCHAR) AS material,
       p_type AS category,
       CAST(l_quantity AS BIGINT) AS quantity
FROM (SELECT l.*, o.*, c.*, n.*, p.*, {_SD} AS sd,
             CAST({_SD} + to_months(l.l_linenumber) AS DATE) AS dem
      FROM lineitem l
      JOIN orders o ON l.l_orderkey = o.o_orderkey
      JOIN customer c ON o.o_custkey = c.c_custkey
      JOIN nation n ON c.c_nationkey = n.n_nationkey
      JOIN part p ON l.l_partkey = p.p_partkey) x"""

ROLE_SQL["forecast_history"] = """
SELECT * EXCLUDE (forecast_group), forecast_group AS sales_group FROM forecast"""

ROLE_SQL["selected_snapshots"] = """
SELECT max(file_date) AS file_date, module, forecast_group AS sales_group
FROM forecast
GROUP BY date_trunc('month', file_date), module, forecast_group"""

ROLE_SQL["line_list"] = f"""
SELECT DISTINCT CAST(l.l_partkey AS VARCHAR) AS material,
       (CASE WHEN month(l.l_shipdate) <= 6 THEN 'Spring ' ELSE 'Fall ' END) || CAST(year(l.l_shipdate) AS VARCHAR) AS season,
       CASE l.l_returnflag WHEN 'A' THEN 'INL' WHEN 'N' THEN 'SMU' WHEN 'R' THEN 'UTY' END AS inl_or_smu,
       CASE l.l_suppkey % 4 WHEN 1 THEN '' WHEN 2 THEN 'US' WHEN 3 THEN 'EMEA' END AS smu_intent,
       p.p_brand AS model,
       CASE WHEN p.p_size % 2 = 0 THEN 'Mens' ELSE 'Womens' END AS gender,
       CAST(p.p_retailprice AS DECIMAL(18,2)) AS msrp,
       CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) * 0.5 AS DECIMAL(18,2)) AS whsl
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""

ROLE_SQL["style_master"] = """
SELECT CAST(p_partkey AS VARCHAR) AS material,
       p_name AS material_description,
       p_type AS category,
       p_brand AS model,
       CASE WHEN p_size % 2 = 0 THEN 'Mens' ELSE 'Womens' END AS gender,
       CASE WHEN p_size <= 25 THEN 'D1' ELSE 'D2' END AS division,
       CASE WHEN p_size <= 25 THEN 'D1' ELSE 'D2' END AS playbook_division,
       CAST(p_retailprice AS DECIMAL(18,2)) AS price
FROM part"""

ROLE_SQL["material"] = """
SELECT material, material_description FROM style_master"""

ROLE_SQL["calendar"] = f"""
SELECT DISTINCT {_SD} AS the_date, {_HALF.format(d='l.l_shipdate')} AS season_name
FROM lineitem l"""

ROLE_SQL["upc_bridge"] = """
SELECT DISTINCT CAST(l_partkey AS VARCHAR) || lpad(CAST(l_suppkey AS VARCHAR), 19, '0') AS upc, CAST(l_partkey AS VARCHAR) AS material
FROM lineitem"""

ROLE_SQL["forecast_sheet"] = f"""
SELECT upc AS sheet_line, 'A' || upc AS asin, 'V' || CAST(supplier AS VARCHAR) AS vendor_code, upc,
       {', '.join(f'm{m:02d}' for m in range(4, 11))}
FROM (SELECT CAST(l_partkey AS VARCHAR) || lpad(CAST(l_suppkey AS VARCHAR), 19, '0') AS upc, l_suppkey AS supplier,
             {', '.join(f'0.5::DOUBLE * sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE month(l_shipdate) = {m}) AS m{m:02d}' for m in range(4, 11))}
      FROM lineitem GROUP BY 1, 2) w"""
