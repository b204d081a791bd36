"""DuckDB texts of the fixtures, used by the oracle side only.

The panel text is the FIXTURES.md definition; every oracle query starts
``WITH`` + ``BASE`` and adds its own CTEs.  Money is summed as integer
cents on purpose.  Doubles are rounded to 6 places on both sides.
"""

# Category levels of the panel.
PANEL_LEVELS = {"payment_method": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
                "internet_service": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]}

PANEL = """
_mx AS (SELECT MAX(o_orderdate) AS t_end FROM orders),
_po AS (SELECT o_custkey, MIN(o_orderdate) AS t0, MAX(o_orderdate) AS t1, COUNT(*) AS n_orders,
        SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS cents,
        SUM(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) AS n_urgent,
        SUM(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS n_f,
        SUM(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END) AS n_p
      FROM orders GROUP BY o_custkey),
_pb AS (SELECT c.*, r.r_name, o.*, mx.t_end,
        CASE WHEN date_diff('day', o.t1, mx.t_end) > 180 THEN 1 ELSE 0 END AS churned,
        CASE WHEN date_diff('day', o.t1, mx.t_end) > 180 THEN date_diff('day', o.t0, o.t1) ELSE date_diff('day', o.t0, mx.t_end) END AS days
      FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey
      JOIN _po o ON o.o_custkey=c.c_custkey CROSS JOIN _mx mx),
panel AS (SELECT c_custkey AS account_id,
  CAST(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS INTEGER) AS senior,
  CASE WHEN n_urgent > 0 THEN 'Yes' ELSE 'No' END AS partner,
  CASE WHEN MOD(n_p, 2) = 0 THEN 'Yes' ELSE 'No' END AS dependents,
  CAST(FLOOR(days / 30.0) AS INT) AS tenure,
  c_mktsegment AS payment_method, r_name AS internet_service,
  CASE WHEN r_name = 'ASIA' THEN 'No internet service' WHEN MOD(n_f, 2) = 0 THEN 'Yes' ELSE 'No' END AS online_security,
  CASE WHEN n_orders < 8 THEN 'Month-to-month' WHEN n_orders < 12 THEN 'One year' ELSE 'Two year' END AS contract,
  CAST(FLOOR(CAST(cents AS DOUBLE) / CAST(CASE WHEN days < 30 THEN 1 ELSE FLOOR(days / 30.0) END AS DOUBLE)) AS DOUBLE) / CAST(100 AS DOUBLE) AS monthly_charges,
  CASE WHEN days < 30 THEN ' ' ELSE CAST(CAST(FLOOR(cents / 100.0) AS BIGINT) AS VARCHAR(20)) END AS total_charges,
  CASE WHEN churned = 1 THEN 'Yes' ELSE 'No' END AS churn
FROM _pb),
cpanel AS (SELECT * REPLACE (CAST(NULLIF(TRIM(total_charges), '') AS DOUBLE) AS total_charges)
           FROM panel WHERE NULLIF(TRIM(total_charges), '') IS NOT NULL),
subj AS (SELECT *, CAST(CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS event FROM cpanel),
ship AS (SELECT o_custkey * 1000 + l_linenumber AS k,
       CAST(FLOOR(date_diff('day', o_orderdate, l_shipdate) / 30.0) AS INT) AS t,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS e,
       l_quantity AS q, l_extendedprice AS p
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate >= o_orderdate),
enc AS (SELECT account_id, CAST(senior AS DOUBLE) AS senior,
  CAST(CASE WHEN partner = 'No' THEN 0 WHEN partner = 'Yes' THEN 1 END AS DOUBLE) AS partner,
  CAST(CASE WHEN dependents = 'No' THEN 0 WHEN dependents = 'Yes' THEN 1 END AS DOUBLE) AS dependents, CAST(tenure AS DOUBLE) AS tenure,
  CAST(CASE WHEN online_security IN ('No', 'No internet service') THEN 0 WHEN online_security = 'Yes' THEN 1 END AS DOUBLE) AS online_security,
  monthly_charges, total_charges,
  CAST(CASE WHEN churn = 'No' THEN 0 WHEN churn = 'Yes' THEN 1 END AS INTEGER) AS churn,
  CAST(contract = 'Month-to-month' AS DOUBLE) AS "contract_Month-to-month", CAST(contract = 'One year' AS DOUBLE) AS "contract_One year",
  CAST(contract = 'Two year' AS DOUBLE) AS "contract_Two year",
""" + "\n".join(f"""  CAST({c} = '{v}' AS DOUBLE) AS "{c}_{v}",""" for c, levels in PANEL_LEVELS.items() for v in levels) + """
  CASE WHEN CAST(('0x' || substr(md5(CAST(account_id AS VARCHAR) || '|' || '42'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.2
       THEN 'test' ELSE 'train' END AS split
  FROM cpanel)
"""


def with_base(sql: str) -> str:
    """Prefix a query whose own CTE list starts with a comma-free body."""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + PANEL + ",\n" + body[5:]
    return "WITH " + PANEL + "\n" + body
