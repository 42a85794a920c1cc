"""Messy views derived from the clean tables; the same text runs in Spark SQL and in DuckDB.

Every view reads a whole table. ``k % n`` only chooses how a row is spoilt.
"""

MESSY_CUSTOMER = """
WITH b AS (SELECT c_custkey AS k, c_name, c_acctbal, c_mktsegment FROM {customer}),
m AS (SELECT k AS customer_id,
  '  ' || lower(c_name) || '   jr  ' AS full_name,
  CASE k % 6 WHEN 0 THEN 'user' || CAST(k AS STRING) || '@@mail.com' WHEN 1 THEN 'user ' || CAST(k AS STRING) || '@mail.com'
             WHEN 2 THEN 'user' || CAST(k AS STRING) WHEN 3 THEN 'N/A' ELSE 'user' || CAST(k AS STRING) || '@mail.com' END AS email,
  CASE k % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'f' WHEN 2 THEN 'Female' WHEN 3 THEN 'MALE' ELSE 'unknown' END AS gender,
  CASE k % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Y' WHEN 3 THEN '0' WHEN 4 THEN 'TRUE' ELSE 'n/a' END AS is_active,
  CASE k % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN c_mktsegment || 'S' ELSE ' ' || c_mktsegment || ' ' END AS segment,
  CASE k % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Inactive' ELSE 'Pending' END AS account_status,
  CASE k % 4 WHEN 0 THEN 'CS' WHEN 1 THEN 'Computer Science' WHEN 2 THEN 'Pending' ELSE 'Bus. Admin' END AS major,
  '0300' || lpad(CAST(k AS STRING), 7, '0') AS phone,
  CASE k % 4 WHEN 0 THEN '3.5' WHEN 1 THEN '90.2%' WHEN 2 THEN '-1.0' ELSE 'N/A' END AS gpa,
  CASE k % 7 WHEN 0 THEN '4th Year' WHEN 1 THEN 'Fresh.' WHEN 2 THEN 'Soph.' WHEN 3 THEN 'Sr.' WHEN 4 THEN 'Jr.' WHEN 5 THEN 'Freshman' ELSE 'Unknown' END AS study_year,
  CAST(CASE WHEN k % 11 = 0 THEN NULL ELSE k % 140 - 5 END AS INT) AS age,
  CAST(CASE WHEN k % 10 = 0 THEN 0 WHEN k % 17 = 0 THEN NULL WHEN k % 97 = 0 THEN 9999999 ELSE 20000 + (k * 37) % 50000 END AS DOUBLE) AS salary,
  CAST(k % 130 - 10 AS DOUBLE) AS attendance_pct,
  c_acctbal AS balance
  FROM b)
SELECT * FROM m UNION ALL SELECT * FROM m WHERE customer_id % 20 = 0
"""

MESSY_ORDERS = """
WITH b AS (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS amt, o_orderdate AS d, o_orderstatus AS st, o_orderpriority AS pr FROM {orders})
SELECT k AS order_id,
  CASE k % 6 WHEN 0 THEN '$' || amt WHEN 1 THEN 'Rs. ' || amt WHEN 2 THEN amt || ' USD' WHEN 3 THEN amt || '/month' WHEN 4 THEN amt ELSE 'call us' END AS total_price,
  amt AS fee_amount,
  CASE k % 4 WHEN 0 THEN 'PKR' WHEN 1 THEN ' usd' WHEN 2 THEN 'EUR' ELSE 'GBP' END AS currency,
  CASE k % 4 WHEN 0 THEN CAST(year(d) AS STRING) || '-' || lpad(CAST(month(d) AS STRING),2,'0') || '-' || lpad(CAST(day(d) AS STRING),2,'0')
             WHEN 1 THEN CAST(month(d) AS STRING) || '/' || CAST(day(d) AS STRING) || '/' || CAST(year(d) AS STRING)
             WHEN 2 THEN CAST(year(d) AS STRING) || '/' || CAST(month(d) AS STRING) || '/' || CAST(day(d) AS STRING)
             ELSE 'not a date' END AS order_date,
  st AS order_status, ' ' || lower(pr) || '  ' AS priority
FROM b
"""

MESSY_EVENTS = """
SELECT event_id, user_id, ts AS event_ts,
  CASE event_id % 5 WHEN 0 THEN upper(event_type) WHEN 1 THEN event_type || 's' WHEN 2 THEN ' ' || event_type ELSE event_type END AS event_type,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS amount,
  CASE WHEN event_id % 29 = 0 THEN 'TBD' ELSE props END AS props
FROM {events}
"""

_MONTH = "trim(substr('January  February March    April    May      June     July     August   SeptemberOctober  November December ', 9 * CAST(month(d) AS INT) - 8, 9))"
_D, _M, _Y = (f"CAST({part}(d) AS STRING)" for part in ("day", "month", "year"))
_ISO = f"{_Y} || '-' || lpad({_M},2,'0') || '-' || lpad({_D},2,'0')"

#: One date column in thirteen forms, and text that is none.
MIXED_DATES = f"""
WITH b AS (SELECT o_orderkey AS k, o_orderdate AS d FROM {{orders}})
SELECT k AS order_id,
  CASE k % 14 WHEN 0 THEN {_ISO} WHEN 1 THEN {_M} || '/' || {_D} || '/' || {_Y} WHEN 2 THEN {_Y} || '/' || {_M} || '/' || {_D}
    WHEN 3 THEN substr({_MONTH}, 1, 3) || ' ' || {_D} || ', ' || {_Y} WHEN 4 THEN {_D} || ' ' || {_MONTH} || ' ' || {_Y}
    WHEN 5 THEN {_D} || '-' || upper(substr({_MONTH}, 1, 3)) || '-' || {_Y} WHEN 6 THEN {_Y} || lpad({_M},2,'0') || lpad({_D},2,'0')
    WHEN 7 THEN 'Mon, ' || {_D} || ' ' || substr({_MONTH}, 1, 3) || ' ' || {_Y} WHEN 8 THEN {_MONTH} || ' ' || {_D} || 'th, ' || {_Y}
    WHEN 9 THEN {_M} || '.' || {_D} || '.' || {_Y} WHEN 10 THEN {_ISO} || 'T14:05:09Z'
    WHEN 11 THEN '2:05 PM ' || {_M} || '/' || {_D} || '/' || {_Y} WHEN 12 THEN {_MONTH} || ' ' || {_Y} ELSE 'soon, 99 or so' END AS order_date,
  CASE k % 14 WHEN 13 THEN {_ISO} ELSE 'lot ' || CAST(k AS STRING) END AS note
FROM b
"""

#: Measures of which every row lacks others.
MIXED_GAPS = """
SELECT c_custkey AS customer_id,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance,
  CASE WHEN c_custkey % 5 <> 1 THEN CAST(c_nationkey AS DOUBLE) * 10.5 END AS region_score,
  CASE WHEN c_custkey % 11 <> 3 THEN CAST(c_custkey % 140 AS INT) END AS age,
  CASE WHEN c_custkey % 6 <> 2 THEN CAST(c_acctbal AS DOUBLE) / (17 + c_custkey % 9) / 7 END AS spent,
  CASE WHEN c_custkey % 4 <> 3 THEN CAST((c_custkey * 37) % 500 AS DOUBLE) + 0.25 END AS visits,
  CASE WHEN c_custkey % 9 < 4 THEN CAST((c_custkey % 13) * c_nationkey AS DOUBLE) / 7 END AS rating,
  CASE WHEN c_custkey % 50 <> 0 THEN CAST(c_custkey % 8 AS DOUBLE) / 8 END AS share
FROM {customer}
"""

MIXED = ["balance", "region_score", "age", "spent", "visits", "rating", "share"]

VIEWS = {
    "mixed_dates": ("orders", MIXED_DATES),
    "mixed_gaps": ("customer", MIXED_GAPS),
    "messy_customer": ("customer", MESSY_CUSTOMER),
    "messy_orders": ("orders", MESSY_ORDERS),
    "messy_events": ("events", MESSY_EVENTS),
}

TEXT = {
    "mixed_dates": ["order_date", "note"],
    "messy_customer": ["full_name", "email", "gender", "is_active", "segment", "account_status",
                       "major", "phone", "gpa", "study_year"],
    "messy_orders": ["total_price", "fee_amount", "currency", "order_date", "order_status", "priority"],
    "messy_events": ["event_type", "props"],
}
NUMBERS = {
    "messy_customer": {"customer_id": "bigint", "age": "int", "salary": "double",
                       "attendance_pct": "double", "balance": "double"},
    "messy_orders": {"order_id": "bigint"},
    "messy_events": {"event_id": "bigint", "user_id": "bigint", "amount": "double"},
}
COLUMNS = {
    "messy_customer": ["customer_id", *TEXT["messy_customer"], "age", "salary", "attendance_pct", "balance"],
    "messy_orders": ["order_id", *TEXT["messy_orders"]],
    "messy_events": ["event_id", "user_id", "event_ts", "event_type", "amount", "props"],
}
TYPES = {
    view: {c: NUMBERS[view].get(c, "timestamp_ntz" if c == "event_ts" else "string") for c in cols}
    for view, cols in COLUMNS.items()
}


def sql_view(name: str) -> str:
    table, text = VIEWS[name]
    return f"{name} AS ({text.format(**{table: table})})"


def read_table(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spark_view(spark, sf_dir: str, name: str):
    table, text = VIEWS[name]
    return spark.sql(text, **{table: read_table(spark, sf_dir, table)})
