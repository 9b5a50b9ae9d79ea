"""Policy tables derived from the star schema, for the registered queries.

Each is one SELECT that Spark and DuckDB both run; ``{orders}`` and the like stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The day on which all queries take place.
TODAY = "2001-08-01"

RECORDS = """
SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS enterprise_id, o_custkey % 40 AS user_id,
  's' || CAST(o_custkey % 50 AS STRING) AS sender,
  CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'r' || CAST(o_custkey % 20 AS STRING) END AS roomid,
  'm' || CAST(o_orderkey % 4001 AS STRING) || '.pdf' AS filename,
  CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'h' || CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING) END AS file_md5,
  o_orderkey AS msg_seq,
  CASE WHEN o_orderkey % 7 = 0 THEN '批单' WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN '' ELSE '保单' END AS doc_category,
  CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderkey % 13 = 0 THEN 'pending' WHEN o_orderkey % 17 = 0 THEN 'success' ELSE 'done' END AS status,
  CASE WHEN o_orderkey % 22 = 0 THEN '文件损坏' WHEN o_orderkey % 11 = 0 THEN '识别超时' ELSE '' END AS error_message,
  CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE (o_orderkey % 10) / 10.0 END AS confidence,
  CASE WHEN o_orderkey % 3 = 0 THEN 'text' ELSE 'scan' END AS ocr_engine,
  CASE WHEN o_orderkey % 4 = 0 THEN 'upload' ELSE 'chat' END AS source,
  CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderpriority END AS company_short,
  CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS is_abnormal,
  CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'P' || CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING) END AS policy_no,
  CASE c_mktsegment WHEN 'BUILDING' THEN '机动车交通事故责任强制保险' WHEN 'AUTOMOBILE' THEN '机动车商业保险' WHEN 'MACHINERY' THEN '驾乘人员意外险' WHEN 'HOUSEHOLD' THEN '家财险' ELSE '' END AS policy_type,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE c_name END AS insured,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE c_name END AS applicant,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE c_name || CAST(o_orderkey % 2 AS STRING) END AS owner,
  CASE WHEN o_orderkey % 14 = 0 THEN '' ELSE 'ID' || CAST(o_custkey AS STRING) END AS id_number,
  CASE WHEN o_custkey % 37 = 0 THEN '新车' WHEN o_custkey % 31 = 0 THEN '' ELSE '京A-' || lpad(CAST(o_custkey AS STRING), 6, '0') END AS plate_no,
  CASE WHEN o_custkey % 29 = 0 THEN 'SHORT' ELSE 'lsva' || lpad(CAST(o_custkey * 7 AS STRING), 10, '0') END AS vin,
  CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 53 = 0 THEN '待定'
    ELSE CAST(CAST(floor(round(o_totalprice * 100) / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS STRING), 2, '0') || '元' END AS total_premium,
  CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 364 AS end_date,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS sign_date,
  o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS created_day,
  CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS deleted,
  CASE WHEN o_custkey % 9 = 0 THEN '' ELSE 'S' || CAST(o_custkey % 60 AS STRING) END AS salesperson,
  CASE WHEN o_orderkey % 12 = 0 THEN 1 ELSE 0 END AS seal_paid
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

MESSAGES = """
SELECT event_id AS id, event_id - event_id % 2 AS seq, 'corp' || CAST(user_id % 3 AS STRING) AS corpid,
  'u' || CAST(user_id AS STRING) AS sender, 'u' || CAST((user_id * 7 + event_id) % 150 AS STRING) AS receiver,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'r' || CAST(user_id % 12 AS STRING) END AS roomid,
  CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'file' WHEN 'purchase' THEN 'image' WHEN 'signup' THEN 'voice' ELSE 'other' END AS msgtype,
  ts AS sent_at, CAST(ts AS DATE) AS sent_day, value, props
FROM {events}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the SELECTs over the tables of a folder; columns that are not asked for are never read."""
    return spark.sql(sql, **{t: base(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RECORDS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MESSAGES)


def oracle(sql: str) -> str:
    """DuckDB SQL with ``records`` and ``messages`` in front of the query."""
    names = {t: t for t in TABLES}
    return f"WITH records AS ({RECORDS.format(**names)}), messages AS ({MESSAGES.format(**names)}) {sql}"
