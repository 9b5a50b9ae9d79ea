"""Registered analytics queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import analytics as a
from ledgerspark.plans.proxies import TABLES, TODAY, messages, oracle, records, view

#: Order and line number of ``lineitem`` repeat; with the price they tell its rows apart.
AI_LOGS = """
SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS log_id, l_orderkey AS record_id, l_suppkey % 25 AS enterprise_id,
  CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'corrected' ELSE 'flagged' END AS result,
  CAST(l_quantity AS BIGINT) * 100 AS tokens, CAST(l_shipdate AS DATE) AS day,
  CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_linenumber % 3 = 0 THEN 'plate_no,vin' WHEN l_linenumber % 3 = 1 THEN 'insured' ELSE 'vin,owner,insured' END AS diff_text
FROM {lineitem}
"""
USERS = "SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS user_name, '138' || lpad(CAST(s_suppkey AS STRING), 8, '0') AS phone, CAST(s_nationkey AS BIGINT) AS enterprise_id FROM {supplier}"
TENANTS = "SELECT CAST(n_nationkey AS BIGINT) AS enterprise_id, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'unlimited' WHEN n_nationkey % 5 = 1 THEN 'trial' ELSE 'basic' END AS plan_type, CAST(3 + n_nationkey AS INT) AS plan_months, CAST('2000-06-15' AS DATE) + n_nationkey * 17 AS plan_start FROM {nation}"
PACKS = "SELECT CAST(s_nationkey AS BIGINT) AS enterprise_id, s_suppkey % 7 * 10 AS total_count, s_suppkey % 5 * 10 AS used_count, CAST('2001-07-15' AS DATE) + CAST(s_suppkey % 60 AS INT) AS expires FROM {supplier}"
EXPORTS = "SELECT export_id, l_shipmode_like AS export_type, status, row_count FROM (SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS export_id, CASE WHEN l_linenumber % 2 = 0 THEN 'ledger' ELSE 'renewal' END AS l_shipmode_like, CASE WHEN l_orderkey % 10 = 0 THEN 'failed' ELSE 'done' END AS status, CAST(l_quantity AS BIGINT) AS row_count FROM {lineitem}) t"
SENDERS = "SELECT sender, CASE WHEN event_day % 3 = 0 THEN '' ELSE 'n' || CAST(event_day % 4 AS STRING) END AS name FROM (SELECT 'u' || CAST(user_id AS STRING) AS sender, event_id % 11 AS event_day FROM {events}) t"
BINDINGS = "SELECT c_custkey % 100 + 1 AS user_id, 's' || CAST(c_custkey % 350 AS STRING) AS sender FROM {customer}"
REFERRED = "SELECT c_custkey AS user_id, c_name AS user_name, '139' || lpad(CAST(c_custkey AS STRING), 8, '0') AS phone, CASE WHEN c_custkey % 3 = 0 THEN CAST(floor(c_custkey / 10) AS BIGINT) END AS referrer_id FROM {customer}"
OPTIONS = "SELECT p_partkey AS option_id, p_type AS option, p_size AS batch FROM {part}"
PLANS = "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN 'basic' WHEN o_orderkey % 3 = 1 THEN 'pro' ELSE 'trial' END AS plan_type, CAST(1 + o_orderkey % 36 AS INT) AS months FROM {orders}"
TRANSACTIONS = "SELECT o_orderkey AS tx_id, o_custkey AS user_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CASE WHEN o_orderkey % 3 = 0 THEN 'withdraw' ELSE 'commission' END AS type, CASE WHEN o_orderkey % 4 = 0 THEN 'rejected' ELSE 'done' END AS status FROM {orders}"
TARGETS = "SELECT n_nationkey AS target_id, CAST(n_nationkey AS BIGINT) AS enterprise_id, CASE n_nationkey % 4 WHEN 0 THEN 'month' WHEN 1 THEN 'quarter' WHEN 2 THEN 'year' ELSE 'custom' END AS period_type, CAST('2001-03-05' AS DATE) AS period_start, CAST('2001-06-11' AS DATE) AS period_end, CASE WHEN n_nationkey = 7 THEN 0 ELSE 1000000 * (n_nationkey + 1) END AS target_cents FROM {nation}"

PUSHES = "SELECT c_custkey AS config_id, CAST(c_nationkey AS BIGINT) AS enterprise_id, 'r' || CAST(c_custkey % 90 AS STRING) AS roomid, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS room_name, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS enabled FROM {customer}"
WATCHED = """SELECT CAST(c_nationkey AS BIGINT) AS enterprise_id, '["r' || CAST(c_custkey % 7 AS STRING) || '",{{"id":"r' || CAST(c_custkey % 30 AS STRING) || '","name":"x"}}]' AS rooms FROM {customer}"""
REFERRERS = "SELECT CAST(n_nationkey AS BIGINT) AS enterprise_id, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(1 + n_nationkey % 9 AS BIGINT) END AS referrer_id FROM {nation}"

FIRST, LAST = "2001-06-20", TODAY
CARDS = [
    {"name": "n_all", "kind": "count"},
    {"name": "scan_cents", "kind": "sum", "field": "total_premium", "filters": [{"field": "ocr_engine", "op": "eq", "value": "scan"}]},
    {"name": "urgent_avg", "kind": "avg", "field": "total_premium", "filters": [{"field": "company_short", "op": "contains", "value": "URGENT"}, {"field": "policy_type", "op": "not_contains", "value": "机动车"}]},
]


def duck(**tables: str) -> str:
    names = {t: t for t in TABLES}
    return "".join(f"{k} AS ({v.format(**names)}), " for k, v in tables.items())


def sql(query: str, **tables: str) -> str:
    """DuckDB SQL over the records, messages and further tables."""
    full = oracle("")
    return full.rstrip() + (", " + duck(**tables).rstrip(", ") if tables else "") + " " + query


CENTS = "CAST(round(TRY_CAST(NULLIF(regexp_replace(total_premium, '[^0-9.-]', '', 'g'), '') AS DOUBLE) * 100) AS BIGINT)"
SUM_CENTS = f"CAST(coalesce(sum({CENTS}), 0) AS BIGINT)"
CLASS = """CASE WHEN policy_type LIKE '%强制%' THEN 'compulsory' WHEN policy_type LIKE '%商业%' THEN 'commercial' WHEN policy_type LIKE '%驾乘%' THEN 'accident' WHEN policy_type LIKE '%家财%' THEN 'non_vehicle' ELSE 'accident' END"""
DONE = "deleted = 0 AND status IN ('done', 'success')"
UNRECOVERED = "SELECT * FROM records r WHERE deleted = 0 AND status = 'failed' AND NOT (file_md5 <> '' AND EXISTS (SELECT 1 FROM records d WHERE d.deleted = 0 AND d.status IN ('done', 'success') AND d.file_md5 = r.file_md5))"
FILE = "regexp_matches(error_message, '损坏|加密|无法打开|格式')"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(({part}) * CAST(100.0 AS DOUBLE) / ({whole}), 2) ELSE CAST(0 AS DOUBLE) END"


def _ai(s, d):
    return view(s, d, AI_LOGS).withColumn("diffs", F.split("diff_text", ","))


QUERIES = {
    "A1_company_stats": lambda s, d: a.company_stats(records(s, d)),
    "A2_company_detail": lambda s, d: a.company_detail(records(s, d), TODAY),
    "A3_tenant_report": lambda s, d: a.tenant_report(records(s, d)),
    "A4_daily_trend": lambda s, d: a.daily_trend(records(s, d), FIRST, LAST),
    "A5_premium_by_insurer": lambda s, d: a.premium_by(records(s, d), "company_short"),
    "A6_product_counts": lambda s, d: a.counts_by(records(s, d), "policy_type"),
    "A7_uploader_ranking": lambda s, d: a.uploader_ranking(records(s, d), view(s, d, USERS)),
    "A8_failure_list": lambda s, d: a.failure_list(records(s, d)),
    "A9_overview": lambda s, d: a.overview(records(s, d), TODAY, 30),
    "A10_hourly": lambda s, d: a.hourly(messages(s, d)),
    "A10_daily": lambda s, d: a.daily(messages(s, d), "2023-12-25", "2024-02-05"),
    "A11_top_insurers": lambda s, d: a.counts_by(records(s, d), "company_short", 10),
    "A11_top_products": lambda s, d: a.counts_by(records(s, d), "policy_type", 10),
    "A11_top_engines": lambda s, d: a.counts_by(records(s, d), "ocr_engine", 10),
    "A11_top_tenants": lambda s, d: a.counts_by(records(s, d), "enterprise_id", 10),
    "A12_source_split": lambda s, d: a.source_split(records(s, d)),
    "A13_tenant_series": lambda s, d: a.tenant_series(records(s, d), TODAY),
    "A14_metric_cards": lambda s, d: a.metric_cards(records(s, d), CARDS),
    "A15_trend": lambda s, d: a.trend(records(s, d), FIRST, LAST),
    "A16_group_chart": lambda s, d: a.group_chart(records(s, d), "salesperson", 5, {"S1": "S2"}),
    "A17_ranking": lambda s, d: a.ranking(records(s, d), view(s, d, "SELECT CASE WHEN n_nationkey = 0 THEN '' ELSE 'S' || CAST(n_nationkey AS STRING) END AS employee_name, 50000000 + n_nationkey * 1000000 AS target_cents FROM {nation}")),
    "A18_attainment": lambda s, d: a.attainment(records(s, d), view(s, d, TARGETS), TODAY),
    "A19_base_set": lambda s, d: a.base_set(records(s, d), FIRST, LAST).select("id", "enterprise_id", "salesperson", "policy_type", "total_premium", "period_day"),
    "A20_salespeople": lambda s, d: a.base_set(records(s, d), FIRST, LAST).select(a.blank_to_null(F.col("salesperson")).alias("name")).where("name is not null").distinct(),
    "A21_ai_stats": lambda s, d: a.ai_stats(_ai(s, d), records(s, d)),
    "A22_ai_issues": lambda s, d: a.ai_issues(view(s, d, AI_LOGS)),
    "A22_ai_logs": lambda s, d: a.ai_logs(view(s, d, AI_LOGS), 2, 20, enterprise_id=7, result="flagged").select("log_id", "record_id", "total", "total_tokens"),
    "A22_ai_pending": lambda s, d: a.ai_pending(records(s, d), view(s, d, AI_LOGS).where("tokens > 3000")),
    "A22_ai_usage": lambda s, d: a.ai_usage(view(s, d, AI_LOGS), 3, 100000),
    "A23_export_audit": lambda s, d: a.export_audit(view(s, d, EXPORTS)),
    "A23_export_page": lambda s, d: a.export_page(view(s, d, EXPORTS), 3, 25, "ledger", "done").select("export_id", "row_count", "total"),
    "A24_sender_list": lambda s, d: a.sender_list(view(s, d, SENDERS)),
    "A25_tenant_links": lambda s, d: a.tenant_links(view(s, d, REFERRERS), view(s, d, PUSHES), view(s, d, WATCHED), view(s, d, USERS)).withColumn("push_rooms", F.concat_ws(",", "push_rooms")),
    "A25_tenant_overview": lambda s, d: a.tenant_overview(view(s, d, TENANTS).select("enterprise_id", "name"), records(s, d), view(s, d, USERS), TODAY),
    "A26_quota": lambda s, d: a.quota(view(s, d, TENANTS), records(s, d).where("created_day >= DATE'2001-07-01'").groupBy("enterprise_id").agg(a.n().alias("n")), view(s, d, PACKS), TODAY, 12),
    "A27_users_with_senders": lambda s, d: a.users_with_senders(view(s, d, USERS), view(s, d, BINDINGS)),
    "A27_referrals": lambda s, d: a.referrals(view(s, d, REFERRED)),
    "A28_option_lookup": lambda s, d: a.option_lookup(view(s, d, OPTIONS), "PROMO BURNISHED COPPER").unionByName(a.option_lookup(view(s, d, OPTIONS), "COPPER")),
    "A28_option_import": lambda s, d: a.option_import(view(s, d, OPTIONS).where("batch > 10"), view(s, d, OPTIONS).where("batch <= 10")),
    "A28_option_pool": lambda s, d: a.option_pool(view(s, d, OPTIONS), "E"),
    "A29_commission": lambda s, d: a.commission(view(s, d, PLANS)),
    "A30_wallet": lambda s, d: a.wallet(view(s, d, TRANSACTIONS)),
    "A30_wallet_history": lambda s, d: a.wallet_history(view(s, d, TRANSACTIONS)),
}

_BASE = f"SELECT *, coalesce(sign_date, created_day) AS period_day FROM records WHERE deleted = 0 AND status = 'done' AND coalesce(NULLIF(doc_category, ''), '保单') = '保单' AND coalesce(sign_date, created_day) BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"
_SIGNED = "CASE WHEN type = 'commission' THEN cents WHEN type = 'withdraw' AND status <> 'rejected' THEN -cents ELSE 0 END"

ORACLE_SQL = {
    "A1_company_stats": sql("SELECT company_short, count(*) AS n FROM records WHERE deleted = 0 AND status = 'done' AND doc_category = '保单' AND confidence > 0 AND company_short <> '' GROUP BY 1"),
    "A2_company_detail": sql(f"SELECT company_short, count(*) AS total, count(*) FILTER (created_day >= date_trunc('month', DATE '{TODAY}') AND created_day <= DATE '{TODAY}') AS this_month, " + ", ".join(f"count(*) FILTER (c = '{c}') AS n_{c}" for c in ("compulsory", "commercial", "accident", "non_vehicle")) + f", min(created_day) AS first_day, max(created_day) AS last_day FROM (SELECT *, {CLASS} AS c FROM records WHERE deleted = 0 AND status = 'done' AND doc_category = '保单') GROUP BY 1"),
    "A3_tenant_report": sql(f"""SELECT coalesce(a.enterprise_id, b.enterprise_id) AS enterprise_id, coalesce(success, 0) AS success, coalesce(abnormal, 0) AS abnormal, coalesce(non_policy, 0) AS non_policy, coalesce(failed, 0) AS failed, coalesce(file_errors, 0) AS file_errors,
      {pct("coalesce(success, 0)", "coalesce(success, 0) + coalesce(abnormal, 0) + coalesce(failed, 0)")} AS success_rate, {pct("coalesce(success, 0) + coalesce(abnormal, 0)", "coalesce(success, 0) + coalesce(abnormal, 0) + coalesce(failed, 0)")} AS recognized_rate
      FROM (SELECT enterprise_id, count(*) FILTER (doc_category = '保单' AND is_abnormal = 0) AS success, count(*) FILTER (doc_category = '保单' AND is_abnormal = 1) AS abnormal, count(*) FILTER (doc_category <> '保单') AS non_policy FROM records WHERE {DONE} GROUP BY 1) a
      FULL JOIN (SELECT enterprise_id, count(*) FILTER (NOT {FILE}) AS failed, count(*) FILTER ({FILE}) AS file_errors FROM ({UNRECOVERED}) GROUP BY 1) b ON a.enterprise_id = b.enterprise_id"""),
    "A4_daily_trend": sql(f"""SELECT day, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(faultless, 0) AS faultless, {pct("coalesce(done, 0)", "coalesce(total, 0)")} AS done_rate, {pct("coalesce(faultless, 0)", "coalesce(total, 0)")} AS faultless_rate
      FROM (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS day) c LEFT JOIN (SELECT created_day, count(*) AS total, count(*) FILTER (status IN ('done', 'success')) AS done, count(*) FILTER (status IN ('done', 'success') AND is_abnormal = 0) AS faultless FROM records WHERE deleted = 0 GROUP BY 1) r ON day = created_day"""),
    "A5_premium_by_insurer": sql(f"SELECT company_short, count(*) AS n, {SUM_CENTS} AS premium_cents FROM records WHERE deleted = 0 AND status = 'done' AND doc_category = '保单' GROUP BY 1"),
    "A6_product_counts": sql("SELECT policy_type, count(*) AS n FROM records WHERE deleted = 0 AND policy_type <> '' GROUP BY 1"),
    "A7_uploader_ranking": sql("SELECT r.user_id, total, success, coalesce(NULLIF(user_name, ''), CAST(r.user_id AS VARCHAR)) AS user_name FROM (SELECT user_id, count(*) AS total, count(*) FILTER (status IN ('done', 'success')) AS success FROM records WHERE deleted = 0 GROUP BY 1) r LEFT JOIN users u ON r.user_id = u.user_id", users=USERS),
    "A8_failure_list": sql(f"SELECT id, enterprise_id, error_message, CASE WHEN {FILE} THEN 'file' ELSE 'system' END AS kind, created_day FROM ({UNRECOVERED}) ORDER BY created_day DESC, id DESC LIMIT 200"),
    "A9_overview": sql("SELECT count(*) FILTER (w) AS total, " + ", ".join(f"count(*) FILTER (w AND status = '{s}') AS n_{s}" for s in ("done", "failed", "pending", "success")) + f", count(*) FILTER (created_day = DATE '{TODAY}') AS today, count(*) FILTER (created_day BETWEEN DATE '{TODAY}' - 7 AND DATE '{TODAY}') AS last_7_days FROM (SELECT *, created_day > DATE '{TODAY}' - 30 AS w FROM records WHERE deleted = 0)"),
    "A10_hourly": sql("SELECT CAST(h AS INT) AS hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT hour(sent_at) AS hh, count(*) AS n FROM messages GROUP BY 1) ON h = hh"),
    "A10_daily": sql("SELECT day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day) LEFT JOIN (SELECT sent_day, count(*) AS n FROM messages GROUP BY 1) ON sent_day = day"),
    "A11_top_insurers": sql("SELECT company_short, count(*) AS n FROM records WHERE deleted = 0 AND company_short <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"),
    "A11_top_products": sql("SELECT policy_type, count(*) AS n FROM records WHERE deleted = 0 AND policy_type <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"),
    "A11_top_engines": sql("SELECT ocr_engine, count(*) AS n FROM records WHERE deleted = 0 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"),
    "A11_top_tenants": sql("SELECT enterprise_id, count(*) AS n FROM records WHERE deleted = 0 GROUP BY 1 ORDER BY n DESC, enterprise_id LIMIT 10"),
    "A12_source_split": sql("SELECT count(*) FILTER (source = 'upload') AS uploads, count(*) FILTER (roomid <> '') AS rooms, count(*) FILTER (source = 'chat' AND roomid = '') AS private, count(*) FILTER (ocr_engine = 'scan') AS scans FROM records WHERE deleted = 0"),
    "A13_tenant_series": sql(f"SELECT b.enterprise_id, c.day, total, coalesce(n, 0) AS n FROM (SELECT enterprise_id, count(*) AS total FROM records WHERE deleted = 0 AND created_day BETWEEN DATE '{TODAY}' - 6 AND DATE '{TODAY}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) b CROSS JOIN (SELECT DATE '{TODAY}' - CAST(unnest(range(7)) AS INT) AS day) c LEFT JOIN (SELECT enterprise_id, created_day, count(*) AS n FROM records WHERE deleted = 0 GROUP BY 1, 2) r ON r.enterprise_id = b.enterprise_id AND r.created_day = c.day"),
    "A14_metric_cards": sql(f"SELECT count(*) AS n_all, CAST(coalesce(sum({CENTS}) FILTER (ocr_engine = 'scan'), 0) AS BIGINT) AS scan_cents, CAST(coalesce(round(avg({CENTS}) FILTER (company_short LIKE '%URGENT%' AND policy_type NOT LIKE '%机动车%')), 0) AS BIGINT) AS urgent_avg FROM records"),
    "A15_trend": sql(f"SELECT bucket, coalesce(n, 0) AS n, coalesce(p, 0) AS premium_cents FROM (SELECT DISTINCT CAST(date_trunc('week', unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY))) AS DATE) AS bucket) LEFT JOIN (SELECT CAST(date_trunc('week', created_day) AS DATE) AS b, count(*) AS n, {SUM_CENTS} AS p FROM records WHERE created_day BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY 1) ON b = bucket"),
    "A16_group_chart": sql(f"SELECT CASE WHEN rank <= 5 THEN name ELSE '其他' END AS name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS premium_cents FROM (SELECT *, row_number() OVER (ORDER BY p DESC, name) AS rank FROM (SELECT CASE WHEN salesperson = 'S1' THEN 'S2' WHEN salesperson = '' THEN '未归属' ELSE salesperson END AS name, count(*) AS n, {SUM_CENTS} AS p FROM records GROUP BY 1)) GROUP BY 1"),
    "A17_ranking": sql(f"SELECT name, n, p AS premium_cents, coalesce(50000000 + n_nationkey * 1000000, 50000000) AS target_cents, round(p * CAST(100.0 AS DOUBLE) / coalesce(50000000 + n_nationkey * 1000000, 50000000), 2) AS attained FROM (SELECT CASE WHEN salesperson = '' THEN '未归属' ELSE salesperson END AS name, count(*) AS n, {SUM_CENTS} AS p FROM records GROUP BY 1) LEFT JOIN nation ON n_nationkey > 0 AND name = 'S' || CAST(n_nationkey AS VARCHAR)"),
    "A18_attainment": sql(f"SELECT target_id, first_day, last_day, target_cents, {SUM_CENTS} AS actual_cents, CASE WHEN target_cents > 0 THEN round({SUM_CENTS} * CAST(100.0 AS DOUBLE) / target_cents, 2) END AS attained FROM (SELECT *, CAST(CASE period_type WHEN 'month' THEN DATE '2001-08-01' WHEN 'quarter' THEN DATE '2001-07-01' WHEN 'year' THEN DATE '2001-01-01' ELSE period_start END AS DATE) AS first_day, CAST(CASE period_type WHEN 'month' THEN DATE '2001-08-31' WHEN 'quarter' THEN DATE '2001-09-30' WHEN 'year' THEN DATE '2001-12-31' ELSE period_end END AS DATE) AS last_day FROM targets) t LEFT JOIN records r ON r.enterprise_id = t.enterprise_id AND created_day BETWEEN first_day AND last_day GROUP BY 1, 2, 3, 4", targets=TARGETS),
    "A19_base_set": sql(f"SELECT id, enterprise_id, salesperson, policy_type, total_premium, period_day FROM ({_BASE})"),
    "A20_salespeople": sql(f"SELECT DISTINCT salesperson AS name FROM ({_BASE}) WHERE salesperson <> ''"),
    "A21_ai_stats": sql(f"""SELECT m.enterprise_id, checks, n_pass, n_corrected, n_flagged, {pct("n_pass", "checks")} AS accuracy, tokens, coalesce(top_fields, '') AS top_fields, coalesce(records, 0) AS records FROM
      (SELECT enterprise_id, count(*) AS checks, count(*) FILTER (result = 'pass') AS n_pass, count(*) FILTER (result = 'corrected') AS n_corrected, count(*) FILTER (result = 'flagged') AS n_flagged, CAST(sum(tokens) AS BIGINT) AS tokens FROM logs GROUP BY ROLLUP (enterprise_id)) m
      LEFT JOIN (SELECT enterprise_id, string_agg(field, ',' ORDER BY n DESC, field) AS top_fields FROM (SELECT *, row_number() OVER (PARTITION BY enterprise_id ORDER BY n DESC, field) AS k FROM (SELECT enterprise_id, field, count(*) AS n FROM (SELECT enterprise_id, unnest(string_split(diff_text, ',')) AS field FROM logs) GROUP BY GROUPING SETS ((enterprise_id, field), (field)))) WHERE k <= 3 GROUP BY 1) f ON f.enterprise_id IS NOT DISTINCT FROM m.enterprise_id
      LEFT JOIN (SELECT enterprise_id, count(*) AS records FROM records WHERE deleted = 0 GROUP BY ROLLUP (enterprise_id)) t ON t.enterprise_id IS NOT DISTINCT FROM m.enterprise_id""", logs=AI_LOGS),
    "A22_ai_issues": sql("SELECT record_id, count(*) AS checks, (max({'i': log_id, 'r': result})).r AS last_result, (max({'i': log_id, 'r': diff_text}) FILTER (diff_text IS NOT NULL)).r AS last_diff, count(*) FILTER (result <> 'pass') AS issues FROM logs GROUP BY 1 HAVING count(*) FILTER (result <> 'pass') > 0", logs=AI_LOGS),
    "A22_ai_logs": sql("SELECT log_id, record_id, total, total_tokens FROM (SELECT *, count(*) OVER () AS total, CAST(sum(tokens) OVER () AS BIGINT) AS total_tokens FROM logs WHERE enterprise_id = 7 AND result = 'flagged') ORDER BY log_id DESC LIMIT 20 OFFSET 20", logs=AI_LOGS),
    "A22_ai_pending": sql("SELECT enterprise_id, count(*) AS pending FROM records WHERE deleted = 0 AND status IN ('done', 'success') AND doc_category = '保单' AND id NOT IN (SELECT record_id FROM logs WHERE tokens > 3000) GROUP BY 1", logs=AI_LOGS),
    "A22_ai_usage": sql("SELECT day, count(*) AS checks, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * 3 AS BIGINT) AS cost_micros, sum(tokens) > 100000 AS above FROM logs GROUP BY 1", logs=AI_LOGS),
    "A23_export_audit": sql("SELECT export_type, count(*) AS exports, count(*) FILTER (status = 'failed') AS failed, CAST(sum(row_count) AS BIGINT) AS \"rows\" FROM exports GROUP BY 1", exports=EXPORTS),
    "A23_export_page": sql("SELECT export_id, row_count, total FROM (SELECT *, count(*) OVER () AS total FROM exports WHERE export_type = 'ledger' AND status = 'done') ORDER BY export_id DESC LIMIT 25 OFFSET 50", exports=EXPORTS),
    "A24_sender_list": sql("SELECT sender, CAST(sum(n) AS BIGINT) AS n, coalesce((max({'a': name <> '', 'n': n, 'name': name})).name, '') AS name FROM (SELECT sender, name, count(*) AS n FROM senders GROUP BY 1, 2) GROUP BY 1", senders=SENDERS),
    "A25_tenant_links": sql("""SELECT t.enterprise_id, coalesce(pushes, 0) AS pushes, coalesce(push_rooms, '') AS push_rooms, coalesce(monitored, 0) AS monitored, coalesce(NULLIF(user_name, ''), phone, '') AS referrer FROM r t LEFT JOIN (SELECT user_id, user_name, phone FROM users) u ON user_id = referrer_id
      LEFT JOIN (SELECT enterprise_id, count(*) AS pushes, string_agg(coalesce(NULLIF(room_name, ''), roomid), ',' ORDER BY config_id) AS push_rooms FROM p WHERE enabled = 1 GROUP BY 1) p USING (enterprise_id)
      LEFT JOIN (SELECT enterprise_id, count(DISTINCT x) AS monitored FROM (SELECT enterprise_id, unnest(regexp_extract_all(rooms, 'r[0-9]+')) AS x FROM w) GROUP BY 1) w USING (enterprise_id)""", r=REFERRERS, p=PUSHES, w=WATCHED, users=USERS),
    "A25_tenant_overview": sql(f"SELECT t.enterprise_id, t.name, coalesce(this_month, 0) AS this_month, coalesce(rooms, 0) AS rooms, coalesce(members, 0) AS members FROM tenants t LEFT JOIN (SELECT enterprise_id, count(*) FILTER (created_day BETWEEN DATE '2001-08-01' AND DATE '{TODAY}') AS this_month, count(DISTINCT NULLIF(roomid, '')) AS rooms FROM records WHERE deleted = 0 GROUP BY 1) r ON r.enterprise_id = t.enterprise_id LEFT JOIN (SELECT enterprise_id, count(*) AS members FROM users GROUP BY 1) u ON u.enterprise_id = t.enterprise_id", tenants=TENANTS, users=USERS),
    "A26_quota": sql(f"""SELECT enterprise_id, ends AS plan_ends, used, boost, boost_expires, state, state IN ('unlimited', 'within', 'boost') AS allowed FROM (SELECT t.enterprise_id, ends, coalesce(n, 0) AS used, coalesce(boost, 0) AS boost, boost_expires, CASE WHEN plan_start > DATE '{TODAY}' THEN 'queued' WHEN ends <= DATE '{TODAY}' THEN 'expired' WHEN plan_type = 'unlimited' THEN 'unlimited' WHEN coalesce(n, 0) < 12 THEN 'within' WHEN coalesce(boost, 0) > 0 THEN 'boost' ELSE 'exhausted' END AS state
      FROM (SELECT *, CAST(plan_start + to_months(plan_months) AS DATE) AS ends FROM tenants) t LEFT JOIN (SELECT enterprise_id, count(*) AS n FROM records WHERE created_day >= DATE '2001-07-01' GROUP BY 1) r ON r.enterprise_id = t.enterprise_id LEFT JOIN (SELECT enterprise_id, CAST(sum(total_count - used_count) AS BIGINT) AS boost, min(expires) AS boost_expires FROM packs WHERE expires >= DATE '{TODAY}' AND total_count > used_count GROUP BY 1) p ON p.enterprise_id = t.enterprise_id)""", tenants=TENANTS, packs=PACKS),
    "A27_users_with_senders": sql("SELECT u.user_id, user_name, substr(phone, 1, 3) || '****' || right(phone, 4) AS phone, coalesce(senders, '') AS senders, coalesce(n_senders, 0) AS n_senders FROM users u LEFT JOIN (SELECT user_id, string_agg(DISTINCT sender, ',' ORDER BY sender) AS senders, count(DISTINCT sender) AS n_senders FROM bindings GROUP BY 1) b ON b.user_id = u.user_id", users=USERS, bindings=BINDINGS),
    "A27_referrals": sql("SELECT referrer_id, count(*) AS n, string_agg(user_name || ' ' || substr(phone, 1, 3) || '****' || right(phone, 4), ';' ORDER BY user_id) AS people FROM users WHERE referrer_id IS NOT NULL GROUP BY 1", users=REFERRED),
    "A28_option_lookup": sql("SELECT option, min(option_id) AS first_id, count(*) AS imports, count(DISTINCT batch) AS batches FROM options WHERE CASE WHEN EXISTS (SELECT 1 FROM options WHERE option = 'PROMO BURNISHED COPPER') THEN option = 'PROMO BURNISHED COPPER' ELSE contains(option, 'PROMO BURNISHED COPPER') END GROUP BY 1 UNION ALL SELECT option, min(option_id), count(*), count(DISTINCT batch) FROM options WHERE CASE WHEN EXISTS (SELECT 1 FROM options WHERE option = 'COPPER') THEN option = 'COPPER' ELSE contains(option, 'COPPER') END GROUP BY 1", options=OPTIONS),
    "A28_option_import": sql("SELECT option, count(*) AS times FROM options WHERE batch <= 10 AND option NOT IN (SELECT option FROM options WHERE batch > 10) GROUP BY 1", options=OPTIONS),
    "A28_option_pool": sql("SELECT option, min(option_id) AS first_id, count(*) AS imports, count(DISTINCT batch) AS batches FROM options WHERE option LIKE '%E%' GROUP BY 1", options=OPTIONS),
    "A29_commission": sql("SELECT order_id, plan_type, months, CAST(20 * CASE plan_type WHEN 'basic' THEN CASE WHEN months % 12 = 0 THEN 990 * (months // 12) ELSE 99 * months END WHEN 'pro' THEN CASE WHEN months % 12 = 0 THEN 2990 * (months // 12) ELSE 299 * months END ELSE 0 END AS BIGINT) AS commission_cents FROM plans", plans=PLANS),
    "A30_wallet": sql(f"SELECT user_id, CAST(sum({_SIGNED}) AS BIGINT) AS balance_cents, count(*) AS transactions FROM tx GROUP BY 1", tx=TRANSACTIONS),
    "A30_wallet_history": sql(f"SELECT tx_id, user_id, CAST(sum({_SIGNED}) OVER (PARTITION BY user_id ORDER BY tx_id) AS BIGINT) AS balance_cents FROM tx", tx=TRANSACTIONS),
}
