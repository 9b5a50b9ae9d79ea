"""Registered renewal queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import ledger, renewal
from ledgerspark.plans.analytics import CENTS, sql
from ledgerspark.plans.ledger import BINDINGS, CORPORATE, PLATE, VIN, corporate
from ledgerspark.plans.proxies import records, view

NOW = "2000-06-15"
TASKS = """SELECT task_id, customer_key, policy_type, enterprise_id, end_date, priority, primary_record_id, assignee, status, updated_day FROM (
  SELECT c_custkey AS task_id, '京A' || lpad(CAST(c_custkey AS STRING), 6, '0') AS customer_key,
  CASE c_mktsegment WHEN 'BUILDING' THEN '机动车交通事故责任强制保险' WHEN 'AUTOMOBILE' THEN '机动车商业保险' WHEN 'MACHINERY' THEN '驾乘人员意外险' WHEN 'HOUSEHOLD' THEN '家财险' ELSE '' END AS policy_type,
  CAST(c_nationkey AS BIGINT) AS enterprise_id, CAST('2000-06-15' AS DATE) + CAST(c_custkey % 80 AS INT) - 30 AS end_date, CAST(c_custkey % 3 AS INT) AS priority, -c_custkey AS primary_record_id, c_custkey % 9 AS assignee,
  CASE c_custkey % 5 WHEN 0 THEN 'renewed' WHEN 1 THEN 'lost' WHEN 2 THEN 'following' ELSE 'pending' END AS status, CAST('2000-06-15' AS DATE) - CAST(c_custkey % 40 AS INT) AS updated_day FROM {customer} WHERE c_custkey % 2 = 0) t"""
USERS_OPT = "SELECT s_suppkey - 1 AS user_id, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END AS renewal_enabled FROM {supplier}"
LOG = "SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST('2000-06-15' AS DATE) ELSE CAST('2000-06-14' AS DATE) END AS remind_date FROM {orders} WHERE o_orderkey % 7 = 1"
FOLLOWUPS = "SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS followup_id, l_partkey AS task_id, l_returnflag || CAST(l_orderkey AS STRING) AS content, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS DATE) END AS next_remind_at FROM {lineitem}"
TENANT_NOTES = """SELECT c_custkey AS enterprise_id, CASE WHEN c_custkey % 3 = 0 THEN '[{{"date":"2000-06-14","text":"old"}},{{"date":"2000-06-15","text":"' || c_name || '"}},{{"date":"2000-06-15","text":"later"}}]' WHEN c_custkey % 3 = 1 THEN '[{{"date":"2000-06-13","text":"x"}}]' END AS remark FROM {customer}"""

POLICIES = "deleted = 0 AND status IN ('done', 'success') AND doc_category = '保单'"
KEY = f"coalesce({PLATE}, {VIN})"
DUE = f"SELECT *, {KEY} AS customer_key FROM records WHERE {POLICIES} AND end_date BETWEEN DATE '{NOW}' - 30 AND DATE '{NOW}' + 30"
PRIORITY = f"CASE WHEN end_date - DATE '{NOW}' <= 7 THEN 2 WHEN end_date - DATE '{NOW}' <= 30 THEN 1 ELSE 0 END"
FOUND = f"""SELECT *, {PRIORITY} AS priority FROM (SELECT customer_key, policy_type, enterprise_id, {", ".join(f"(min({{'d': end_date, 'i': id, 'v': {c}}})).v AS {c}" for c in ("plate_no", "vin", "insured", "company_short", "policy_no", "total_premium"))}, min(end_date) AS end_date, (min({{'d': end_date, 'i': id}})).i AS primary_record_id, list_sort(list(id)) AS ids, arg_max(sender, id) AS sender FROM ({DUE}) WHERE customer_key IS NOT NULL GROUP BY 1, 2, 3)"""
REMIND = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(NULLIF(policy_no, ''), '#' || CAST(id AS VARCHAR)), plate_no ORDER BY id DESC) AS k FROM ({DUE}) r WHERE user_id IN (SELECT s_suppkey - 1 FROM supplier WHERE s_suppkey % 4 <> 0)
  AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.status IN ('renewed', 'lost', 'closed') AND t.enterprise_id = r.enterprise_id AND (t.customer_key = ({PLATE}) OR t.customer_key = ({VIN}))) AND NOT EXISTS (SELECT 1 FROM log WHERE record_id = id AND remind_date = DATE '{NOW}')) WHERE k = 1"""


def _found(s, d):
    return renewal.tasks(records(s, d), NOW)


def _seal(s, d):
    return ledger.seal_groups(corporate(s, d), list(range(12)))


def _merged(s, d):
    return renewal.merge_tasks(view(s, d, TASKS), _found(s, d).withColumn("assignee", F.lit(None).cast("long")))


#: Before the change, some records had another plate.
BEFORE = "京A-' || lpad(CAST(id % 1000 AS STRING), 6, '0')"


def _changes(s, d):
    now = records(s, d)
    before = F.struct(*[F.expr(f"'{BEFORE}").alias(c) if c == "plate_no" else F.col(c) for c in now.columns])
    return now.where("id % 5 = 0").select(before.alias("before"), F.struct(*now.columns).alias("after"))


QUERIES = {
    "R1_window": lambda s, d: renewal.window_records(records(s, d), NOW).select("id", "end_date"),
    "R2_tasks": lambda s, d: _found(s, d).withColumn("record_ids", F.concat_ws(",", "record_ids")),
    "R3_assignees": lambda s, d: renewal.default_assignee(_found(s, d), view(s, d, BINDINGS)).select("customer_key", "policy_type", "enterprise_id", "assignee"),
    "R4_merge_tasks": _merged,
    "R5_hints": lambda s, d: renewal.hints(renewal.tasks(records(s, d), NOW), records(s, d).withColumn("start_date", F.when(F.col("id") % 2 == 0, F.date_add("start_date", 364)).otherwise(F.col("start_date")))),
    "R6_task_list": lambda s, d: renewal.task_list(view(s, d, TASKS), 7).select("task_id", "priority", "end_date"),
    "R7_task_stats": lambda s, d: renewal.task_stats(view(s, d, TASKS), NOW),
    "R8_reminders": lambda s, d: renewal.reminders(records(s, d), view(s, d, USERS_OPT), view(s, d, TASKS), view(s, d, LOG), NOW).select("id", "policy_no", "plate_no"),
    "R9_digest": lambda s, d: renewal.digest(renewal.reminders(records(s, d), view(s, d, USERS_OPT), view(s, d, TASKS), view(s, d, LOG), NOW), NOW),
    "R10_seal_digest": lambda s, d: renewal.seal_digest(_seal(s, d)),
    "R11_history": lambda s, d: renewal.history(records(s, d), "京A000100", "LSVA0000000700").select("id", "end_date"),
    "R11_next_reminder": lambda s, d: renewal.next_reminder(view(s, d, TASKS), view(s, d, FOLLOWUPS)).select("task_id", "followups", "last_content", "remind_at"),
    "R12_followup_digest": lambda s, d: renewal.followup_digest(view(s, d, TENANT_NOTES), NOW),
    "R13_changes": lambda s, d: renewal.rebuild(view(s, d, TASKS), records(s, d), NOW, renewal.changed_customers(_changes(s, d))),
    "R13_refresh": lambda s, d: renewal.refresh(view(s, d, TASKS), records(s, d), records(s, d).where("id % 5 = 0"), NOW),
}

_MERGE = f"""SELECT coalesce(e.customer_key, f.customer_key) AS customer_key, coalesce(e.policy_type, f.policy_type) AS policy_type, coalesce(e.enterprise_id, f.enterprise_id) AS enterprise_id,
  {", ".join(f"CASE WHEN coalesce(e.status, '') IN ('renewed', 'lost', 'closed') OR f.priority IS NULL THEN e.{c} ELSE f.{c} END AS {c}" for c in ("end_date", "priority", "primary_record_id"))}, e.assignee, coalesce(e.status, 'pending') AS status,
  CASE WHEN e.status IS NULL THEN 'inserted' WHEN e.status IN ('renewed', 'lost', 'closed') THEN 'closed' WHEN f.priority IS NOT NULL THEN 'updated' ELSE 'kept' END AS outcome
  FROM (SELECT * FROM tasks@) e FULL JOIN (SELECT * FROM ({FOUND})@) f ON e.customer_key = f.customer_key AND e.policy_type = f.policy_type AND e.enterprise_id = f.enterprise_id"""

_NEAR = f"end_date BETWEEN DATE '{NOW}' - 30 AND DATE '{NOW}' + 30"
_KEPT = f"""SELECT * FROM (SELECT *, {KEY} AS customer_key, max(CASE WHEN {_NEAR} THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY}, enterprise_id) AS due FROM records WHERE {POLICIES}) d
  WHERE {_NEAR} OR (due = 0 AND EXISTS (SELECT 1 FROM tasks t WHERE t.customer_key = d.customer_key AND t.enterprise_id = d.enterprise_id AND t.status NOT IN ('renewed', 'lost', 'closed')))"""
_CHANGED = f" SEMI JOIN (SELECT {KEY} AS customer_key, enterprise_id FROM records WHERE id % 5 = 0 UNION SELECT replace('{BEFORE}, '-', ''), enterprise_id FROM records WHERE id % 5 = 0) ch USING (customer_key, enterprise_id)"

ORACLE_SQL = {
    "R1_window": sql(f"SELECT id, end_date FROM ({DUE})"),
    "R2_tasks": sql(f"SELECT * EXCLUDE (ids), array_to_string(ids, ',') AS record_ids FROM ({FOUND})"),
    "R3_assignees": sql(f"SELECT customer_key, policy_type, f.enterprise_id, coalesce(o.u, e.u) AS assignee FROM ({FOUND}) f LEFT JOIN (SELECT sender, enterprise_id, min(user_id) AS u FROM bindings WHERE enterprise_id IS NOT NULL GROUP BY 1, 2) o ON o.sender = f.sender AND o.enterprise_id = f.enterprise_id LEFT JOIN (SELECT sender, min(user_id) AS u FROM bindings WHERE enterprise_id IS NULL GROUP BY 1) e ON e.sender = f.sender", bindings=BINDINGS),
    "R4_merge_tasks": sql(_MERGE.replace("@", ""), tasks=TASKS),
    "R5_hints": sql(f"""SELECT customer_key, policy_type, enterprise_id, h.i AS hint_id, h.e AS hint_end, CASE WHEN h.c <> '' AND h.o <> '' AND h.c <> h.o THEN 'transfer' ELSE 'renew' END AS hint FROM (SELECT t.customer_key, t.policy_type, t.enterprise_id, max({{'e': p.end_date, 'i': p.id, 'c': p.company_short, 'o': t.company_short}}) AS h
      FROM (SELECT *, {PLATE} AS pk, {VIN} AS vk FROM ({FOUND})) t JOIN (SELECT *, {PLATE} AS pk, {VIN} AS vk, CASE WHEN id % 2 = 0 THEN start_date + 364 ELSE start_date END AS s FROM records WHERE {POLICIES}) p ON p.enterprise_id = t.enterprise_id AND p.policy_type = t.policy_type AND (p.pk = t.pk OR p.vk = t.vk) WHERE p.s - t.end_date BETWEEN -7 AND 35 AND NOT list_contains(t.ids, p.id) GROUP BY 1, 2, 3)"""),
    "R6_task_list": sql("SELECT task_id, priority, end_date FROM tasks WHERE enterprise_id = 7 AND status IN ('pending', 'following', 'contacted')", tasks=TASKS),
    "R7_task_stats": sql(f"SELECT enterprise_id, count(*) FILTER (o AND end_date < DATE '{NOW}') AS overdue, count(*) FILTER (o AND end_date BETWEEN DATE '{NOW}' AND DATE '{NOW}' + 30) AS due, count(*) FILTER (status = 'renewed' AND updated_day >= DATE '2000-06-01') AS renewed, count(*) FILTER (o) AS open FROM (SELECT *, status IN ('pending', 'following', 'contacted') AS o FROM tasks) GROUP BY 1", tasks=TASKS),
    "R8_reminders": sql(f"SELECT id, policy_no, plate_no FROM ({REMIND})", tasks=TASKS, log=LOG),
    "R9_digest": sql(f"""SELECT enterprise_id, sender, CAST(sum(n) AS BIGINT) AS n_policies, string_agg(t, chr(10) ORDER BY s) AS text FROM (SELECT enterprise_id, sender, s, count(*) AS n, '[' || ['overdue', 'soon', 'later'][s + 1] || ']' || chr(10) || string_agg(coalesce(NULLIF(plate_no, ''), '-') || ' ' || policy_no || ' ' || CAST(end_date AS VARCHAR), chr(10) ORDER BY end_date, policy_no, id) AS t
      FROM (SELECT *, CASE WHEN end_date < DATE '{NOW}' THEN 0 WHEN end_date - DATE '{NOW}' <= 7 THEN 1 ELSE 2 END AS s FROM ({REMIND})) GROUP BY 1, 2, 3) GROUP BY 1, 2""", tasks=TASKS, log=LOG),
    "R10_seal_digest": sql(f"SELECT enterprise_id, coalesce(string_agg(seal_key || ' ' || premium, chr(10) ORDER BY first_id) FILTER (k <= 10), '') AS text, greatest(count(*) - 10, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY enterprise_id ORDER BY first_id) AS k FROM (SELECT enterprise_id, seal_key, bool_and(seal_paid = 1) AS paid, min(id) AS first_id, coalesce(CAST(CAST(sum({CENTS}) AS BIGINT) AS VARCHAR), min(total_premium)) AS premium FROM (SELECT *, CASE WHEN enterprise_id < 12 THEN coalesce({PLATE}, {VIN}, CAST(id AS VARCHAR)) || '|' || coalesce(CAST(sign_date AS VARCHAR), '') ELSE '#' || CAST(id AS VARCHAR) END AS seal_key FROM records WHERE {CORPORATE} AND deleted = 0 AND status = 'done') GROUP BY 1, 2) WHERE NOT paid) GROUP BY 1"),
    "R11_history": sql(f"SELECT id, end_date FROM records WHERE deleted = 0 AND ({PLATE} = '京A000100' OR {VIN} = 'LSVA0000000700')"),
    "R11_next_reminder": sql("SELECT t.task_id, coalesce(n, 0) AS followups, last_content, remind_at FROM tasks t LEFT JOIN (SELECT task_id, count(*) AS n, arg_max(content, followup_id) AS last_content, arg_max(next_remind_at, followup_id) FILTER (next_remind_at IS NOT NULL) AS remind_at FROM f GROUP BY 1) x ON x.task_id = t.task_id", tasks=TASKS, f=FOLLOWUPS),
    "R12_followup_digest": sql(f"SELECT c_custkey AS enterprise_id, '{NOW}' AS date, c_name AS text FROM customer WHERE c_custkey % 3 = 0"),
    "R13_changes": sql(f"SELECT m.*, EXISTS (SELECT 1 FROM records r WHERE {POLICIES} AND {KEY} = m.customer_key AND r.policy_type = m.policy_type AND r.enterprise_id = m.enterprise_id) AS active FROM ({_MERGE.replace(DUE, _KEPT).replace('@', _CHANGED)}) m", tasks=TASKS),
    "R13_refresh": sql(_MERGE.replace("@", f" SEMI JOIN (SELECT DISTINCT {KEY} AS customer_key, enterprise_id FROM records WHERE id % 5 = 0) ch USING (customer_key, enterprise_id)"), tasks=TASKS),
}
