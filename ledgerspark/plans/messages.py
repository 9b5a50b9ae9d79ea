"""Registered message queries with their SQL.  Texts of the tables are Latin, so rules get Latin keywords here."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import messages as m
from ledgerspark.plans.analytics import sql
from ledgerspark.plans.ledger import ROOMS
from ledgerspark.plans.proxies import messages, records, view

NOW = "2024-01-31 00:00:00"
ENVELOPES = """SELECT event_id AS id, CASE event_type
  WHEN 'click' THEN '{{"msgid":"m' || CAST(event_id AS STRING) || '","from":"u' || CAST(user_id AS STRING) || '","tolist":["a","b"],"msgtype":"text","text":{{"content":"text of ' || CAST(event_id AS STRING) || ' goes on and on and on and on and on and on and on"}}}}'
  WHEN 'view' THEN '{{"msgid":"m' || CAST(event_id AS STRING) || '","from":"u' || CAST(user_id AS STRING) || '","roomid":"r1","msgtype":"file","file":{{"filename":"f' || CAST(event_id AS STRING) || '.pdf","filesize":7}}}}'
  WHEN 'signup' THEN '{{"msgid":"m' || CAST(event_id AS STRING) || '","from":"u' || CAST(user_id AS STRING) || '","msgtype":"voice","voice":{{"play_length":' || CAST(event_id % 60 AS STRING) || '}}}}'
  WHEN 'purchase' THEN '{{"msgid":"m' || CAST(event_id AS STRING) || '","from":"u' || CAST(user_id AS STRING) || '","action":"recall","pre_msgid":"x","msgtype":"text"}}'
  ELSE '{{"msgid":"m' || CAST(event_id AS STRING) || '","from":"u' || CAST(user_id AS STRING) || '","msgtype":"todo","todo":{{"a":1}}}}' END AS raw_data FROM {events}"""
DIMENSION = "SELECT c_custkey AS entry_id, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'success' WHEN 2 THEN 'failed' ELSE 'unresolvable' END AS sync_status, c_custkey % 8 AS fail_count, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST('2024-01-30 12:00:00' AS TIMESTAMP) END AS last_attempt_at FROM {customer}"
DIMENSION_SPARK = DIMENSION.replace("AS TIMESTAMP", "AS TIMESTAMP_NTZ")
LOOKUPS = "SELECT c_custkey AS entry_id, c_custkey % 3 = 0 AS ok, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' || c_name END AS name FROM {customer} WHERE c_custkey % 5 < 3"
CACHE = "SELECT 'u' || CAST(s_suppkey AS STRING) AS userid, CASE WHEN s_suppkey % 3 = 0 THEN '未知' ELSE s_name END AS name FROM {supplier}"
CONFIGS = """SELECT CAST(n_nationkey AS BIGINT) AS config_id, CAST(CAST(floor(n_nationkey / 2) AS BIGINT) AS BIGINT) AS enterprise_id, CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE 1 END AS enabled,
  '["r' || CAST(n_nationkey AS STRING) || '",{{"id":"r' || CAST(n_nationkey % 4 AS STRING) || '","name":"x"}}]' AS rooms, '["u' || CAST(n_nationkey AS STRING) || '"]' AS users FROM {nation}"""
GROUPS = "SELECT 'r' || CAST(p_partkey % 30 AS STRING) AS roomid, CASE WHEN p_partkey % 3 = 0 THEN '出单 tz-' || CAST(p_partkey % 40 AS STRING) WHEN p_partkey % 3 = 1 THEN '出单TZ0' || CAST(p_partkey % 40 AS STRING) ELSE p_name END AS name FROM {part}"
ENTERPRISES = "SELECT CAST(n_nationkey AS BIGINT) AS enterprise_id, CASE WHEN n_nationkey % 2 = 0 THEN 'TZ-' ELSE 'tz' END || CAST(n_nationkey AS STRING) AS enterprise_no FROM {nation}"
TALK = "SELECT conv_id * 100 + turn AS message_id, 'r' || CAST(conv_id % 20 AS STRING) AS roomid, role AS sender, text FROM {conversations}"
COMMANDS = "SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN '发送台账 今天' WHEN 1 THEN '发送台账本月' WHEN 2 THEN '发送台账6月' || CAST(1 + event_id % 35 AS STRING) || '日' WHEN 3 THEN '发送台账6月1日到' || CAST(event_id % 33 AS STRING) || '日' WHEN 4 THEN '发送台账2023年12月25日到2024年1月' || CAST(1 + event_id % 9 AS STRING) || '日' WHEN 5 THEN '发送台账' || CAST(event_id % 20 AS STRING) || '-' || CAST(event_id % 31 AS STRING) || '日' ELSE '台账' END AS text FROM {events}"
RULES = [{"target": "de", "keywords": ["de"], "value_type": "text"}, {"target": "the", "keywords": ["the", "The"], "value_type": "text"}, {"target": "off", "keywords": ["of"], "enabled": False}]


def _candidate():
    return (F.col("msgtype") == "file") | (F.col("value") > 150)


def _named(s, d):
    return messages(s, d).withColumn("filename", F.concat("msgtype", F.when(F.col("id") % 3 == 0, F.lit(".PDF")).otherwise(F.lit(".doc"))))


def _scope(s, d):
    return m.monitored(messages(s, d), view(s, d, CONFIGS))


QUERIES = {
    "M1_envelopes": lambda s, d: m.parse_envelopes(view(s, d, ENVELOPES)).select("id", "msgid", "action", "sender", "roomid", "msgtype", "type_name", "summary", F.element_at("content", F.lit("filename")).alias("filename")),
    "M2_first_of_sequence": lambda s, d: m.first_of_sequence(messages(s, d)).select("id", "corpid", "seq"),
    "M3_conversations": lambda s, d: m.conversations(messages(s, d)),
    "M3_by_keyword": lambda s, d: m.conversations(messages(s, d), "u1", view(s, d, ROOMS)).unionByName(m.conversations(messages(s, d), "R", view(s, d, ROOMS))).select("conversation", "n").distinct(),
    "M4_search": lambda s, d: m.search(messages(s, d), kinds=["text", "file"], room="r3", keyword='"k": 8', page=1, size=20).select("id", "msgtype", "roomid"),
    "M5_type_counts": lambda s, d: m.type_counts(messages(s, d)),
    "M6_recent": lambda s, d: m.recent(messages(s, d), 25).select("id", "msgtype"),
    "M7_discover": lambda s, d: m.discover(messages(s, d), view(s, d, CACHE).where("userid like '%7'"), view(s, d, CACHE)),
    "M8_work_list": lambda s, d: m.work_list(view(s, d, DIMENSION_SPARK), NOW, limit=200).select("entry_id", "sync_status"),
    "M9_lookups": lambda s, d: m.apply_lookups(view(s, d, DIMENSION_SPARK), view(s, d, LOOKUPS), NOW),
    "M10_status_counts": lambda s, d: m.status_counts(view(s, d, DIMENSION_SPARK)),
    "M11_monitored": _scope,
    "M12_missed_files": lambda s, d: m.missed_files(_named(s, d), _scope(s, d), records(s, d).where("id % 4 = 0"), NOW, 10).select("id", "seq"),
    "M12_stuck": lambda s, d: m.stuck(records(s, d), "2001-07-01 00:00:00").select("id", "created_at"),
    "M13_bound": lambda s, d: m.bound(messages(s, d), messages(s, d).where("msgtype = 'voice'")).select("id", "roomid", "sender"),
    "M14_eligible": lambda s, d: m.eligible(view(s, d, TALK), ["stupid", "worthless", "the a"], "The", "assist").select("message_id"),
    "M15_quotes": lambda s, d: m.parse_quotes(view(s, d, "SELECT o_orderkey AS id, '京A-' || lpad(CAST(o_custkey AS STRING), 5, '0') || CASE WHEN o_orderkey % 2 = 0 THEN ' 商业' || CAST(o_orderkey % 30 AS STRING) || ' 交强：4' ELSE ' hello' END || CASE WHEN o_orderkey % 3 = 0 THEN ' 13480707210 小张' ELSE '' END AS text FROM {orders}")).select("id", "plate", *[F.element_at("fields", F.lit(k)).alias(a) for k, a in (("政策商业险", "commercial"), ("政策强险", "compulsory"), ("电话", "phone"), ("业务渠道", "channel"))]),
    "M17_plates": lambda s, d: view(s, d, "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'x 京 A-' || lpad(CAST(o_custkey AS STRING), 5, '0') || ' y' WHEN 1 THEN '车牌号: AB ' || CAST(o_custkey AS STRING) || ' 123456789' WHEN 2 THEN '车牌号是多少' ELSE 'none' END AS text FROM {orders}").select("id", m.extract_plate(F.col("text")).alias("plate")),
    "M18_apply_quotes": lambda s, d: m.apply_quotes(records(s, d), view(s, d, "SELECT o_orderkey AS message_id, 'r' || CAST(o_custkey % 20 AS STRING) AS roomid, '京A' || lpad(CAST(o_custkey AS STRING), 6, '0') AS plate, CAST(o_orderkey AS STRING) AS fields FROM {orders} WHERE o_orderkey % 3 = 0")),
    "M19_commands": lambda s, d: m.ledger_commands(view(s, d, COMMANDS), "2024-01-17"),
    "M20_groups": lambda s, d: m.classify_groups(view(s, d, GROUPS), view(s, d, ENTERPRISES), view(s, d, CONFIGS)),
    "M21_notices": lambda s, d: m.room_notices(messages(s, d), view(s, d, "SELECT 'r' || CAST(n_nationkey AS STRING) AS roomid FROM {nation} WHERE n_nationkey % 2 = 0"), _candidate()),
    "M22_directory": lambda s, d: m.directory(messages(s, d), view(s, d, ROOMS), view(s, d, CACHE)),
}

_CONV = "CASE WHEN roomid <> '' THEN roomid ELSE least(sender, receiver) || '|' || greatest(sender, receiver) END"
_PEERS = "min(CASE WHEN coalesce(roomid, '') = '' THEN least(sender, receiver) || ',' || greatest(sender, receiver) END)"
_SCOPE = "SELECT id, CAST(config_id AS BIGINT) AS config_id FROM messages m JOIN (SELECT n_nationkey AS config_id, 'r' || n_nationkey AS roomid FROM nation WHERE n_nationkey % 6 <> 0 UNION SELECT n_nationkey, 'r' || (n_nationkey % 4) FROM nation WHERE n_nationkey % 6 <> 0) USING (roomid) UNION ALL SELECT id, n_nationkey FROM messages JOIN nation ON sender = 'u' || n_nationkey WHERE roomid = '' AND n_nationkey % 6 <> 0"

ORACLE_SQL = {
    "M1_envelopes": sql("""SELECT event_id AS id, 'm' || event_id AS msgid, CASE WHEN event_type = 'purchase' THEN 'recall' ELSE 'send' END AS action, 'u' || user_id AS sender, CASE WHEN event_type = 'view' THEN 'r1' ELSE '' END AS roomid,
      CASE event_type WHEN 'click' THEN 'text' WHEN 'purchase' THEN 'text' WHEN 'view' THEN 'file' WHEN 'signup' THEN 'voice' ELSE 'todo' END AS msgtype, CASE event_type WHEN 'click' THEN '文本' WHEN 'purchase' THEN '文本' WHEN 'view' THEN '文件' WHEN 'signup' THEN '语音' ELSE '待办' END AS type_name,
      CASE event_type WHEN 'click' THEN substr('text of ' || event_id || ' goes on and on and on and on and on and on and on', 1, 50) WHEN 'purchase' THEN '撤回了一条消息' WHEN 'view' THEN '[文件] f' || event_id || '.pdf' WHEN 'signup' THEN '[语音 ' || (event_id % 60) || '秒]' ELSE '[待办]' END AS summary, CASE WHEN event_type = 'view' THEN 'f' || event_id || '.pdf' END AS filename FROM events"""),
    "M2_first_of_sequence": sql("SELECT min(id) AS id, corpid, seq FROM messages GROUP BY corpid, seq"),
    "M3_conversations": sql(f"SELECT {_CONV} AS conversation, count(*) AS n, max(sent_at) AS last_at, arg_max(msgtype, id) AS last_type, max(id) AS last_id, count(DISTINCT sender) AS senders, {_PEERS} AS peers FROM messages GROUP BY 1"),
    "M3_by_keyword": sql(f"SELECT conversation, n FROM (SELECT {_CONV} AS conversation, count(*) AS n FROM messages GROUP BY 1) LEFT JOIN rooms ON roomid = conversation WHERE contains(conversation, 'u1') OR contains(coalesce(room_name, ''), 'R')", rooms=ROOMS),
    "M4_search": sql("SELECT id, msgtype, roomid FROM messages WHERE msgtype IN ('text', 'file') AND roomid = 'r3' AND contains(props, '\"k\": 8') ORDER BY id DESC LIMIT 20"),
    "M5_type_counts": sql("SELECT corpid, msgtype, count(*) AS n FROM messages GROUP BY ROLLUP (corpid, msgtype)"),
    "M6_recent": sql("SELECT id, msgtype FROM messages ORDER BY id DESC LIMIT 25"),
    "M7_discover": sql("SELECT DISTINCT sender AS userid, CASE WHEN name = '未知' THEN '' ELSE coalesce(name, '') END AS name, 'user' AS kind FROM messages LEFT JOIN cache ON userid = sender WHERE sender NOT IN (SELECT userid FROM cache WHERE userid LIKE '%7')", cache=CACHE),
    "M8_work_list": sql("SELECT entry_id, sync_status FROM dim WHERE NOT ((sync_status = 'unresolvable' OR fail_count >= 5) AND coalesce(last_attempt_at > TIMESTAMP '2024-01-30 00:00:00', false)) ORDER BY last_attempt_at NULLS FIRST, entry_id LIMIT 200", dim=DIMENSION),
    "M9_lookups": sql(f"SELECT d.entry_id, CASE WHEN ok THEN l.name ELSE d.name END AS name, CASE WHEN ok THEN 'success' WHEN NOT ok THEN 'failed' ELSE sync_status END AS sync_status, CASE WHEN ok THEN 0 WHEN NOT ok THEN fail_count + 1 ELSE fail_count END AS fail_count, CASE WHEN ok IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE last_attempt_at END AS last_attempt_at, CASE WHEN ok AND l.name IS DISTINCT FROM d.name THEN TIMESTAMP '{NOW}' END AS renamed_at FROM dim d LEFT JOIN l USING (entry_id)", dim=DIMENSION, l=LOOKUPS),
    "M10_status_counts": sql("SELECT sync_status, count(*) AS n FROM dim GROUP BY 1", dim=DIMENSION),
    "M11_monitored": sql(_SCOPE),
    "M12_missed_files": sql(f"SELECT id, seq FROM messages WHERE msgtype = 'file' AND id % 3 = 0 AND sent_at >= TIMESTAMP '2024-01-21 00:00:00' AND id IN (SELECT id FROM ({_SCOPE})) AND seq NOT IN (SELECT msg_seq FROM records WHERE id % 4 = 0)"),
    "M12_stuck": sql("SELECT id, created_at FROM records WHERE status = 'pending' AND created_at < TIMESTAMP '2001-06-30 23:30:00'"),
    "M13_bound": sql("SELECT id, roomid, sender FROM messages WHERE msgtype IN ('image', 'text') AND (roomid, sender) IN (SELECT (roomid, sender) FROM messages WHERE msgtype = 'voice')"),
    "M14_eligible": sql("SELECT message_id FROM talk WHERE NOT (contains(text, 'stupid') OR contains(text, 'worthless') OR contains(text, 'the a') OR text LIKE 'The%' OR sender LIKE 'assist%')", talk=TALK),
    "M15_quotes": sql("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '京A' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') END AS plate, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 30 AS VARCHAR) END AS commercial, CASE WHEN o_orderkey % 2 = 0 THEN '4' END AS compulsory, CASE WHEN o_orderkey % 6 = 0 THEN '13480707210' END AS phone, CASE WHEN o_orderkey % 6 = 0 THEN '小张' END AS channel FROM orders"),
    "M17_plates": sql("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '京A' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') WHEN 1 THEN 'AB' || CAST(o_custkey AS VARCHAR) END AS plate FROM orders"),
    "M18_apply_quotes": sql("SELECT id, r.roomid, r.k, fields FROM (SELECT *, row_number() OVER (PARTITION BY roomid, k ORDER BY id DESC) AS place FROM (SELECT *, CASE WHEN plate_no IN ('', '新车') THEN NULL ELSE replace(plate_no, '-', '') END AS k FROM records WHERE deleted = 0 AND status IN ('done', 'success') AND roomid <> '') WHERE k IS NOT NULL) r JOIN (SELECT 'r' || (o_custkey % 20) AS roomid, '京A' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS k, CAST(max(o_orderkey) AS VARCHAR) AS fields FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2) q USING (roomid, k) WHERE place <= 10"),
    "M19_commands": sql("""SELECT id, CASE WHEN ok THEN label END AS label, CASE WHEN ok THEN first_day END AS first_day, CASE WHEN ok THEN last_day + 1 END AS end_day, text FROM (SELECT *, coalesce(last_day >= first_day, false) AS ok FROM (
      SELECT id, text, CASE k WHEN 0 THEN '今日' WHEN 1 THEN '本月' WHEN 2 THEN '6月' || (1 + id % 35) || '日' WHEN 3 THEN '6月1日-' || (id % 33) || '日' WHEN 4 THEN '12月25日-1月' || (1 + id % 9) || '日' WHEN 5 THEN '1月' || (id % 20) || '日-' || (id % 31) || '日' END AS label,
      CASE k WHEN 0 THEN DATE '2024-01-17' WHEN 1 THEN DATE '2024-01-01' WHEN 2 THEN CASE WHEN id % 35 < 30 THEN DATE '2024-06-01' + CAST(id % 35 AS INT) END WHEN 3 THEN DATE '2024-06-01' WHEN 4 THEN DATE '2023-12-25' WHEN 5 THEN CASE WHEN id % 20 > 0 THEN DATE '2023-12-31' + CAST(id % 20 AS INT) END END AS first_day,
      CASE k WHEN 0 THEN DATE '2024-01-17' WHEN 1 THEN DATE '2024-01-31' WHEN 2 THEN CASE WHEN id % 35 < 30 THEN DATE '2024-06-01' + CAST(id % 35 AS INT) END WHEN 3 THEN CASE WHEN id % 33 BETWEEN 1 AND 30 THEN DATE '2024-05-31' + CAST(id % 33 AS INT) END WHEN 4 THEN DATE '2024-01-01' + CAST(id % 9 AS INT) WHEN 5 THEN CASE WHEN id % 31 > 0 THEN DATE '2023-12-31' + CAST(id % 31 AS INT) END END AS last_day
      FROM (SELECT *, id % 7 AS k FROM c)))""", c=COMMANDS),
    "M20_groups": sql("""SELECT roomid, name, g.code, t.enterprise_id, config_id, CASE WHEN g.code IS NULL THEN 'none' WHEN t.enterprise_id IS NULL THEN 'no_enterprise' WHEN roomid = 'r' || config_id THEN 'already' ELSE 'will_add' END AS outcome
      FROM (SELECT *, CASE WHEN dig <> '' AND contains(name, '出单') THEN 'TZ' || CASE WHEN length(dig) < 3 THEN lpad(dig, 3, '0') ELSE dig END END AS code FROM (SELECT *, regexp_extract(name, '(?i)TZ-?(\\d+)', 1) AS dig FROM groups)) g
      LEFT JOIN (SELECT 'TZ' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS code, CAST(n_nationkey AS BIGINT) AS enterprise_id FROM nation) t ON t.code = g.code LEFT JOIN (SELECT CAST(n_nationkey // 2 AS BIGINT) AS enterprise_id, CAST(max(n_nationkey) AS BIGINT) AS config_id FROM nation WHERE n_nationkey % 6 <> 0 GROUP BY 1) c ON c.enterprise_id = t.enterprise_id""", groups=GROUPS),
    "M21_notices": sql("SELECT roomid, sent_day, min(id) AS id FROM messages WHERE roomid <> '' AND (msgtype = 'file' OR value > 150) AND roomid NOT IN (SELECT 'r' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 1, 2"),
    "M22_directory": sql("SELECT kind, key, coalesce(NULLIF(room_name, ''), NULLIF(name, ''), key) AS name FROM (SELECT DISTINCT CASE WHEN roomid <> '' THEN 'room' ELSE 'user' END AS kind, CASE WHEN roomid <> '' THEN roomid ELSE sender END AS key FROM messages) LEFT JOIN rooms ON roomid = key LEFT JOIN cache ON userid = key", rooms=ROOMS, cache=CACHE),
}
