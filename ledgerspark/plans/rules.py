"""Registered queries of configured columns, sources and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import rules as r
from ledgerspark.operators import fill
from ledgerspark.plans.analytics import CENTS, CLASS, sql
from ledgerspark.plans.ledger import FILLED, LABEL, PLATE, POOLED, VIN
from ledgerspark.plans.proxies import MESSAGES, base, messages, records, view
from ledgerspark.sources import buckets, cursor
from ledgerspark.sources import tables as src
from ledgerspark.sources.shared import new_folder
from ledgerspark.streaming import jobs

ALIASES = {"company_short": {"1-URGENT": "甲", "URGENT": "x", "MEDIUM": "乙", "NOT": "丙", "NOT SPECIFIED": "丁"}}
FORMULAS = [
    {"target": "净额", "expr": "保费 × 0.8 - 手续费 ÷ 3"},
    {"target": "合计", "company": "URGENT", "expr": "(净额 + 保费) / 分母 + 缺失字段"},
    {"target": "净率", "product": "机动车商业保险", "expr": "-(2 - 5) * 1.5 + .25"},
]
RATIOS = [
    {"target": "比例", "company": "HIGH", "branches": [{"conditions": [{"field": "policy_type", "op": "contains", "value": "商业"}, {"field": "total_premium", "op": "ge", "value": 2000}], "value": 0.2}, {"conditions": [{"type": "related", "column": "related", "op": "exists"}], "value": 0.15}], "default": 0.1},
    {"target": "比例", "product": "家财险", "branches": [], "default": 0.3},
]
CONFIGS = "SELECT o_orderkey AS config_id, 'k' || CAST(o_custkey % 20 AS STRING) AS config_key, CASE o_orderkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'enterprise' WHEN 2 THEN 'global' ELSE 'other' END AS scope, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS active, CAST(o_orderkey AS STRING) AS value FROM {orders}"
TARGET = "SELECT 'C' || CAST(c_custkey AS STRING) AS k, c_name AS name, CAST(c_nationkey AS STRING) AS city FROM {customer} WHERE c_custkey % 3 = 0"
INCOMING = "SELECT ' C' || CAST(c_custkey AS STRING) || ' ' AS k, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'new' || c_name END AS name, CAST(NULL AS STRING) AS city FROM {customer} WHERE c_custkey % 2 = 0"
TYPED = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '1,234.50元' WHEN 1 THEN '¥7' WHEN 2 THEN 'abc' ELSE '-5.25' END AS a, CASE o_orderkey % 3 WHEN 0 THEN '2026/6/3' WHEN 1 THEN 'none' ELSE '2026年12月31日' END AS d, CASE o_orderkey % 3 WHEN 0 THEN '12.5%' WHEN 1 THEN '3' ELSE '100%' END AS p FROM {orders}"


def _formula_rows(s, d):
    rows = records(s, d).withColumns({"保费": F.col("total_premium"), "手续费": F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), (F.col("id") % 100).cast("string"), F.lit("元"))), "分母": (F.col("id") % 4).cast("string")})
    return r.apply_formulas(rows, FORMULAS, ["保费", "手续费", "分母"])


def _ratio_rows(s, d):
    rows = records(s, d).withColumn("related", F.col("id") % 3 == 0)
    value = r.ratio(RATIOS, "比例", {c: F.col(c) for c in ("policy_type", "total_premium", "related")}, F.col("company_short"), F.col("policy_type"))
    return rows.select("id", value.alias("ratio"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the events table as a stream of files."""
    schema = base(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    made = spark.sql(MESSAGES, events=events)
    return made.withColumn("sent_at", F.col("sent_at").cast("timestamp"))


def run(df: DataFrame) -> DataFrame:
    """Run a stream over what there is, into a folder of the cluster's shared checkpoint folder, and read the result."""
    spark, out = df.sparkSession, new_folder(df.sparkSession, "stream")
    df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def _devices(s, d):
    return messages(s, d).select(F.col("sender").alias("device"), F.when(F.col("msgtype") == "other", "offline").otherwise("online").alias("kind"), F.col("sent_at").alias("at"))


def _talk(s, d):
    return stream(s, d).where("roomid != '' and msgtype in ('text', 'file')").select("roomid", F.col("sender").alias("plate"), F.when(F.col("msgtype") == "file", "policy").otherwise("text").alias("kind"), F.col("sent_at").alias("at"), F.create_map(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")), F.col("id").cast("string")).alias("fields"))


def _pulled(s, d):
    """The messages of the events table, written as a log in the shared folder and pulled from behind a cursor as a stream."""
    log = new_folder(s, "log")
    rows = messages(s, d).select("corpid", "seq", "id", "msgtype", "sent_at")
    cursor.append_messages(rows, log)
    found = cursor.message_stream(s, log, rows.schema, after='{"corp0": 500, "corp1": 800}', limit="20000")
    return run(found).select("corpid", "seq", "id", "msgtype")


def _kept(s, d):
    """The target as a table in buckets, after the incoming rows came in three batches, one of them twice."""
    table = buckets.BucketTable(s, new_folder(s, "target"), "k", 16)
    table.create(view(s, d, TARGET))
    rows = view(s, d, INCOMING).withColumn("number", F.pmod(F.xxhash64("k"), F.lit(3)))
    for number in (0, 1, 1, 2):
        table.upsert(rows.where(F.col("number") == number).drop("number"), lambda target, batch: src.upsert(target, batch, "k").drop("outcome"), number)
    return table.read()


def _exported(s, d):
    """A tenant's ledger with blanks filled from all its records, and with columns by configuration."""
    complete = lambda rows, everything: fill.fill_by_pools(everything).join(rows.select("id"), "id", "left_semi")
    columns = lambda rows: r.split_premium(r.fixed_values(rows, {"salesperson": "无"}))
    return src.export_ledger(records(s, d), 7, "1999-01-01", "2000-01-01", complete=complete, columns=columns).select("id", "plate_no", "vin", "owner", "id_number", "salesperson", F.col("商业险保费").alias("commercial"))


QUERIES = {
    "C1_scopes": lambda s, d: r.resolve_scope(view(s, d, CONFIGS), ["own", "enterprise", "global"], active="active").select("config_key", "config_id", "scope"),
    "C2_aliases": lambda s, d: r.apply_aliases(records(s, d).withColumn("manual_fields", F.when(F.col("id") % 10 == 0, F.array(F.lit("company_short")))), ALIASES, "manual_fields").select("id", "company_short", r.quick_class(F.col("policy_type")).alias("label")),
    "C3_dates": lambda s, d: records(s, d).select("id", r.format_date(F.date_format("start_date", "yyyy年M月d日"), "YYYY/MM/DD", False).alias("short"), r.format_date(F.concat(F.col("start_date").cast("string"), F.lit("11:16")), "YYYY-MM-DD HH:mm").alias("long"), r.format_date(F.lit("none"), "YYYY").alias("bad")),
    "C4_fixed": lambda s, d: r.fixed_values(records(s, d), {"salesperson": "无", "insured": "?"}).select("id", "salesperson", "insured"),
    "C5_percents": lambda s, d: records(s, d).select("id", F.round(r.percent_to_number(F.concat((F.col("id") % 400 / 4).cast("string"), F.when(F.col("id") % 2 == 0, "%").otherwise(""))), 6).alias("number"), r.number_to_percent(F.col("id") % 400 / 400).alias("percent")),
    "C6_ratios": _ratio_rows,
    "C7_formulas": lambda s, d: _formula_rows(s, d).select("id", F.col("净额").alias("net"), F.col("合计").alias("total"), F.col("净率").alias("rate")),
    "C8_split_premium": lambda s, d: r.split_premium(records(s, d)).select("id", F.col("交强险保费").alias("compulsory"), F.col("商业险保费").alias("commercial"), F.col("非车险保费").alias("other")),
    "C9_finish": lambda s, d: r.finish(records(s, d), "URGENT").select("id", "plate_no", "applicant"),
    "S1_read": lambda s, d: src.read(s, f"{d}/customer.parquet"),
    "S2_pull": lambda s, d: src.pull(messages(s, d), 500, 300, "id")[0].select("id", "seq"),
    "S2_cursor": lambda s, d: src.pull_all(messages(s, d), 500, "id").agg(src.pull(messages(s, d), 500, 300, "id")[1].alias("cursor"), F.count(F.lit(1)).alias("n")),
    "S2_stream": _pulled,
    "S3_copy_new": lambda s, d: src.copy_new(messages(s, d), messages(s, d).where("id % 10 = 0"), ["corpid", "seq"], "id").select("id", "corpid", "seq"),
    "S3_copy_counts": lambda s, d: src.copy_counts(messages(s, d), messages(s, d).where("id % 10 = 0"), ["corpid", "seq"]),
    "S3_replace_latest": lambda s, d: src.replace_latest(messages(s, d).where("id % 2 = 0").select("sender", "id", "msgtype"), messages(s, d).where("id % 2 = 1").select("sender", "id", "msgtype"), "sender", "id"),
    "S4_export": lambda s, d: src.export_ledger(records(s, d), 7, "1999-01-01", "2000-01-01").select("id", "policy_no", "plate_no"),
    "S4_export_merged": lambda s, d: src.export_ledger(records(s, d), 7, "1999-01-01", "2000-01-01", True).select("car", "n_records", "commercial_cents", "compulsory_cents", "other_cents"),
    "S4_export_completed": _exported,
    "S5_upsert": lambda s, d: src.upsert(view(s, d, TARGET), view(s, d, INCOMING), "k"),
    "S5_bucket_table": _kept,
    "S6_known_keys": lambda s, d: src.known_keys(view(s, d, INCOMING), view(s, d, TARGET), "k"),
    "S7_restore_types": lambda s, d: src.restore_types(view(s, d, TYPED), ["a"], ["d"], ["p"]).select("id", F.col("a").cast("double").alias("a"), "d", F.col("p").cast("double").alias("p")),
    "ST1_ingest": lambda s, d: run(jobs.ingest(stream(s, d)).select("id", "corpid", "seq")).select("corpid", "seq"),
    "ST2_match_pending": lambda s, d: run(jobs.match_pending(stream(s, d).where("msgtype = 'text' and roomid != ''").select("roomid", F.col("sender").alias("plate"), F.col("sent_at").alias("text_at"), F.col("id").alias("text_id")), stream(s, d).where("msgtype = 'file' and roomid != ''").select("roomid", F.col("sender").alias("plate"), F.col("sent_at").alias("policy_at"), F.col("id").alias("record_id")))).select("text_id", "record_id"),
    "ST2_grace": lambda s, d: run(jobs.match_with_grace(stream(s, d).where("roomid != '' and msgtype in ('text', 'file')").select("roomid", F.lit("京A1").alias("plate"), "sender", F.when(F.col("msgtype") == "file", "policy").otherwise("text").alias("kind"), F.col("sent_at").alias("at"), F.col("id").alias("record_id"), F.create_map(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")), F.col("id").cast("string")).alias("fields")))),
    "ST5_first_notice": lambda s, d: run(jobs.first_notice(stream(s, d), F.col("msgtype") == "file").select("roomid", F.to_date("sent_at").alias("sent_day"))),
    "ST3_miss_alerts": lambda s, d: run(jobs.miss_alerts(_talk(s, d))),
    "ST4_assemble": lambda s, d: run(jobs.assemble(stream(s, d).select(F.coalesce("roomid", F.lit("")).alias("roomid"), "sender", F.element_at(F.create_map(*[F.lit(x) for x in ("text", "licence", "file", "id_front", "image", "id_back", "voice", "text", "other", "text")]), F.col("msgtype")).alias("kind"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("n"), (F.col("id") % 4).cast("string"))).alias("owner"), F.col("sent_at").alias("at")), wait_s=6 * 3600)),
    "ST6_offline_alerts": lambda s, d: run(jobs.offline_alerts(stream(s, d).select("id", F.col("sender").alias("device"), F.when(F.col("msgtype") == "other", "offline").otherwise("online").alias("kind"), F.col("sent_at").alias("at")))),
    "ST6_offline_spans": lambda s, d: jobs.offline_spans(_devices(s, d)).select("device", "away_at", "seconds"),
    "ST7_hourly_counts": lambda s, d: run(jobs.hourly_counts(stream(s, d))).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "msgtype", "n"),
}

_N = "coalesce(TRY_CAST(NULLIF(regexp_replace({0}, '[^0-9.]', '', 'g'), '') AS DOUBLE), 0)"
_TXT = "CASE WHEN {0} IS NULL THEN '' WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {0}) END"
_NET = f"floor(({_N.format('total_premium')} * 0.8::DOUBLE - fee / 3) * 100) / 100"

ORACLE_SQL = {
    "C1_scopes": sql("SELECT config_key, config_id, scope FROM (SELECT *, row_number() OVER (PARTITION BY config_key ORDER BY list_position(['own', 'enterprise', 'global'], scope), active DESC, config_id DESC) AS k FROM configs WHERE scope <> 'other') WHERE k = 1", configs=CONFIGS),
    "C2_aliases": sql(f"SELECT id, CASE WHEN id % 10 = 0 THEN company_short WHEN company_short = '1-URGENT' THEN '甲' WHEN contains(company_short, 'NOT SPECIFIED') THEN '丁' WHEN contains(company_short, 'URGENT') THEN 'x' WHEN contains(company_short, 'MEDIUM') THEN '乙' WHEN contains(company_short, 'NOT') THEN '丙' ELSE company_short END AS company_short, CASE {CLASS} WHEN 'compulsory' THEN '交强险' WHEN 'commercial' THEN '商业险' ELSE '非车险' END AS label FROM records"),
    "C3_dates": sql("SELECT id, year(start_date) || '/' || month(start_date) || '/' || day(start_date) AS short, CAST(start_date AS VARCHAR) || ' 11:16' AS long, 'none' AS bad FROM records"),
    "C4_fixed": sql("SELECT id, coalesce(NULLIF(salesperson, ''), '无') AS salesperson, coalesce(NULLIF(insured, ''), '?') AS insured FROM records"),
    "C5_percents": sql("SELECT id, round((id % 400) / 400.0::DOUBLE, 6) AS number, regexp_replace(regexp_replace(printf('%.4f', (id % 400) / 4.0::DOUBLE), '0+$', ''), '\\.$', '') || '%' AS percent FROM records"),
    "C6_ratios": sql(f"SELECT id, CASE WHEN policy_type IN ('家财险', '') THEN '0.3' WHEN company_short = '' OR contains(company_short, 'HIGH') THEN CASE WHEN policy_type LIKE '%商业%' AND coalesce({CENTS}, 0) >= 200000 THEN '0.2' WHEN id % 3 = 0 THEN '0.15' ELSE '0.1' END END AS ratio FROM records"),
    "C7_formulas": sql(f"""SELECT id, {_TXT.format('net')} AS net, CASE WHEN company_short = '' OR contains(company_short, 'URGENT') THEN {_TXT.format('total')} END AS total, CASE WHEN policy_type IN ('', '机动车商业保险') THEN '4.75' END AS rate
      FROM (SELECT *, CASE WHEN id % 4 <> 0 THEN floor((({_N.format(_TXT.format('net'))} + {_N.format('total_premium')}) / (id % 4)) * 100) / 100 END AS total FROM (SELECT *, {_NET} AS net FROM (SELECT *, CASE WHEN id % 5 = 0 THEN 0 ELSE id % 100 END AS fee FROM records)))"""),
    "C8_split_premium": sql(f"SELECT id, " + ", ".join(f"CASE WHEN {CLASS} IN ({k}) THEN total_premium ELSE '0' END AS {v}" for k, v in (("'compulsory'", "compulsory"), ("'commercial'", "commercial"), ("'accident', 'non_vehicle'", "other"))) + " FROM records"),
    "C9_finish": sql("SELECT id, plate_no, coalesce(NULLIF(applicant, ''), insured) AS applicant FROM (SELECT id, applicant, insured, CASE WHEN contains(company_short, 'URGENT') AND plate_no LIKE '京A%' THEN '京A-' || substr(replace(plate_no, '-', ''), 3) ELSE plate_no END AS plate_no FROM records)"),
    "S1_read": sql("SELECT * FROM customer"),
    "S2_pull": sql("SELECT id, seq FROM messages WHERE id > 500 ORDER BY id LIMIT 300"),
    "S2_cursor": sql("SELECT max(id) AS cursor, count(*) AS n FROM messages WHERE id > 500"),
    "S2_stream": sql("SELECT corpid, seq, id, msgtype FROM messages WHERE seq > CASE corpid WHEN 'corp0' THEN 500 WHEN 'corp1' THEN 800 ELSE 0 END"),
    "S3_copy_new": sql("SELECT min(id) AS id, corpid, seq FROM messages m WHERE NOT EXISTS (SELECT 1 FROM messages t WHERE t.id % 10 = 0 AND t.corpid = m.corpid AND t.seq = m.seq) GROUP BY corpid, seq"),
    "S3_copy_counts": sql("SELECT CAST(total AS BIGINT) AS total, CAST(ins AS BIGINT) AS inserted, CAST(total - ins AS BIGINT) AS skipped FROM (SELECT (SELECT count(*) FROM messages) AS total, (SELECT count(*) FROM (SELECT DISTINCT corpid, seq FROM messages EXCEPT SELECT DISTINCT corpid, seq FROM messages WHERE id % 10 = 0)) AS ins)"),
    "S3_replace_latest": sql("SELECT sender, id, msgtype FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY id % 2, id DESC) AS k FROM messages) WHERE k = 1"),
    "S4_export": sql("SELECT id, policy_no, plate_no FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN policy_no <> '' THEN policy_no ELSE '#' || id END, created_day ORDER BY id DESC) AS k FROM records WHERE deleted = 0 AND enterprise_id = 7 AND status IN ('done', 'success') AND is_abnormal = 0 AND doc_category = '保单' AND created_day >= DATE '1999-01-01' AND created_day < DATE '2000-01-01') WHERE k = 1"),
    "S4_export_merged": sql(f"""SELECT car, count(*) AS n_records, {", ".join(f"CAST(coalesce(sum(cents) FILTER (k2 = 1 AND label = '{k}'), 0) AS BIGINT) AS {v}_cents" for k, v in (("商业险", "commercial"), ("交强险", "compulsory"), ("非车险", "other")))} FROM (SELECT *, row_number() OVER (PARTITION BY car, coalesce(NULLIF(policy_no, ''), '#' || id) ORDER BY id) AS k2 FROM (
      SELECT *, coalesce({PLATE}, 'vin:' || ({VIN}), '#' || CAST(id AS VARCHAR)) AS car, {LABEL} AS label, {CENTS} AS cents FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN policy_no <> '' THEN policy_no ELSE '#' || id END, created_day ORDER BY id DESC) AS k FROM records WHERE deleted = 0 AND enterprise_id = 7 AND status IN ('done', 'success') AND is_abnormal = 0 AND doc_category = '保单' AND created_day >= DATE '1999-01-01' AND created_day < DATE '2000-01-01') WHERE k = 1)) GROUP BY car"""),
    "S4_export_completed": sql(
        f"""SELECT e.id, e.plate_no, e.vin, e.owner, e.id_number, coalesce(NULLIF(salesperson, ''), '无') AS salesperson, CASE WHEN {CLASS} = 'commercial' THEN total_premium ELSE '0' END AS commercial FROM ({POOLED}) e JOIN records r ON r.id = e.id
      WHERE e.id IN (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN policy_no <> '' THEN policy_no ELSE '#' || id END, created_day ORDER BY id DESC) AS k FROM blanked WHERE status IN ('done', 'success') AND is_abnormal = 0 AND doc_category = '保单' AND created_day >= DATE '1999-01-01' AND created_day < DATE '2000-01-01') WHERE k = 1)""",
        blanked="SELECT * FROM records WHERE deleted = 0 AND enterprise_id = 7", filled=FILLED,
    ),
    "S5_upsert": sql("SELECT coalesce(t.k, i.k) AS k, coalesce(i.name, t.name) AS name, t.city AS city, CASE WHEN t.k IS NULL THEN 'inserted' WHEN i.k IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM t FULL JOIN (SELECT trim(k) AS k, NULLIF(name, '') AS name FROM i) i ON i.k = t.k", t=TARGET, i=INCOMING),
    "S5_bucket_table": sql("SELECT coalesce(t.k, i.k) AS k, coalesce(i.name, t.name) AS name, t.city AS city FROM t FULL JOIN (SELECT trim(k) AS k, NULLIF(name, '') AS name FROM i) i ON i.k = t.k", t=TARGET, i=INCOMING),
    "S6_known_keys": sql("SELECT trim(k) AS k FROM i WHERE trim(k) IN (SELECT k FROM t)", t=TARGET, i=INCOMING),
    "S7_restore_types": sql("SELECT o_orderkey AS id, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1234.5 WHEN 1 THEN 7 WHEN 3 THEN -5.25 END AS DOUBLE) AS a, CASE o_orderkey % 3 WHEN 0 THEN DATE '2026-06-03' WHEN 2 THEN DATE '2026-12-31' END AS d, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0.125 WHEN 2 THEN 1 END AS DOUBLE) AS p FROM orders"),
    "ST1_ingest": sql("SELECT DISTINCT corpid, seq FROM messages"),
    "ST2_match_pending": sql("SELECT t.id AS text_id, p.id AS record_id FROM messages t JOIN messages p ON t.msgtype = 'text' AND p.msgtype = 'file' AND t.roomid <> '' AND p.roomid = t.roomid AND p.sender = t.sender AND p.sent_at BETWEEN t.sent_at - INTERVAL 48 HOURS AND t.sent_at + INTERVAL 48 HOURS"),
    "ST5_first_notice": sql("SELECT DISTINCT roomid, sent_day FROM messages WHERE msgtype = 'file' AND roomid <> ''"),
    "ST6_offline_alerts": sql(
        """SELECT device, 'offline' AS outcome, CAST(300 AS BIGINT) AS seconds FROM spans WHERE coalesce(epoch_ms(back) - epoch_ms(t) >= 300000, epoch_ms(t) + 300000 < (SELECT epoch_ms(max(sent_at)) - 1000 FROM messages))
      UNION ALL SELECT device, 'recovered', (epoch_ms(back) - epoch_ms(t)) // 1000 FROM spans WHERE epoch_ms(back) - epoch_ms(t) >= 300000""",
        spans="SELECT * FROM (SELECT *, lead(t) OVER (PARTITION BY device ORDER BY t, id) AS back FROM (SELECT *, lag(kind) OVER (PARTITION BY device ORDER BY t, id) AS prior FROM (SELECT id, sender AS device, CASE WHEN msgtype = 'other' THEN 'offline' ELSE 'online' END AS kind, sent_at AS t FROM messages)) WHERE kind = 'online' OR prior IS NULL OR prior = 'online') WHERE kind = 'offline'",
    ),
    "ST6_offline_spans": sql("SELECT device, t AS away_at, seconds FROM (SELECT *, CAST(floor(epoch(lead(t) OVER (PARTITION BY device ORDER BY t, kind))) - floor(epoch(t)) AS BIGINT) AS seconds FROM (SELECT *, lag(kind) OVER (PARTITION BY device ORDER BY t, kind) AS prior FROM (SELECT sender AS device, CASE WHEN msgtype = 'other' THEN 'offline' ELSE 'online' END AS kind, sent_at AS t FROM messages)) WHERE kind = 'online' OR prior IS NULL OR prior = 'online') WHERE kind = 'offline' AND (seconds IS NULL OR seconds >= 300)"),
    "ST7_hourly_counts": sql("SELECT strftime(date_trunc('hour', sent_at), '%Y-%m-%d %H') AS hour, msgtype, count(*) AS n FROM messages WHERE date_trunc('hour', sent_at) + INTERVAL 1 HOUR <= (SELECT max(sent_at) - INTERVAL 2 HOURS FROM messages) GROUP BY 1, 2"),
}
