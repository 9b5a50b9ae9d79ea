"""Registered ledger and completion queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import fill, ledger
from ledgerspark.plans.analytics import CENTS, CLASS, USERS, sql
from ledgerspark.plans.proxies import TODAY, records, view

PLATE = "CASE WHEN plate_no IN ('', '新车') THEN NULL ELSE upper(replace(plate_no, '-', '')) END"
VIN = "CASE WHEN length(vin) >= 10 THEN upper(vin) END"
SORT = "CASE WHEN policy_type LIKE '%强制%' THEN '交强险' WHEN policy_type LIKE '%商业%' THEN '商业险' ELSE '非车险' END"
LABEL = f"CASE {CLASS} WHEN 'compulsory' THEN '交强险' WHEN 'commercial' THEN '商业险' ELSE '非车险' END"
NUMBERED = "(coalesce(doc_category, '') = '保单' AND coalesce(policy_no, '') <> '')"
BUCKET = "CASE WHEN status = 'failed' THEN 'failed' WHEN status NOT IN ('done', 'success') THEN 'other' WHEN coalesce(doc_category, '') NOT IN ('', '保单') THEN 'non_policy' WHEN is_abnormal = 1 THEN 'abnormal' ELSE 'success' END"
VALID = "(length({0}) BETWEEN 2 AND 40 AND NOT regexp_matches({0}, '^[0-9\\s]|[:：;；,，。]|(?:地址|电话|证件|号码|日期)'))"
ROOMS = "SELECT 'r' || CAST(n_nationkey AS STRING) AS roomid, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS room_name FROM {nation}"
NOTES = "SELECT l_orderkey AS record_id, CAST('2001-07-26' AS DATE) + l_linenumber AS created_day FROM {lineitem}"
CHECKS = "SELECT l_orderkey AS record_id FROM {lineitem} WHERE l_returnflag = 'R'"
BINDINGS = "SELECT 's' || CAST(s_suppkey % 45 AS STRING) AS sender, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_nationkey AS BIGINT) END AS enterprise_id, CASE WHEN s_suppkey % 2 = 0 THEN 'alias' || CAST(s_suppkey AS STRING) ELSE '' END AS alias, s_suppkey AS user_id FROM {supplier}"
FIELDS = ["owner", "id_number", "salesperson"]


#: Customers of two market segments are companies in the queries of stamp tasks.
CORPORATE = "insured <> '' AND policy_type IN ('家财险', '机动车商业保险')"


def corporate(s, d):
    return records(s, d).withColumn("insured", F.when(F.expr(CORPORATE), F.concat("insured", F.lit("公司"))).otherwise(F.col("insured")))


def _manual(df):
    return df.withColumn("manual_fields", F.when(F.col("id") % 4 == 0, F.array(F.lit("owner"))))


#: Some newer records have an earlier end date than older ones, some none.
CORRECTED = "CASE WHEN id % 15 = 0 THEN NULL WHEN id % 4 = 0 THEN end_date - 700 ELSE end_date END"
#: Records that lack a plate, a frame number, or the plate but not in the file's name.
BLANKED = {"plate_no": "CASE WHEN id % 5 = 0 THEN '' ELSE plate_no END", "vin": "CASE WHEN id % 7 = 0 THEN '' ELSE vin END", "filename": "CASE WHEN id % 10 = 0 THEN '沪B-' || CAST(100000 + user_id AS STRING) || '.pdf' ELSE filename END"}


QUERIES = {
    "L1_search": lambda s, d: ledger.search(records(s, d), status="done", keyword="Customer#00000", not_category="批单", plate="京a-0000", signed=("1998-01-01", "1999-01-01"), abnormal=False).select("id", "policy_no", "plate_no"),
    "L1_visible": lambda s, d: ledger.search(records(s, d).withColumn("updated_day", F.date_add("created_day", 3)), settled=True, only_policies=True, applicant="Customer", insured="01", salesperson="S1", where_from="room", starts=("1996-01-01", "2001-01-01"), updated=("1996-06-01", "2000-06-01"), user_ids=list(range(30)), vin="lsva").select("id"),
    "L1_reviewed": lambda s, d: ledger.reviewed(records(s, d), view(s, d, NOTES), TODAY, False).select("id"),
    "L2_deduplicate": lambda s, d: ledger.deduplicate(records(s, d)).select("id", "policy_no", "created_day"),
    "L3_sort_by_anchor": lambda s, d: ledger.sort_by_anchor(records(s, d)).select("id", "anchor", "plate_no"),
    "L4_enrich": lambda s, d: ledger.enrich(records(s, d), view(s, d, ROOMS), view(s, d, CHECKS), view(s, d, USERS)).select("id", "room_name", "checked", "user_name"),
    "L5_sort_class": lambda s, d: ledger.search(records(s, d), sort_class_is="商业险").select("id", "policy_type"),
    "L6_page": lambda s, d: ledger.page(ledger.search(records(s, d)), 3, 50).select("id", "total", "pages"),
    "L6_deep_page": lambda s, d: ledger.deep_page(ledger.search(records(s, d)), 100, 100).select("id", "created_day", "total", "pages"),
    "L7_counters": lambda s, d: ledger.counters(records(s, d)),
    "L7_daily": lambda s, d: ledger.daily_counters(records(s, d)),
    "L7_of_tenant": lambda s, d: ledger.counters_of(ledger.daily_counters(records(s, d)), 7, "1996-01-01", "2000-06-30"),
    "L7_engines": lambda s, d: ledger.engine_counts(records(s, d)),
    "L7_rooms": lambda s, d: ledger.top_rooms(records(s, d)),
    "L8_merge_by_car": lambda s, d: ledger.merge_by_car(records(s, d).where("deleted = 0")).withColumn("record_ids", F.concat_ws(",", "record_ids")),
    "L8_merge_own": lambda s, d: ledger.merge_by_car(records(s, d).where("deleted = 0"), own={"商业险": ["insured"], "非车险": ["company_short", "vin"]}).select("car", "n_records", "commercial_insured", "other_company_short", "other_vin"),
    "L9_plain_order": lambda s, d: ledger.plain_order(records(s, d)).select("id", "plate_no", "policy_type"),
    "L10_companies": lambda s, d: ledger.companies(records(s, d), enterprise_id=7),
    "L11_seal_groups": lambda s, d: ledger.seal_groups(corporate(s, d), list(range(12))),
    "L12_sender_names": lambda s, d: ledger.sender_names(records(s, d), view(s, d, BINDINGS), view(s, d, USERS)).select("id", "sender", "sender_name"),
    "F1_same_file": lambda s, d: fill.fill_same_file(records(s, d), ["id_number", "salesperson"], ["insured", "owner"], "URGENT").select("id", "id_number", "salesperson", "insured", "owner", "company_short"),
    "F2_same_plate": lambda s, d: fill.fill_same_plate(records(s, d), FIELDS).select("id", *FIELDS),
    "F3_same_vin": lambda s, d: fill.fill_same_vin(records(s, d), ["plate_no", *FIELDS]).select("id", "plate_no", *FIELDS),
    "F4_by_person": lambda s, d: fill.fill_by_person(records(s, d), ["id_number", "salesperson"]).select("id", "id_number", "salesperson"),
    "F5_correct_parties": lambda s, d: fill.correct_parties(_manual(records(s, d)), manual="manual_fields").select("id", *fill.PARTIES),
    "F6_reverse_fill": lambda s, d: fill.reverse_fill(_manual(records(s, d)), FIELDS).select("id", *FIELDS),
    "F7_plate_pool": lambda s, d: fill.plate_pool(records(s, d), FIELDS),
    "F8_vin_pool": lambda s, d: fill.vin_pool(records(s, d)),
    "F8_plate_vin_pool": lambda s, d: fill.plate_vin_pool(records(s, d)),
    "F8_fill_by_pools": lambda s, d: fill.fill_by_pools(records(s, d).withColumns({c: F.expr(e) for c, e in BLANKED.items()})).select("id", "plate_no", "vin", "owner", "id_number"),
    "F9_compulsory_end": lambda s, d: fill.latest_compulsory_end(records(s, d).withColumn("end_date", F.expr(CORRECTED))),
    "F10_dual_dates": lambda s, d: fill.dual_dates(records(s, d)),
    "F10_dual_end_dates": lambda s, d: fill.dual_dates(records(s, d).withColumn("end_date", F.expr(CORRECTED)), "end_date"),
    "F11_siblings": lambda s, d: fill.siblings(records(s, d).withColumn("policy_index", F.col("id") % 3)).withColumn("sibling_ids", F.concat_ws(",", "sibling_ids")),
    "F12_related": lambda s, d: fill.related(records(s, d).withColumn("start_date", F.when(F.col("id") % 50 != 0, F.col("start_date"))), "commercial", 30),
}

_FIRST = lambda c, o="id": f"arg_min(NULLIF({c}, ''), {o}) FILTER ({c} <> '')"
_NEW = lambda c: f"arg_max(NULLIF({c}, ''), id) FILTER ({c} <> '')"
_LONGEST = lambda c: f"(max({{'l': length({c}), 'i': -id, 'v': {c}}}) FILTER ({VALID.format(c)})).v"


_KEYED = "SELECT *, {key} AS k, " + VIN + " AS g FROM records WHERE deleted = 0 AND status IN ('done', 'success')"


def _pool(key: str, fields: list[str], guard: str) -> str:
    filled = ", ".join(f"coalesce(NULLIF(any_value(r.{c}), ''), arg_max(NULLIF(p.{c}, ''), p.id) FILTER (p.{c} <> '')) AS {c}" for c in fields)
    return f"""SELECT r.id, {filled} FROM (SELECT *, {key} AS k, {VIN} AS g FROM records) r LEFT JOIN (
        SELECT a.id AS rid, b.*, row_number() OVER (PARTITION BY a.id ORDER BY b.id DESC) AS place FROM (SELECT id, {key} AS k FROM records) a JOIN ({_KEYED.format(key=key)}) b ON a.k = b.k AND a.id <> b.id
      ) p ON p.rid = r.id AND place <= 10 AND {guard} GROUP BY r.id"""


#: Records of ``blanked`` with plates, owners and id numbers from their frame numbers or files, and of these the frame numbers of their plates.
FILLED = f"SELECT r.* REPLACE (CASE WHEN {PLATE} IS NOT NULL THEN plate_no ELSE coalesce(p.pp, NULLIF(replace(regexp_extract(filename, '沪[A-Z]-?[A-Z0-9]{{{{4,6}}}}'), '-', ''), ''), plate_no) END AS plate_no, coalesce(NULLIF(owner, ''), CASE WHEN {PLATE} IS NULL THEN po END) AS owner, coalesce(NULLIF(id_number, ''), CASE WHEN {PLATE} IS NULL THEN pi END) AS id_number) FROM blanked r LEFT JOIN (SELECT {VIN} AS g, arg_max({PLATE}, id) FILTER ({PLATE} IS NOT NULL) AS pp, {_NEW('owner')} AS po, {_NEW('id_number')} AS pi FROM blanked WHERE deleted = 0 GROUP BY 1) p ON p.g = {VIN}"
POOLED = f"""SELECT a.id, a.plate_no, coalesce(NULLIF(a.vin, ''), v.vin) AS vin, a.owner, a.id_number FROM filled a
      LEFT JOIN (SELECT {PLATE} AS p, arg_max({VIN}, id) FILTER ({VIN} IS NOT NULL) AS vin FROM filled WHERE deleted = 0 GROUP BY 1) v ON v.p = {PLATE.replace('plate_no', 'a.plate_no')}"""
_DUAL = f"""SELECT *, CASE WHEN commercial = compulsory THEN CAST(commercial AS VARCHAR) ELSE coalesce(CAST(commercial AS VARCHAR) || '交' || CAST(month(compulsory) AS VARCHAR) || '/' || CAST(day(compulsory) AS VARCHAR), CAST(commercial AS VARCHAR), CAST(compulsory AS VARCHAR), '') END AS dates
  FROM (SELECT plate, any_value(d) FILTER (c = 'commercial' AND place = 1) AS commercial, any_value(d) FILTER (c = 'compulsory' AND place = 1) AS compulsory
    FROM (SELECT *, row_number() OVER (PARTITION BY plate, c, d IS NULL ORDER BY id DESC) + CASE WHEN d IS NULL THEN 1 ELSE 0 END AS place FROM (SELECT id, {PLATE} AS plate, {CLASS} AS c, {{date}} AS d FROM records WHERE deleted = 0 AND status = 'done' AND {PLATE} IS NOT NULL)) GROUP BY plate)"""


ORACLE_SQL = {
    "L1_search": sql("SELECT id, policy_no, plate_no FROM records WHERE deleted = 0 AND status IN ('done', 'success') AND coalesce(doc_category, '') <> '批单' AND (policy_no || '|' || insured || '|' || applicant || '|' || plate_no || '|' || filename || '|' || company_short) LIKE '%Customer#00000%' AND replace(plate_no, '-', '') LIKE '%京A0000%' AND sign_date >= DATE '1998-01-01' AND sign_date < DATE '1999-01-01' AND is_abnormal = 0"),
    "L1_visible": sql("SELECT id FROM records WHERE deleted = 0 AND status NOT IN ('processing', 'pending', 'duplicate') AND coalesce(doc_category, '') IN ('', '保单') AND contains(applicant, 'Customer') AND contains(insured, '01') AND contains(salesperson, 'S1') AND roomid <> '' AND start_date >= DATE '1996-01-01' AND start_date < DATE '2001-01-01' AND created_day + 3 >= DATE '1996-06-01' AND created_day + 3 < DATE '2000-06-01' AND user_id < 30 AND contains(vin, 'lsva')"),
    "L1_reviewed": sql(f"SELECT id FROM records WHERE id NOT IN (SELECT record_id FROM notes WHERE created_day = DATE '{TODAY}')", notes=NOTES),
    "L2_deduplicate": sql(f"SELECT id, policy_no, created_day FROM (SELECT *, row_number() OVER (PARTITION BY policy_no, created_day ORDER BY id DESC) AS k FROM records WHERE {NUMBERED}) WHERE k = 1 UNION ALL SELECT id, policy_no, created_day FROM records WHERE NOT {NUMBERED}"),
    "L3_sort_by_anchor": sql(f"SELECT id, max(created_day) OVER (PARTITION BY coalesce({PLATE}, '#' || CAST(id AS VARCHAR))) AS anchor, plate_no FROM records"),
    "L4_enrich": sql("SELECT id, coalesce(NULLIF(room_name, ''), r.roomid) AS room_name, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = r.id AND l_returnflag = 'R') AS checked, user_name FROM records r LEFT JOIN rooms USING (roomid) LEFT JOIN users u ON u.user_id = r.user_id", rooms=ROOMS, users=USERS),
    "L5_sort_class": sql("SELECT id, policy_type FROM records WHERE deleted = 0 AND policy_type LIKE '%商业%'"),
    "L6_page": sql("SELECT id, total, CAST(ceil(total / 50.0) AS BIGINT) AS pages FROM (SELECT id, count(*) OVER () AS total FROM records WHERE deleted = 0) ORDER BY id DESC LIMIT 50 OFFSET 100"),
    "L6_deep_page": sql("SELECT id, created_day, total, CAST(ceil(total / 100.0) AS BIGINT) AS pages FROM (SELECT id, created_day, count(*) OVER () AS total FROM records WHERE deleted = 0) ORDER BY created_day DESC, id DESC LIMIT 100 OFFSET 9900"),
    "L7_counters": sql(f"SELECT bucket, count(*) AS n, count(DISTINCT key) AS n_distinct FROM (SELECT unnest([{BUCKET}, 'total']) AS bucket, CASE WHEN {NUMBERED} THEN policy_no || '|' || CAST(created_day AS VARCHAR) ELSE '#' || CAST(id AS VARCHAR) END AS key FROM records WHERE deleted = 0) GROUP BY 1"),
    "L7_daily": sql(f"SELECT enterprise_id, created_day, bucket, count(*) AS n, count(DISTINCT key) AS n_distinct FROM (SELECT enterprise_id, created_day, unnest([{BUCKET}, 'total']) AS bucket, CASE WHEN {NUMBERED} THEN 'p' || policy_no ELSE '#' || CAST(id AS VARCHAR) END AS key FROM records WHERE deleted = 0) GROUP BY 1, 2, 3"),
    "L7_of_tenant": sql(f"SELECT bucket, CAST(count(*) AS BIGINT) AS n, count(DISTINCT key) AS n_distinct FROM (SELECT unnest([{BUCKET}, 'total']) AS bucket, CASE WHEN {NUMBERED} THEN policy_no || '|' || CAST(created_day AS VARCHAR) ELSE '#' || CAST(id AS VARCHAR) END AS key FROM records WHERE deleted = 0 AND enterprise_id = 7 AND created_day BETWEEN DATE '1996-01-01' AND DATE '2000-06-30') GROUP BY 1"),
    "L7_engines": sql("SELECT ocr_engine, count(*) AS n FROM records WHERE deleted = 0 GROUP BY 1"),
    "L7_rooms": sql("SELECT roomid, count(*) AS n FROM records WHERE deleted = 0 AND roomid <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
    "L8_merge_by_car": sql(f"""SELECT a.*, commercial_cents, compulsory_cents, other_cents FROM (SELECT car, {", ".join(f"{_FIRST(c)} AS {c}" for c in ledger.SHARED)}, {", ".join(f"arg_min(NULLIF(policy_no, ''), id) FILTER (policy_no <> '' AND label = '{k}') AS {v}_policy_no" for k, v in (("商业险", "commercial"), ("交强险", "compulsory"), ("非车险", "other")))}, min(id) AS first_id, count(*) AS n_records, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS record_ids FROM keyed GROUP BY car) a
      JOIN (SELECT car, {", ".join(f"CAST(coalesce(sum(cents) FILTER (label = '{k}'), 0) AS BIGINT) AS {v}_cents" for k, v in (("商业险", "commercial"), ("交强险", "compulsory"), ("非车险", "other")))} FROM (SELECT *, row_number() OVER (PARTITION BY car, number ORDER BY id) AS k FROM keyed) WHERE k = 1 GROUP BY car) b USING (car)""", keyed=f"SELECT *, coalesce({PLATE}, 'vin:' || ({VIN}), '#' || CAST(id AS VARCHAR)) AS car, {LABEL} AS label, coalesce(NULLIF(policy_no, ''), '#' || CAST(id AS VARCHAR)) AS number, {CENTS} AS cents FROM records WHERE deleted = 0"),
    "L8_merge_own": sql(f"SELECT car, count(*) AS n_records, arg_min(insured, id) FILTER (label = '商业险' AND insured <> '') AS commercial_insured, arg_min(company_short, id) FILTER (label = '非车险' AND company_short <> '') AS other_company_short, arg_min(vin, id) FILTER (label = '非车险' AND vin <> '') AS other_vin FROM (SELECT *, coalesce({PLATE}, 'vin:' || ({VIN}), '#' || CAST(id AS VARCHAR)) AS car, {LABEL} AS label FROM records WHERE deleted = 0) GROUP BY car"),
    "L9_plain_order": sql("SELECT id, plate_no, policy_type FROM records"),
    "L10_companies": sql("SELECT DISTINCT company_short FROM records WHERE deleted = 0 AND enterprise_id = 7 AND company_short <> ''"),
    "L11_seal_groups": sql(f"SELECT enterprise_id, seal_key, coalesce(array_to_string(list_sort(list_distinct(list(policy_type) FILTER (policy_type <> ''))), '、'), '') AS products, coalesce(array_to_string(list_sort(list_distinct(list(company_short) FILTER (company_short <> ''))), '、'), '') AS insurers, bool_and(seal_paid = 1) AS paid, count(*) AS children, min(id) AS first_id, coalesce(CAST(CAST(sum({CENTS}) AS BIGINT) AS VARCHAR), min(total_premium)) AS premium FROM (SELECT *, CASE WHEN enterprise_id < 12 THEN coalesce({PLATE}, {VIN}, CAST(id AS VARCHAR)) || '|' || coalesce(CAST(sign_date AS VARCHAR), '') ELSE '#' || CAST(id AS VARCHAR) END AS seal_key FROM records WHERE {CORPORATE} AND deleted = 0 AND status = 'done') GROUP BY 1, 2"),
    "L12_sender_names": sql("SELECT id, r.sender, coalesce(o.v, e.v, r.sender) AS sender_name FROM records r LEFT JOIN (SELECT sender, enterprise_id, min(v) AS v FROM named WHERE enterprise_id IS NOT NULL GROUP BY 1, 2) o ON o.sender = r.sender AND o.enterprise_id = r.enterprise_id LEFT JOIN (SELECT sender, min(v) AS v FROM named WHERE enterprise_id IS NULL GROUP BY 1) e ON e.sender = r.sender", named="SELECT b.sender, b.enterprise_id, coalesce(NULLIF(alias, ''), NULLIF(user_name, '')) AS v FROM (" + BINDINGS + ") b LEFT JOIN (" + USERS + ") u ON u.user_id = b.user_id"),
    "F1_same_file": sql(f"SELECT id, coalesce(NULLIF(id_number, ''), a) AS id_number, coalesce(NULLIF(salesperson, ''), b) AS salesperson, CASE WHEN length(c) > length(insured) THEN c ELSE NULLIF(insured, '') END AS insured, CASE WHEN length(d) > length(owner) THEN d ELSE NULLIF(owner, '') END AS owner, CASE WHEN {CLASS} = 'compulsory' AND contains(company_short, 'URGENT') AND e IS NOT NULL THEN e ELSE company_short END AS company_short FROM records LEFT JOIN (SELECT file_md5, arg_min(company_short, id) FILTER (company_short <> '' AND NOT contains(company_short, 'URGENT')) AS e, {_FIRST('id_number')} AS a, {_FIRST('salesperson')} AS b, {_LONGEST('insured')} AS c, {_LONGEST('owner')} AS d FROM records WHERE file_md5 <> '' GROUP BY 1) p USING (file_md5)"),
    "F2_same_plate": sql(_pool(PLATE, FIELDS, "(p.g IS NULL OR r.g IS NULL OR p.g = r.g)")),
    "F3_same_vin": sql(_pool(VIN, ["plate_no", *FIELDS], "true")),
    "F4_by_person": sql("""SELECT r.id, coalesce(NULLIF(any_value(r.id_number), ''), (max({'m': p.motor, 'i': p.id, 'v': p.id_number}) FILTER (p.id_number <> '')).v) AS id_number, coalesce(NULLIF(any_value(r.salesperson), ''), (max({'m': p.motor, 'i': p.id, 'v': p.salesperson}) FILTER (p.salesperson <> '')).v) AS salesperson
      FROM records r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY motor DESC, id DESC) AS nth FROM (SELECT DISTINCT a.id AS rid, p.id, p.motor, p.id_number, p.salesperson FROM named a JOIN named p ON p.person = a.person AND p.id <> a.id AND p.deleted = 0 AND p.status IN ('done', 'success'))) p ON p.rid = r.id AND p.nth <= 20 GROUP BY r.id""", named=f"SELECT id, deleted, status, motor, id_number, salesperson, unnest(list_distinct(list_filter([insured, applicant, owner], lambda x: x <> ''))) AS person FROM (SELECT *, {CLASS} IN ('compulsory', 'commercial') AS motor FROM records) t"),
    "F5_correct_parties": sql("SELECT id, " + ", ".join(f"coalesce({'CASE WHEN id % 4 = 0 THEN NULL ELSE ' if c == 'owner' else ''}CASE WHEN motor THEN CASE WHEN length(l_{c}) > length({c}) THEN l_{c} END ELSE n_{c} END{' END' if c == 'owner' else ''}, {c}) AS {c}" for c in fill.PARTIES) + f" FROM (SELECT *, {PLATE} AS k, {CLASS} IN ('compulsory', 'commercial') AS motor FROM records) r LEFT JOIN (SELECT k, " + ", ".join(f"(max({{'l': length({c}), 'i': id, 'v': {c}}}) FILTER (motor AND {VALID.format(c)})).v AS l_{c}, arg_max({c}, id) FILTER (motor AND {VALID.format(c)}) AS n_{c}" for c in fill.PARTIES) + f" FROM (SELECT *, {PLATE} AS k, {CLASS} IN ('compulsory', 'commercial') AS motor FROM records WHERE deleted = 0) WHERE k IS NOT NULL GROUP BY 1) p USING (k)"),
    "F6_reverse_fill": sql(f"SELECT id, coalesce(NULLIF(owner, ''), CASE WHEN id % 4 <> 0 THEN f_owner END) AS owner, coalesce(NULLIF(id_number, ''), f_id_number) AS id_number, coalesce(NULLIF(salesperson, ''), f_salesperson) AS salesperson FROM (SELECT *, {PLATE} AS k FROM records) r LEFT JOIN (SELECT {PLATE} AS k, {', '.join(f'{_NEW(c)} AS f_{c}' for c in FIELDS)} FROM (SELECT * REPLACE (CASE WHEN " + VALID.format('owner') + " THEN owner END AS owner) FROM records) WHERE deleted = 0 GROUP BY 1) p USING (k)"),
    "F7_plate_pool": sql(f"SELECT {PLATE} AS plate, {', '.join(f'{_NEW(c)} AS {c}' for c in FIELDS)} FROM records WHERE deleted = 0 AND status = 'done' AND {PLATE} IS NOT NULL GROUP BY 1"),
    "F8_vin_pool": sql(f"SELECT {VIN} AS vin, arg_max({PLATE}, id) FILTER ({PLATE} IS NOT NULL) AS plate, {_NEW('owner')} AS owner, {_NEW('id_number')} AS id_number FROM records WHERE deleted = 0 AND {VIN} IS NOT NULL GROUP BY 1"),
    "F8_plate_vin_pool": sql(f"SELECT plate, vin FROM (SELECT {PLATE} AS plate, arg_max({VIN}, id) FILTER ({VIN} IS NOT NULL) AS vin FROM records WHERE deleted = 0 AND {PLATE} IS NOT NULL GROUP BY 1) WHERE vin IS NOT NULL"),
    "F8_fill_by_pools": sql(POOLED, blanked="SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN '' ELSE plate_no END AS plate_no, CASE WHEN id % 7 = 0 THEN '' ELSE vin END AS vin, CASE WHEN id % 10 = 0 THEN '沪B-' || CAST(100000 + user_id AS VARCHAR) || '.pdf' ELSE filename END AS filename) FROM records", filled=FILLED),
    "F9_compulsory_end": sql(f"SELECT plate, end_date, record_id FROM (SELECT {PLATE} AS plate, {CORRECTED} AS end_date, id AS record_id, row_number() OVER (PARTITION BY {PLATE} ORDER BY id DESC) AS place FROM records WHERE deleted = 0 AND status = 'done' AND {CLASS} = 'compulsory' AND {PLATE} IS NOT NULL AND {CORRECTED} IS NOT NULL) WHERE place = 1"),
    "F10_dual_dates": sql(_DUAL.format(date="start_date")),
    "F10_dual_end_dates": sql(_DUAL.format(date=CORRECTED)),
    "F11_siblings": sql("SELECT r.id, string_agg(CAST(sibling AS VARCHAR), ',' ORDER BY sibling) AS sibling_ids FROM slots r JOIN (SELECT file_md5, slot, max(id) AS sibling FROM slots GROUP BY 1, 2) s ON s.file_md5 = r.file_md5 AND s.slot <> r.slot AND sibling <> r.id GROUP BY 1", slots="SELECT id, file_md5, CASE WHEN o_index = 0 THEN -id ELSE o_index END AS slot FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'h' || CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING) END AS file_md5, o_orderkey % 3 AS o_index FROM {orders}) t WHERE file_md5 <> ''"),
    "F12_related": sql(f"SELECT r.id, EXISTS (SELECT 1 FROM x o WHERE o.deleted = 0 AND o.status = 'done' AND o.c = 'commercial' AND o.id <> r.id AND (o.p = r.p OR o.v = r.v) AND (o.d IS NULL OR r.d IS NULL OR abs(date_diff('day', o.d, r.d)) <= 30)) AND r.deleted = 0 AS related FROM x r".replace("FROM x o", f"FROM (SELECT id, deleted, status, {CLASS} AS c, {PLATE} AS p, {VIN} AS v, CASE WHEN id % 50 <> 0 THEN start_date END AS d FROM records) o").replace("FROM x r", f"FROM (SELECT id, deleted, {PLATE} AS p, {VIN} AS v, CASE WHEN id % 50 <> 0 THEN start_date END AS d FROM records) r")),
}
