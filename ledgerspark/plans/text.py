"""Registered text and quality queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions import columns as c
from ledgerspark.operators import quality as q
from ledgerspark.operators import text as t
from ledgerspark.plans.analytics import CLASS, sql
from ledgerspark.plans.ledger import SORT
from ledgerspark.plans.proxies import TODAY, base, records, view

SPACED = "SELECT o_orderkey AS id, '保单 1 2 3 4 5 于 ' || CAST(o_custkey AS STRING) || ' 年 ' || CAST(o_orderkey % 12 + 1 AS STRING) || ' 月 3 日 x 7' AS text FROM {orders}"
KINDS = """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN '电子保单 保险单号 1' WHEN 1 THEN '发票号码 2' WHEN 2 THEN '缴款通知书' WHEN 3 THEN '保险示范条款' WHEN 4 THEN '批改日期 2020' WHEN 5 THEN '投保人声明' WHEN 6 THEN '此标志粘贴在机动车前窗' WHEN 7 THEN '投保单 投保人' ELSE 'plain' END AS text FROM {orders}"""
COVERS = "SELECT l_orderkey * 10 + l_linenumber AS doc_id, 'head' || chr(10) || '车损险 保额：' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' 保费 1,' || CAST(100 + l_linenumber AS STRING) || '.50' || chr(10) || '三者险 none' || chr(10) || '座位险 ' || CAST(l_partkey AS STRING) AS text FROM {lineitem}"
PAGES = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN '[PAGE:3] y' WHEN 2 THEN 'a [PAGE:2] b [PAGE:1] c [PAGE:3]' ELSE '[PAGE:1][PAGE:4][PAGE:1]' END AS text FROM {orders}"
AMOUNTS = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '人民币壹佰捌拾玖元整' WHEN 1 THEN '贰万零叁元伍角陆分' WHEN 2 THEN '叁亿贰仟万元' WHEN 3 THEN 'none' ELSE '拾元' END AS text FROM {orders}"
DATES = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '2026-6-3' WHEN 1 THEN '2026/06/' || CAST(o_orderkey % 40 AS STRING) WHEN 2 THEN '2026年6月3日 12时' WHEN 3 THEN '2026/05/' ELSE '' END AS text FROM {orders}"
FIELDS = "SELECT id, company_short, status, doc_category, policy_no, policy_type, insured, applicant, total_premium, plate_no, owner, filename, vin, enterprise_id, CAST(start_date AS STRING) AS start_text, CAST(sign_date AS STRING) AS sign_text FROM ({records}) r"
TITLES = [r"The and attion", r"Theand thble"]
LICENCES = [("Apache License", "Apache"), ("GNU General", "GPL")], [("MIT", "MIT"), ("CC BY", "CC")]
DOCS = ("doc_id", "text")


def _records(s, d):
    return records(s, d).withColumns({
        "fields": F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ["保险公司简称", "保单号", "险种类型", "车牌号", "投保人", "被保险人", "签单日期", "保险起期", "保险止期", "保费合计", "_x"])), F.array("company_short", "policy_no", "policy_type", "plate_no", "applicant", "insured", F.col("sign_date").cast("string"), F.when(F.col("id") % 6 == 1, "2026/05/").otherwise(F.col("start_date").cast("string")), F.col("end_date").cast("string"), "total_premium", F.lit("y"))), lambda k, v: v.isNotNull()),
        "override_reason": F.when(F.col("id") % 21 == 0, "ok"),
        "manual_fields": F.when(F.col("id") % 4 == 0, F.array(F.lit("投保人"), F.lit("保单号"))),
    })


def _second(s, d):
    other = F.map_from_arrays(F.array(*map(F.lit, ["投保人", "保费合计", "车牌号", "签单日期"])), F.array("insured", F.when(F.col("id") % 3 == 0, F.concat(F.lit("¥"), F.replace("total_premium", F.lit("元"), F.lit("")))).otherwise("9.99"), F.lower("plate_no"), F.date_format("created_day", "yyyy年M月d日")))
    return q.differences(_records(s, d).withColumn("ai_fields", other).withColumn("raw_text", F.concat(F.lit("合计9.99 "), F.col("insured"))), ["投保人", "保费合计", "车牌号", "签单日期"])


SPLIT = "SELECT doc_id, text FROM {documents}"
#: A dictionary as long as the documents: a piece of each text, with its number.
NAMES = "SELECT doc_id AS order_no, substr(text, 40, 14) AS name, 'n' || CAST(doc_id AS STRING) AS short FROM {documents} WHERE length(text) > 60"


#: Names with what stands around them, and what is left: the cleaned name, or nothing.
PARTY_CASES = [("沈 心 诚", "沈心诚"), ("马玲玲执业证 123", "马玲玲"), ("阿卜杜拉·艾买提", "阿卜杜拉·艾买提"), ("第十三条", ""), ("中设(深圳)设备检验检测：甲", "中设(深圳)设备检验检测"), ("飘逸共雅饮品店（个体工商户）", "飘逸共雅饮品店（个体工商户）"), ("广州某某有限公司附加出行不便损失费", "广州某某有限公司"), ("请通过以上渠道联系本公司", ""), ("投保申请", ""), ("王五（车主）", "王五"), ("欧阳上官司马诸葛", "")]
PARTIES = "SELECT o_orderkey AS id, CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(PARTY_CASES)) + " END AS name FROM {orders}"


def _displayed(s, d):
    rows = _records(s, d).withColumn("fields", F.map_concat("fields", F.create_map(F.lit("车主"), F.coalesce("owner", F.lit("")))))
    shown = F.when(F.col("id") % 3 == 1, F.create_map(F.lit("保单号"), F.lit("x"))).when(F.col("id") % 3 == 2, F.create_map(F.lit("车主"), F.lit("o")))
    return q.backfill_display(rows.withColumn("display", shown), {"保单号": "保单", "保费合计": "保费"}).select("id", *[F.element_at("display", F.lit(k)).alias(v) for k, v in (("保单", "policy"), ("保费", "premium"), ("车主", "owner"), ("_x", "internal"))])


QUERIES = {
    "T1_clean_digits": lambda s, d: view(s, d, SPACED).select("id", t.clean_digits(F.col("text")).alias("text")),
    "T2_undouble": lambda s, d: base(s, d, "customer").select("c_custkey", t.undouble(F.regexp_replace("c_name", r"(\S)", "$1$1")).alias("name")),
    "T3_companies": lambda s, d: base(s, d, "documents").select("doc_id", t.identify_company(F.col("text"), *LICENCES, [(("Apache", "MIT"), "both")]).alias("company")),
    "T4_products": lambda s, d: base(s, d, "documents").select("doc_id", t.product_name(F.col("text"), [r"(?m)^(The [a-z]+ [a-z]+)"], [r"License, [Vv]ersion ([0-9.]+)"]).alias("product")),
    "T5_classes": lambda s, d: records(s, d).select("id", c.product_class(F.col("policy_type")).alias("class"), c.sort_class(F.col("policy_type")).alias("sort_class"), c.class_rank(F.col("policy_type"), ("商业险", "交强险")).alias("rank")),
    "T6_categories": lambda s, d: view(s, d, KINDS).select("id", t.document_category(F.col("text")).alias("category")),
    "T7_fields": lambda s, d: t.extract_fields(base(s, d, "documents").select("doc_id", "text", F.col("source").alias("company_short")), {"ip": [r"(\d+\.\d+\.\d+\.\d+)"], "word": [r"(?i)\b(thble\w*)", r"(ciónes)"]}, {"src0": {"word": [r"(?i)\b(oned\w*)"]}}).select("doc_id", "ip", "word"),
    "T3_dictionary": lambda s, d: t.identify_companies(view(s, d, SPLIT), view(s, d, NAMES).withColumn("words", F.array("name"))),
    "T8_split": lambda s, d: t.split_policies(base(s, d, "documents"), TITLES, [r"the", r"and", r"of"]),
    "T9_covers": lambda s, d: t.cover_lines(view(s, d, COVERS), ["车损险", "三者险", "座位险"]),
    "T10_page_range": lambda s, d: view(s, d, PAGES).select("id", t.page_range(F.col("text")).alias("pages")),
    "T11_confidence": lambda s, d: records(s, d).select("id", F.round(t.confidence(["policy_no", "insured", "plate_no", "total_premium", "company_short"]), 2).alias("confidence"), t.energy_class(F.replace("plate_no", F.lit("-"), F.lit(""))).alias("energy"), F.month("end_date").alias("expiry_month")),
    "T12_dates": lambda s, d: view(s, d, DATES).select("id", c.parse_date(F.col("text")).alias("day")),
    "T13_amounts": lambda s, d: view(s, d, AMOUNTS).select("id", c.chinese_amount(F.col("text")).cast("double").alias("amount")),
    "T14_plates": lambda s, d: records(s, d).select("id", c.normalize_plate(F.col("plate_no")).alias("plate"), c.hyphen_plate(c.normalize_plate(F.col("plate_no"))).alias("hyphened"), c.repair_plate_letters(F.lit("京AOI12")).alias("repaired")),
    "T15_names": lambda s, d: records(s, d).select("id", t.person_name(F.concat("insured", F.lit(" 先生 电话123"))).alias("name")),
    "T15_parties": lambda s, d: view(s, d, PARTIES).select("id", F.when(t.is_party(t.clean_party(F.col("name"))), t.clean_party(F.col("name"))).alias("name")),
    "T16_cities": lambda s, d: base(s, d, "customer").select("c_custkey", t.insurer_with_city(F.lit("甲保险"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("广东省"), "c_mktsegment", F.lit("市天河区"))).when(F.col("c_custkey") % 3 == 1, "广东省东莞南城").otherwise("")).alias("label")),
    "T17_clause_pages": lambda s, d: base(s, d, "documents").select("doc_id", t.is_clause_page(F.col("text"), ("License", "Version", "Released", "under"), "GNU", 2).alias("clause")),
    "T18_map_fields": lambda s, d: _records(s, d).withColumn("m", t.map_fields(F.col("fields"), {"保单号": ["保单号"], "投保": ["投保人", "被保险人"]}, {"投保": ["被保险人"]})).select("id", F.element_at("m", F.lit("投保")).alias("applicant"), F.element_at("m", F.lit("险种类型")).alias("product"), F.element_at("m", F.lit("_x")).alias("inner")),
    "T19_flatten": lambda s, d: t.flatten(_records(s, d).select("id", "fields"), {"车牌号": "plate_no", "保险起期": "start_date", "保费合计": "total_premium"}).select("id", "plate_no", "start_date", "start_date_iso", "total_premium"),
    "T20_coverage": lambda s, d: t.coverage(records(s, d), ["policy_no", "insured", "plate_no"], "company_short"),
    "T21_suspicious": lambda s, d: t.suspicious_ids(records(s, d).withColumn("id_number", F.concat(F.lit("I"), (F.col("user_id") % 7).cast("string"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise(""))), 50, 50),
    "T21_cleared": lambda s, d: t.clear_suspicious(records(s, d), t.suspicious_ids(records(s, d), 0, 0)).select("id", "id_number"),
    "T22_same_party": lambda s, d: t.same_party_id(records(s, d).withColumns({"applicant_id": F.lit(""), "insured_id": F.col("id_number")})).select("id", "applicant_id", "insured_id"),
    "T23_new_insurers": lambda s, d: t.new_insurers(records(s, d).withColumn("company", F.when(F.col("id") % 2 == 0, F.col("ocr_engine")).otherwise("")), records(s, d).where("id % 46 = 0").select(F.substring("policy_no", 1, 9).alias("key"))),
    "T24_plate_fallback": lambda s, d: t.plate_fallback(records(s, d).withColumn("filename", F.when(F.col("id") % 5 == 0, F.concat(F.lit("保单粤B1234"), (F.col("id") % 10).cast("string"), F.lit(".pdf"))).otherwise("x.pdf")), [1, 2, 3, 4, 5, 6]).select("id", "plate_no"),
    "Q1_abnormal": lambda s, d: q.abnormal(_records(s, d), "fields", True).select("id", "abnormal", "hint"),
    "Q2_dates": lambda s, d: q.backfill_dates(view(s, d, DATES).withColumn("day", F.when(F.col("id") % 7 == 0, F.lit("2020-01-01").cast("date"))), {"text": "day"}).select("id", "day"),
    "Q2_display": _displayed,
    "Q2_recheck": lambda s, d: q.recheck(_records(s, d), waive_applicant=True).select("id", "outcome"),
    "Q2_short_names": lambda s, d: q.backfill(_records(s, d).withColumns({"company_short": F.when(F.col("id") % 2 == 0, F.col("company_short")).otherwise(""), "fields": F.map_filter("fields", lambda k, v: (k != "保险公司简称") | (F.col("id") % 3 != 0))}), view(s, d, "SELECT o_orderkey AS record_id FROM {orders}"))[0].select("id", "company_short"),
    "Q2_missing_side": lambda s, d: q.backfill(_records(s, d), view(s, d, "SELECT o_orderkey AS record_id FROM {orders} WHERE o_orderkey % 3 <> 0"))[1],
    "Q3_strip_disabled": lambda s, d: _records(s, d).select("id", F.concat_ws(",", F.array_sort(F.map_keys(q.strip_disabled(F.col("fields"), ["投保人", "车牌号", "_x"], F.col("manual_fields"))))).alias("keys")),
    "Q4_reread": lambda s, d: q.reread(_records(s, d).select("id", "manual_fields", F.col("fields").alias("old_fields"), F.map_from_arrays(F.array(F.lit("投保人"), F.lit("保单号"), F.lit("车主")), F.array("insured", F.lit("N1"), "owner")).alias("new_fields"), F.lit(None).cast("date").alias("first_read_at"), F.col("created_day").alias("read_at"))).select("id", F.element_at("merged", F.lit("投保人")).alias("applicant"), F.element_at("merged", F.lit("保单号")).alias("policy_no"), F.size("conflicts").alias("conflicts"), "first_read_at"),
    "Q5_file_identity": lambda s, d: q.file_identity(records(s, d).withColumn("msg_seq", F.floor(F.col("id") / 2))),
    "Q6_upsert": lambda s, d: q.upsert_by_policy(records(s, d).where("id % 2 = 0"), records(s, d).where("id % 2 = 1").select("id", "policy_no", "user_id", "enterprise_id")).select("id", "policy_no", "target_id"),
    "Q7_owner": lambda s, d: q.backfill_owner(records(s, d), view(s, d, "SELECT 'r' || CAST(s_suppkey % 12 AS STRING) AS roomid, s_suppkey AS user_id FROM {supplier}"), view(s, d, "SELECT 's' || CAST(s_suppkey AS STRING) AS sender, s_suppkey * 10 AS user_id FROM {supplier} WHERE s_suppkey < 30")).select("id", "user_id"),
    "Q8_differences": lambda s, d: _second(s, d).select("id", F.concat_ws(",", F.transform("diffs", lambda x: F.concat_ws(":", x["field"], x["type"], x["manual"].cast("string")))).alias("diffs")),
    "Q9_settle": lambda s, d: q.settle(_second(s, d), ["投保人", "保费合计", "车牌号", "签单日期"]).select("id", "result", "n_flagged", F.element_at("fixed", F.lit("投保人")).alias("applicant")),
    "Q10_scope": lambda s, d: q.in_check_scope(records(s, d), ["abnormal"], ["1-URGENT"], 700).select("id", "company_short", "history"),
    "Q11_notes": lambda s, d: q.note_summary(view(s, d, "SELECT l_orderkey AS record_id, l_linenumber AS note_id, l_returnflag AS content, CAST(l_shipdate AS DATE) AS created_day FROM {lineitem}").dropDuplicates(["record_id", "note_id"]).withColumn("content", F.col("note_id").cast("string")).withColumn("created_day", F.date_add(F.lit("2001-07-28").cast("date"), F.col("note_id"))), TODAY),
}

_ID = "o_orderkey AS id"
_HAS = lambda col: f"coalesce({col}, '') <> ''"

# What the second reader's values differ in: applicant, premium and sign date; plates are the same but for their case.
_KINDS = """SELECT id, insured, applicant, CASE WHEN insured = '' THEN NULL WHEN applicant = '' THEN 'supplement' WHEN applicant <> insured THEN 'diff' END AS p,
  CASE WHEN total_premium = '' THEN 'supplement' WHEN id % 3 <> 0 THEN 'diff' END AS a, CASE WHEN sign_date IS NULL THEN 'supplement' END AS s FROM records"""

ORACLE_SQL = {
    "T1_clean_digits": sql("SELECT o_orderkey AS id, '保单 12345 于 ' || o_custkey || '年' || (o_orderkey % 12 + 1) || '月3日 x 7' AS text FROM orders"),
    "T2_undouble": sql("SELECT c_custkey, c_name AS name FROM customer"),
    "T3_dictionary": sql("SELECT doc_id, (SELECT arg_min(short, order_no) FROM names WHERE contains(text, name)) AS company FROM documents", names=NAMES),
    "T3_companies": sql("SELECT doc_id, CASE WHEN contains(text, 'Apache') AND contains(text, 'MIT') THEN 'both' WHEN contains(text, 'Apache License') THEN 'Apache' WHEN contains(text, 'GNU General') THEN 'GPL' WHEN contains(text, 'MIT') THEN 'MIT' WHEN contains(text, 'CC BY') THEN 'CC' END AS company FROM documents"),
    "T4_products": sql("SELECT doc_id, coalesce(NULLIF(regexp_extract(substr(text, 1, 1000), '(?m)^(The [a-z]+ [a-z]+)', 1), ''), NULLIF(regexp_extract(text, 'License, [Vv]ersion ([0-9.]+)', 1), '')) AS product FROM documents"),
    "T5_classes": sql(f"SELECT id, {CLASS} AS class, {SORT} AS sort_class, CASE {SORT} WHEN '商业险' THEN 0 WHEN '交强险' THEN 1 ELSE 3 END AS rank FROM records"),
    "T6_categories": sql(f"SELECT {_ID}, CASE o_orderkey % 9 WHEN 0 THEN '保单' WHEN 1 THEN '发票' WHEN 2 THEN '缴款通知' WHEN 3 THEN '条款' WHEN 4 THEN '批单' WHEN 5 THEN '条款' WHEN 6 THEN '电子标志' WHEN 7 THEN '投保单' ELSE '未知' END AS category FROM orders"),
    "T7_fields": sql("SELECT doc_id, NULLIF(regexp_extract(text, '([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)', 1), '') AS ip, CASE WHEN source = 'src0' THEN coalesce(NULLIF(regexp_extract(text, '(?i)\\b(oned[0-9A-Za-z_]*)', 1), ''), w) ELSE w END AS word FROM (SELECT *, coalesce(NULLIF(regexp_extract(text, '(?i)\\b(thble[0-9A-Za-z_]*)', 1), ''), NULLIF(regexp_extract(text, '(ciónes)', 1), '')) AS w FROM documents)"),
    "T9_covers": sql("SELECT l_orderkey * 10 + l_linenumber AS doc_id, line_no, cover, amount, lim AS limit FROM (SELECT *, unnest([1, 3]) AS line_no, unnest(['车损险', '座位险']) AS cover, unnest(['1' || (100 + l_linenumber) || '.50', CAST(l_partkey AS VARCHAR)]) AS amount, unnest([CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), NULL]) AS lim FROM lineitem)"),
    "T10_page_range": sql(f"SELECT {_ID}, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '3' WHEN 2 THEN '1-3' ELSE '1,4' END AS pages FROM orders"),
    "T11_confidence": sql(f"SELECT id, round(({' + '.join(f'CAST({_HAS(x)} AS INT)' for x in ('policy_no', 'insured', 'plate_no', 'total_premium', 'company_short'))}) / CAST(5 AS DOUBLE), 2) AS confidence, CASE length(replace(plate_no, '-', '')) WHEN 8 THEN '新能源' WHEN 7 THEN '燃油' ELSE '' END AS energy, CAST(month(end_date) AS INT) AS expiry_month FROM records"),
    "T12_dates": sql(f"SELECT {_ID}, CASE o_orderkey % 5 WHEN 0 THEN DATE '2026-06-03' WHEN 1 THEN CASE WHEN o_orderkey % 40 BETWEEN 1 AND 30 THEN DATE '2026-05-31' + CAST(o_orderkey % 40 AS INT) END WHEN 2 THEN DATE '2026-06-03' END AS day FROM orders"),
    "T13_amounts": sql(f"SELECT {_ID}, CAST(CASE o_orderkey % 5 WHEN 0 THEN 189 WHEN 1 THEN 20003.56 WHEN 2 THEN 320000000 WHEN 4 THEN 10 END AS DOUBLE) AS amount FROM orders"),
    "T14_plates": sql("SELECT id, upper(replace(plate_no, '-', '')) AS plate, CASE WHEN plate_no LIKE '京A%' THEN plate_no ELSE plate_no END AS hyphened, '京A0112' AS repaired FROM records"),
    "T16_cities": sql("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || '甲保险' WHEN 1 THEN '东莞甲保险' ELSE '甲保险' END AS label FROM customer"),
    "T17_clause_pages": sql("SELECT doc_id, length(text) >= 50 AND NOT contains(text, 'GNU') AND CAST(contains(text, 'License') AS INT) + CAST(contains(text, 'Version') AS INT) + CAST(contains(text, 'Released') AS INT) + CAST(contains(text, 'under') AS INT) >= 2 AS clause FROM documents"),
    "T18_map_fields": sql("SELECT id, coalesce(NULLIF(insured, ''), NULLIF(applicant, '')) AS applicant, policy_type AS product, CAST(NULL AS VARCHAR) AS inner FROM records"),
    "T19_flatten": sql("SELECT id, plate_no, CASE WHEN id % 6 = 1 THEN '2026/05/' ELSE CAST(start_date AS VARCHAR) END AS start_date, CASE WHEN id % 6 <> 1 THEN start_date END AS start_date_iso, total_premium FROM records"),
    "T20_coverage": sql("SELECT company_short, in_all, field, n, filled, round(filled * CAST(100.0 AS DOUBLE) / n, 2) AS percent FROM (SELECT company_short, CAST(grouping(company_short) AS INT) AS in_all, count(*) AS n, unnest(['policy_no', 'insured', 'plate_no']) AS field, unnest([count(NULLIF(policy_no, '')), count(NULLIF(insured, '')), count(NULLIF(plate_no, ''))]) AS filled FROM records GROUP BY ROLLUP (company_short))"),
    "T21_suspicious": sql("SELECT id_number, count(DISTINCT NULLIF(plate_no, '')) AS plates, count(DISTINCT NULLIF(insured, '')) AS people FROM (SELECT plate_no, insured, 'I' || (user_id % 7) || CASE WHEN id % 3 > 0 THEN CAST(id AS VARCHAR) ELSE '' END AS id_number FROM records) GROUP BY 1 HAVING count(DISTINCT NULLIF(plate_no, '')) > 50 OR count(DISTINCT NULLIF(insured, '')) > 50"),
    "T21_cleared": sql("SELECT r.id, CASE WHEN b.k IS NULL THEN id_number ELSE '' END AS id_number FROM records r LEFT JOIN (SELECT id_number AS k FROM records WHERE id_number <> '' GROUP BY 1 HAVING count(NULLIF(plate_no, '')) > 0 OR count(NULLIF(insured, '')) > 0) b ON b.k = r.id_number"),
    "T22_same_party": sql("SELECT id, CASE WHEN applicant <> '' AND applicant = insured THEN NULLIF(id_number, '') END AS applicant_id, NULLIF(id_number, '') AS insured_id FROM records"),
    "T23_new_insurers": sql("SELECT key, min(id) AS first_id, count(*) AS n FROM (SELECT id, CASE WHEN id % 2 = 0 THEN ocr_engine ELSE NULLIF(substr(policy_no, 1, 9), '') END AS key FROM records WHERE company_short = '' AND doc_category = '保单') WHERE key IS NOT NULL AND key NOT IN (SELECT substr(policy_no, 1, 9) FROM records WHERE id % 46 = 0) GROUP BY 1"),
    "T24_plate_fallback": sql("SELECT id, coalesce(NULLIF(plate_no, ''), CASE WHEN id % 5 = 0 THEN '粤B1234' || (id % 10) END, CASE WHEN enterprise_id BETWEEN 1 AND 6 AND length(vin) >= 10 THEN vin END, '') AS plate_no FROM records"),
    "T15_parties": sql("SELECT o_orderkey AS id, CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(PARTY_CASES) if b) + " END AS name FROM orders"),
    "T15_names": sql("SELECT id, NULLIF(insured, '') AS name FROM records"),
    "Q1_abnormal": sql("""SELECT id, checked AND (m <> '' OR torn <> '') AS abnormal, CASE WHEN checked THEN concat_ws('；', CASE WHEN m <> '' THEN '缺少：' || m END, CASE WHEN torn <> '' THEN '日期不全：' || torn END) ELSE '' END AS hint FROM (SELECT id, status IN ('done', 'success') AND coalesce(NULLIF(doc_category, ''), '保单') = '保单' AND id % 21 <> 0 AS checked, CASE WHEN id % 6 = 1 THEN '起保日期' ELSE '' END AS torn,
      concat_ws('、', CASE WHEN company_short = '' THEN '承保公司' END, CASE WHEN policy_no = '' THEN '保单号' END, CASE WHEN policy_type = '' THEN '险种' END, CASE WHEN plate_no = '' THEN '车牌' END, CASE WHEN applicant = '' AND insured = '' THEN CASE WHEN policy_type LIKE '%强制%' THEN '投保人(交强险通常无)' ELSE '投保人' END END, CASE WHEN insured = '' THEN '被保人' END, CASE WHEN sign_date IS NULL THEN '签单日期' END, CASE WHEN total_premium = '' THEN '保费' END) AS m FROM records)"""),
    "Q2_dates": sql("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN DATE '2020-01-01' WHEN o_orderkey % 5 IN (0, 2) THEN DATE '2026-06-03' WHEN o_orderkey % 5 = 1 AND o_orderkey % 40 BETWEEN 1 AND 30 THEN DATE '2026-06-01' + CAST(o_orderkey % 40 - 1 AS INTEGER) END AS day FROM orders"),
    "Q2_display": sql("SELECT id, CASE WHEN id % 3 = 0 THEN NULLIF(policy_no, '') END AS policy, CASE WHEN id % 3 = 0 THEN NULLIF(total_premium, '') END AS premium, CASE WHEN id % 3 = 2 THEN 'o' ELSE NULLIF(owner, '') END AS owner, CAST(NULL AS VARCHAR) AS internal FROM records"),
    "Q2_short_names": sql("SELECT id, CASE WHEN id % 2 = 0 AND company_short <> '' THEN company_short WHEN id % 3 <> 0 THEN NULLIF(company_short, '') END AS company_short FROM records"),
    "Q2_missing_side": sql("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0"),
    "Q3_strip_disabled": sql("SELECT id, array_to_string(list_sort(list_filter(['保险公司简称', '保单号', '险种类型', CASE WHEN id % 4 = 0 THEN '投保人' END, '被保险人', CASE WHEN sign_date IS NOT NULL THEN '签单日期' END, '保险起期', '保险止期', '保费合计'], lambda x: x IS NOT NULL)), ',') AS keys FROM records"),
    "Q4_reread": sql("SELECT id, CASE WHEN id % 4 = 0 THEN applicant ELSE insured END AS applicant, CASE WHEN id % 4 = 0 THEN policy_no ELSE 'N1' END AS policy_no, CASE WHEN id % 4 = 0 THEN CAST(insured <> '' AND insured <> applicant AS INT) + CAST(policy_no <> 'N1' AS INT) ELSE 0 END AS conflicts, created_day AS first_read_at FROM records"),
    "Q5_file_identity": sql("SELECT id, file_md5, CASE WHEN f < id THEN f END AS source_id, CASE WHEN f IS NULL OR f >= id THEN 'new' WHEN f // 2 = id // 2 THEN 'duplicate' ELSE 'copy' END AS outcome FROM records LEFT JOIN (SELECT file_md5, min(id) AS f FROM records WHERE file_md5 <> '' AND status IN ('done', 'success') GROUP BY 1) d USING (file_md5)"),
    "Q6_upsert": sql("SELECT i.id, i.policy_no, e.t AS target_id FROM records i LEFT JOIN (SELECT policy_no, user_id, enterprise_id, max(id) AS t FROM records WHERE id % 2 = 0 AND policy_no <> '' GROUP BY 1, 2, 3) e ON e.policy_no = i.policy_no AND e.user_id IS NOT DISTINCT FROM i.user_id AND e.enterprise_id IS NOT DISTINCT FROM i.enterprise_id WHERE i.id % 2 = 1"),
    "Q7_owner": sql("SELECT id, coalesce(CASE WHEN roomid <> '' THEN a.u ELSE b.u END, user_id) AS user_id FROM records LEFT JOIN (SELECT 'r' || (s_suppkey % 12) AS roomid, min(s_suppkey) AS u FROM supplier GROUP BY 1) a USING (roomid) LEFT JOIN (SELECT 's' || s_suppkey AS sender, s_suppkey * 10 AS u FROM supplier WHERE s_suppkey < 30) b USING (sender)"),
    "Q8_differences": sql(f"SELECT id, concat_ws(',', '投保人:' || p || ':' || CASE WHEN id % 4 = 0 THEN 'true' ELSE 'false' END, '保费合计:' || a || ':false', '签单日期:' || s || ':false') AS diffs FROM ({_KINDS})"),
    "Q9_settle": sql(f"SELECT id, CASE WHEN p IS NULL AND a IS NULL AND s IS NULL THEN 'pass' WHEN p IS NOT NULL AND id % 4 = 0 THEN 'flagged' ELSE 'corrected' END AS result, CAST(p IS NOT NULL AND id % 4 = 0 AS INT) AS n_flagged, CASE WHEN p IS NOT NULL AND id % 4 <> 0 THEN insured ELSE applicant END AS applicant FROM ({_KINDS})"),
    "Q10_scope": sql("SELECT id, r.company_short, history FROM records r LEFT JOIN (SELECT company_short, count(*) AS history FROM records GROUP BY 1) h USING (company_short) WHERE is_abnormal = 1 OR r.company_short = '1-URGENT' OR history < 700"),
    "Q11_notes": sql(f"SELECT record_id, count(*) AS notes, CAST(max(note_id) AS VARCHAR) AS last_content, DATE '2001-07-28' + max(note_id) AS last_day, bool_or(DATE '2001-07-28' + note_id = DATE '{TODAY}') AS reviewed_today FROM (SELECT DISTINCT l_orderkey AS record_id, l_linenumber AS note_id FROM lineitem) GROUP BY 1"),
}
ORACLE_SQL["Q2_recheck"] = f"""SELECT id, CASE WHEN NOT was AND abnormal THEN 'raised' WHEN was AND NOT abnormal THEN 'cleared' WHEN was AND hint <> '' THEN 'reworded' ELSE 'kept' END AS outcome
  FROM ({ORACLE_SQL["Q1_abnormal"]}) q JOIN (SELECT o_orderkey AS id, o_orderkey % 8 = 0 AS was FROM orders) o USING (id)"""
