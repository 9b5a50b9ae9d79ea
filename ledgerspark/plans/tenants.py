"""Registered queries of rules of many tenants (M16, C6, C7), with their SQL: every tenant has rules of its own, one plan runs them all."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.functions import rule_tables as t
from ledgerspark.operators import messages as m
from ledgerspark.plans.analytics import duck, sql
from ledgerspark.plans.messages import RULES, TALK
from ledgerspark.plans.proxies import records, view

_EACH = "SELECT CAST(n_nationkey AS BIGINT) AS enterprise_id, CAST(n_nationkey AS BIGINT) AS e FROM {nation}"
#: Two rules a tenant: the one's keywords depend on the tenant, the other ends sooner.
KEYWORDS = f"""
SELECT enterprise_id, 1 AS rule_no, 'first' AS target, CASE e % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'de' ELSE 'in' END AS word, 'text' AS value_type, true AS enabled FROM ({_EACH}) a
UNION ALL SELECT enterprise_id, 2 AS rule_no, 'second' AS target, CASE WHEN e % 2 = 0 THEN 'of' ELSE 'en' END AS word, 'short' AS value_type, true AS enabled FROM ({_EACH}) a
UNION ALL SELECT enterprise_id, 3 AS rule_no, 'off' AS target, 'a' AS word, 'text' AS value_type, false AS enabled FROM ({_EACH}) a
"""
#: Three formulas a tenant; the second number is used by the first.
FORMULAS = f"""
SELECT enterprise_id, 1 AS formula_no, 'net' AS target, '' AS company, '' AS product, CASE WHEN e % 2 = 0 THEN 'total_premium - fee' ELSE '(total_premium - fee) × ' || CAST(e AS STRING) || ' ÷ 10' END AS expr FROM ({_EACH}) a
UNION ALL SELECT enterprise_id, 2 AS formula_no, 'fee' AS target, CASE WHEN e % 3 = 0 THEN 'URGENT' ELSE '' END AS company, '' AS product, 'total_premium * ' || CAST(e + 1 AS STRING) || ' / 100' AS expr FROM ({_EACH}) a
UNION ALL SELECT enterprise_id, 3 AS formula_no, 'share' AS target, '' AS company, CASE WHEN e % 4 = 0 THEN '机动车商业保险' ELSE '' END AS product, CASE WHEN e % 5 = 0 THEN 'net +* 2' ELSE '(net + fee) / n' END AS expr FROM ({_EACH}) a
"""
#: Two ratio rules a tenant, as JSON of their branches.
RATIOS = f"""
SELECT enterprise_id, 1 AS rule_no, 'ratio' AS target, CASE WHEN e % 2 = 0 THEN 'HIGH' ELSE '' END AS company, '' AS product, CAST(0.1 AS STRING) AS fallback,
  '[{{{{"conditions":[{{{{"field":"total_premium","op":"ge","value":"' || CAST(e * 5000 AS STRING) || '"}}}},{{{{"field":"policy_type","op":"contains","value":"商业"}}}}],"value":"0.2"}}}},{{{{"conditions":[{{{{"field":"related","op":"exists"}}}}],"value":"0.15"}}}}]' AS branches FROM ({_EACH}) a
UNION ALL SELECT enterprise_id, 2 AS rule_no, 'ratio' AS target, '' AS company, '家财险' AS product, CASE WHEN e % 3 = 0 THEN CAST(NULL AS STRING) ELSE '0.3' END AS fallback, '[]' AS branches FROM ({_EACH}) a
"""
BRANCHES = "array<struct<conditions:array<struct<field:string,op:string,value:string>>,value:string>>"


def _talk(s, d):
    return view(s, d, TALK).withColumn("enterprise_id", F.pmod("message_id", F.lit(25)))


def _keywords(s, d):
    rules = view(s, d, KEYWORDS).withColumn("keywords", F.array("word"))
    return m.parse_with_rule_table(_talk(s, d), t.keyword_table(rules), F.col("roomid")).select("message_id", "enterprise_id", "plate", *[F.element_at("fields", F.lit(c)).alias(c) for c in ("first", "second", "off")])


def _formulas(s, d):
    fields = ["total_premium", "n"]
    rows = records(s, d).withColumn("n", F.col("id") % 7)
    return t.apply_formula_table(rows, t.formula_table(view(s, d, FORMULAS), fields), fields).select("id", *[F.element_at("computed", F.lit(c)).alias(c) for c in ("net", "fee", "share")])


def _ratios(s, d):
    rules = view(s, d, RATIOS).withColumn("branches", F.from_json("branches", BRANCHES))
    rows = records(s, d).withColumn("related", F.col("id") % 3 == 0)
    return t.apply_ratio_table(rows, rules, ["total_premium", "policy_type", "related"]).select("id", F.element_at("ratios", F.lit("ratio")).alias("ratio"))


QUERIES = {
    "M16_rules": lambda s, d: m.parse_with_rules(view(s, d, TALK), RULES, F.col("roomid")).select("message_id", "plate", F.element_at("fields", F.lit("de")).alias("de"), F.element_at("fields", F.lit("the")).alias("the")),
    "M16_many_tenants": _keywords,
    "C6_many_tenants": _ratios,
    "C7_many_tenants": _formulas,
}

_VALUE = r"NULLIF(regexp_extract(r, '^[ \t]*[:：]?[ \t]*([^\s，,。、；;:：]{{1,{0}}})', 1), '')"
_CUTS = f"""SELECT row, e, regexp_replace(h, '[ \\t]', '', 'g') AS w, i, {_VALUE.format(20)} AS v20, {_VALUE.format(10)} AS v10
  FROM (SELECT *, unnest(hits) AS h, unnest(rests[2:]) AS r, generate_subscripts(hits, 1) AS i FROM (SELECT *, regexp_extract_all(text, pattern) AS hits, string_split_regex(text, pattern) AS rests FROM asked))"""


def _talk_sql(query: str, pattern: str) -> str:
    asked = f"SELECT row_number() OVER () AS row, message_id, roomid, text, message_id % 25 AS e, {pattern} AS pattern FROM talk"
    return "WITH " + duck(talk=TALK) + f"asked AS ({asked}), cuts AS ({_CUTS}) " + query


def _first(word: str, value: str) -> str:
    return f"arg_min({value}, i) FILTER (w = {word} AND {value} IS NOT NULL)"


_N = "coalesce(TRY_CAST(NULLIF(regexp_replace({0}, '[^0-9.]', '', 'g'), '') AS DOUBLE), 0)"
_TXT = "CASE WHEN {0} IS NULL THEN '' WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {0}) END"
_FEE_FITS = "(e % 3 <> 0 OR company_short = '' OR contains(company_short, 'URGENT'))"
_SHARE_FITS = "(e % 4 <> 0 OR policy_type = '' OR policy_type = '机动车商业保险')"

ORACLE_SQL = {
    "M16_rules": _talk_sql(
        f"""SELECT message_id, CASE WHEN de IS NOT NULL OR the IS NOT NULL THEN roomid END AS plate, de, the FROM asked
      LEFT JOIN (SELECT row, {_first("'de'", "v20")} AS de, coalesce({_first("'the'", "v20")}, {_first("'The'", "v20")}) AS the FROM cuts GROUP BY row) USING (row)""",
        r"'d[ \t]*e|t[ \t]*h[ \t]*e|T[ \t]*h[ \t]*e'",
    ),
    "M16_many_tenants": _talk_sql(
        f"""SELECT message_id, e AS enterprise_id, CASE WHEN first IS NOT NULL OR second IS NOT NULL THEN roomid END AS plate, first, second, CAST(NULL AS VARCHAR) AS off FROM asked
      LEFT JOIN (SELECT row, {_first("CASE e % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'de' ELSE 'in' END", "v20")} AS first, {_first("CASE WHEN e % 2 = 0 THEN 'of' ELSE 'en' END", "v10")} AS second FROM cuts GROUP BY row) USING (row)""",
        r"(CASE (message_id % 25) % 3 WHEN 0 THEN 't[ \t]*h[ \t]*e' WHEN 1 THEN 'd[ \t]*e' ELSE 'i[ \t]*n' END) || '|' || (CASE WHEN (message_id % 25) % 2 = 0 THEN 'o[ \t]*f' ELSE 'e[ \t]*n' END)",
    ),
    "C6_many_tenants": sql("""SELECT id, CASE WHEN policy_type IN ('家财险', '') AND e % 3 <> 0 THEN '0.3' WHEN e % 2 <> 0 OR company_short = '' OR contains(company_short, 'HIGH') THEN
      CASE WHEN policy_type LIKE '%商业%' AND TRY_CAST(NULLIF(replace(total_premium, '元', ''), '') AS DOUBLE) >= e * 5000 THEN '0.2' WHEN id % 3 = 0 THEN '0.15' ELSE '0.1' END END AS ratio FROM (SELECT *, enterprise_id AS e FROM records)"""),
    "C7_many_tenants": sql(f"""SELECT id, {_TXT.format("net")} AS net, CASE WHEN {_FEE_FITS} THEN {_TXT.format("fee")} END AS fee, CASE WHEN {_SHARE_FITS} THEN {_TXT.format("share")} END AS share
      FROM (SELECT *, CASE WHEN e % 5 <> 0 AND id % 7 <> 0 THEN floor((({_N.format(_TXT.format("net"))} + CASE WHEN {_FEE_FITS} THEN {_N.format(_TXT.format("fee"))} ELSE 0 END) / (id % 7)) * 100) / 100 END AS share
      FROM (SELECT *, CASE WHEN e % 2 = 0 THEN floor((p - f) * 100) / 100 ELSE floor((p - f) * e / 10 * 100) / 100 END AS net
      FROM (SELECT *, CASE WHEN {_FEE_FITS} THEN {_N.format(_TXT.format("fee"))} ELSE 0 END AS f
      FROM (SELECT *, floor(p * (e + 1) / 100 * 100) / 100 AS fee FROM (SELECT *, enterprise_id AS e, {_N.format("total_premium")} AS p FROM records)))))"""),
}
