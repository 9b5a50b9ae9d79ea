"""Rules of many tenants in one plan: keyword rules, ratios and formulas, against plain Python and the compiled rules."""

import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import rule_tables as t
from ledgerspark.functions import rules as r
from ledgerspark.operators import messages as m
from tests.conftest import SMALL

WORDS = [{"target": "员", "keywords": ["业务员"]}, {"target": "渠", "keywords": ["出单渠道", "渠道"]}, {"target": "费", "keywords": ["费率"], "value_type": "percent"}, {"target": "电", "keywords": ["电话"], "value_type": "phone"}, {"target": "额", "keywords": ["保费", "金额"], "value_type": "number"}, {"target": "处", "keywords": ["出单处"], "value_type": "short"}]
#: Twenty texts and what the rules above find in them.
TEXTS = [
    ("业务员：王五", {"员": "王五"}),
    ("业 务 员 王五", {"员": "王五"}),
    ("业务员：\n王五", None),
    ("业务员：出单渠道：演示", {"渠": "演示"}),
    ("渠道 甲 出单渠道 乙", {"渠": "乙"}),
    ("渠道：甲，渠道：乙", {"渠": "甲"}),
    ("费率 5%", {"费": "5%"}),
    ("费率：5.25", {"费": "5.25"}),
    ("费率：百分之五", None),
    ("电话：15778", {"电": "15778"}),
    ("电话 010-8888 1234", {"电": "010-8888 1234"}),
    ("电话：无，电话：138", {"电": "138"}),
    ("保费1200.50元", {"额": "1200.50"}),
    ("金额 7 保费 8", {"额": "8"}),
    ("保费待定 金额 7", {"额": "7"}),
    ("出单处：一二三四五六七八九十甲乙", {"处": "一二三四五六七八九十"}),
    ("业务员王五出单处天河店", {"员": "王五", "处": "天河店"}),
    ("业务员:王五;费率3 出单处 甲", {"员": "王五", "费": "3", "处": "甲"}),
    ("什么也没有", None),
    ("", None),
]


def test_twenty_texts(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(TEXTS)], "i int, text string")
    got = {x["i"]: x["fields"] for x in m.parse_with_rules(df, WORDS, F.lit("p")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(TEXTS)}


def by_hand(text, rules):
    """Each occurrence of each keyword, and the characters behind it up to a blank, a mark or any keyword."""
    words = {k for x in rules for k in x["keywords"]}
    begins = lambda k, at: re.compile(r"[ \t]*".join(map(re.escape, k))).match(text, at)
    out = {}
    for rule in rules:
        for k in rule["keywords"]:
            for at in range(len(text)):
                hit = begins(k, at)
                if not hit or rule["target"] in out:
                    continue
                end = re.compile(r"[ \t]*[:：]?[ \t]*").match(text, hit.end()).end()
                value = ""
                while end < len(text) and len(value) < 20 and not re.match(r"[\s，,。、；;:：]", text[end]) and not any(begins(w, end) for w in words):
                    value, end = value + text[end], end + 1
                if value:
                    out[rule["target"]] = value
    return out or None


def test_keywords_by_hand(spark):
    rules = [{"target": "de", "keywords": ["de"]}, {"target": "the", "keywords": ["the", "The"]}]
    talk = spark.read.parquet(f"{SMALL}/conversations.parquet").withColumn("id", F.monotonically_increasing_id()).select("id", "text").cache()
    got = {x["id"]: x["fields"] for x in m.parse_with_rules(talk, rules, F.lit("p")).collect()}
    assert got == {x["id"]: by_hand(x["text"] or "", rules) for x in talk.collect()}
    assert sum(v is not None for v in got.values()) > 10


def test_tenants_have_their_own_words(spark):
    rules = spark.createDataFrame([(1, 1, "a", ["甲", "乙"], "number", True), (2, 1, "a", ["丙"], None, True), (2, 2, "b", ["甲"], "text", False), (3, 1, "", ["甲"], "text", True), (4, 1, "x", ["a.b", "(c"], "text", None)], "enterprise_id long, rule_no int, target string, keywords array<string>, value_type string, enabled boolean")
    texts = spark.createDataFrame([(1, "乙 3 甲 4"), (2, "甲 5 丙 6"), (3, "甲 7"), (4, "axb 1 a.b 8"), (5, "甲 9"), (1, None)], "enterprise_id long, text string")
    got = {x["enterprise_id"]: x["fields"] for x in m.parse_with_rule_table(texts, t.keyword_table(rules), F.lit("p")).where("text is not null").collect()}
    assert got == {1: {"a": "4"}, 2: {"a": "6"}, 3: None, 4: {"x": "8"}, 5: None}


FIELDS = ["保费", "手续费", "手续", "分母"]
FORMULAS = ["保费 × 0.8 - 手续费 ÷ 3", "(保费 + 手续) / 分母", "-(2 - 5) * 1.5 + .25", "保费 / 0", "2 *", "(1", "1)", "", "保费 手续", "--3 - -保费", "+分母 * -2", "未知字段 + 1", "保费 $ 2", "2 * (3 + (4 - 1)) / 3"]


def test_programs_equal_compiled_formulas(spark):
    rows = spark.createDataFrame([(1, "1,234.5元", "-7", "3", "4"), (2, "", None, "x", "0"), (3, "9", "2", "1", "0.5")], "id int, `保费` string, `手续费` string, `手续` string, `分母` string")
    programs = [t.postfix(x, FIELDS) for x in FORMULAS]
    array = F.array(*[F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("text")) for k, v in p]) if p is not None else F.lit(None).cast(t.PROGRAM) for p in programs])
    run = F.transform(array, lambda p: t.run_program(p, t.texts_of(FIELDS)))
    compiled = F.array(*[r.formula(x, {c: F.col(c) for c in FIELDS}) for x in FORMULAS])
    for row in rows.select(run.alias("run"), compiled.alias("compiled")).collect():
        assert row["run"] == row["compiled"]


def test_order_of_formulas():
    assert t.run_order([(1, "c", "a+b"), (2, "b", "a*2"), (3, "a", "x")]) == [3, 2, 1]
    assert t.run_order([(1, "a", "b"), (2, "b", "a"), (3, "c", "1")]) == [3, 1, 2, 1, 2]


def test_thousand_tenants_in_one_plan(spark):
    """Each tenant has formulas of its own; the plan is as long for a thousand tenants as for ten."""
    sizes = []
    for n in (10, 1000):
        formulas = spark.range(n).select(F.col("id").alias("enterprise_id"), F.explode(F.array(F.struct(F.lit(1).alias("formula_no"), F.lit("b").alias("target"), F.concat(F.lit("a - "), F.col("id").cast("string")).alias("expr")), F.struct(F.lit(2).alias("formula_no"), F.lit("a").alias("target"), F.concat(F.lit("x * "), (F.col("id") + 1).cast("string")).alias("expr")))).alias("f")).select("enterprise_id", "f.*", F.lit("").alias("company"), F.lit("").alias("product"))
        records = spark.range(3 * n).select("id", (F.col("id") % n).alias("enterprise_id"), F.lit("甲").alias("company_short"), F.lit("").alias("policy_type"), F.lit("1000").alias("x"))
        out = t.apply_formula_table(records, t.formula_table(formulas, ["x"]), ["x"])
        sizes.append(len(out._jdf.queryExecution().analyzed().toString()))
        for row in out.select("enterprise_id", "computed").collect():
            e = row["enterprise_id"]
            assert row["computed"] == {"a": str(1000 * (e + 1)), "b": str(1000 * (e + 1) - e)}
    assert abs(sizes[0] - sizes[1]) < 200


@pytest.mark.parametrize("op, value, fits", [("eq", "20", True), ("ne", "20", False), ("contains", "2", True), ("not_contains", "3", True), ("gt", "19.9", True), ("ge", "20", True), ("lt", "20", False), ("le", "x", False), ("empty", "", False), ("not_empty", "", True), ("exists", "", False), ("unknown", "", False)])
def test_conditions(spark, op, value, fits):
    c = F.struct(F.lit("f").alias("field"), F.lit(op).alias("op"), F.lit(value).alias("value"))
    assert spark.range(1).select(t.holds(c, F.create_map(F.lit("f"), F.lit("20")))).first()[0] is fits


def test_ratio_tables(spark):
    kind = "enterprise_id long, rule_no int, target string, company string, product string, branches array<struct<conditions:array<struct<field:string,op:string,value:string>>,value:string>>, fallback string"
    rules = spark.createDataFrame([(1, 1, "比", "甲", "", [([("x", "ge", "10")], "0.2"), ([], "0.9")], "0.1"), (1, 2, "比", "", "商业", [], None), (1, 3, "另", "乙", "", [], "7")], kind)
    rows = spark.createDataFrame([(1, 1, "甲公司", "交强", "12"), (2, 1, "甲", "商业险", "1"), (3, 1, "乙", "", "99"), (4, 2, "甲", "", "99")], "id int, enterprise_id long, company_short string, policy_type string, x string")
    got = {x["id"]: x["ratios"] for x in t.apply_ratio_table(rows, rules, ["x"]).collect()}
    assert got == {1: {"比": "0.2"}, 2: {"比": "0.1"}, 3: {"另": "7"}, 4: {}}
    assert math.isclose(0.2, float(got[1]["比"]))
