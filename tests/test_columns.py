"""Column helpers and compiled rules on edge values."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import columns as c
from ledgerspark.functions import rules as r
from ledgerspark.operators import messages as m
from ledgerspark.operators import quality as q
from ledgerspark.operators import text as t


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    return [row[0] for row in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_plates(spark):
    got = values(spark, c.plate_key, "粵b-0u9u0", "京A－12 34　5", "新车", "暂未上牌", "*-*", "", None, "京AD12345")
    assert got == ["粤B0U9U0", "京A12345", None, None, None, None, None, "京AD12345"]
    assert values(spark, c.hyphen_plate, "粤BB446T", "粤B-B446T", "ABC", None) == ["粤B-B446T", "粤B-B446T", "ABC", None]
    assert values(spark, c.repair_plate_letters, "京AO1I2") == ["京A0112"]
    assert values(spark, c.vin_key, "short", "lsva000000001", None) == [None, "LSVA000000001", None]


def test_dates(spark):
    d = datetime.date(2026, 6, 3)
    assert values(spark, c.parse_date, "2026-6-3", "2026/06/03", "2026年6月3日", "2026-06-80", "2026/05/", None) == [d, d, d, None, None, None]
    fmt = lambda x: c.format_date(x, "YYYY-MM-DD HH:mm")
    assert values(spark, fmt, "2026-06-2311:16", "2026年6月3日9时5", "20260603", "bad", "2026-02-31") == ["2026-06-23 11:16", "2026-06-03 09:05", "2026-06-03 00:00", "bad", "2026-02-31"]
    assert values(spark, lambda x: c.format_date(x, "YYYY/MM/DD", False), "2026-06-03") == ["2026/6/3"]


def test_amounts(spark):
    assert values(spark, c.amount, "1,234.56元", "¥1234", "12.5%", "-5", "", None, "none") == [1234.56, 1234.0, 0.125, -5.0, None, None, None]
    assert values(spark, c.formula_number, "-5", "1,234元", "", "1.2.3") == [5.0, 1234.0, 0.0, 0.0]
    got = values(spark, c.chinese_amount, "人民币壹佰捌拾玖元整", "叁亿贰仟万元", "拾元伍角陆分", "零元", None)
    assert [None if x is None else float(x) for x in got] == [189.0, 320000000.0, 10.56, None, None]


def test_classes(spark):
    got = values(spark, c.product_class, "交强险", "机动车商业保险", "驾乘险", "家财险", "", None, "药诊保")
    assert got == ["compulsory", "commercial", "accident", "non_vehicle", "accident", "accident", "accident"]
    assert values(spark, c.sort_class, "", "机动车辆综合险") == ["非车险", "商业险"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("保费合计 × 0.8 + 手续费", "850"), ("保费 * 2", "20"), ("-保费 + 3 × (2 - 5)", "-19"), ("保费 / 零", ""), ("保费 + 没有", "10"), ("2 *", ""), ("a; b", ""), ("1 / 3", "0.33"), ("", ""), ("(1", "")],
)
def test_formula(spark, text, want):
    names = {k: F.lit(v) for k, v in {"保费合计": "1000", "保费": "10元", "手续费": "50", "零": "0"}.items()}
    assert spark.range(1).select(r.formula_text(r.formula(text, names))).first()[0] == want


def test_formula_order():
    fs = [{"target": "b", "expr": "a + 1"}, {"target": "a", "expr": "1"}]
    assert [f["target"] for f in r.ordered(fs)] == ["a", "b"]
    circle = [{"target": "a", "expr": "b"}, {"target": "b", "expr": "a"}]
    assert [f["target"] for f in r.ordered(circle)] == ["a", "b", "a", "b"]


def test_alias_and_percent(spark):
    assert values(spark, lambda x: r.alias(x, {"人保": "P", "人保财险": "PICC", "x": "y"}), "人保财险北京", "人保", "x", "other") == ["PICC", "P", "y", "other"]
    assert values(spark, r.percent_to_number, "10", "10%", "x", None) == [0.1, 0.1, None, None]
    assert values(spark, lambda x: r.number_to_percent(x.cast("double")), "0.1", "0.125", None) == ["10%", "12.5%", None]


def test_quote_texts(spark):
    df = spark.createDataFrame([(1, "粤BW44C6 商业20 交强：3 驾意 20 13480707210 小张"), (2, "粤BW44C6 你好"), (3, "商业20"), (4, None), (5, "车牌：ab 12 业务员：王五")], "i int, text string")
    rows = {x["i"]: x for x in m.parse_quotes(df).collect()}
    assert rows[1]["plate"] == "粤BW44C6" and rows[1]["fields"]["政策商业险"] == "20" and rows[1]["fields"]["电话"] == "13480707210" and rows[1]["fields"]["业务渠道"] == "小张"
    assert rows[2]["plate"] is None and rows[3]["plate"] is None and rows[4]["plate"] is None
    assert rows[5]["plate"] == "AB12" and rows[5]["fields"]["业务员#2"] == "王五"


def test_configured_quotes(spark):
    rules = [{"target": "员", "keywords": ["业务员"]}, {"target": "渠", "keywords": ["出单渠道", "渠道"]}, {"target": "费", "keywords": ["费率"], "value_type": "percent"}, {"target": "", "keywords": ["z"]}]
    df = spark.createDataFrame([("粤B12345 业 务 员：出单渠道：演示 费率 5%",), ("粤B12345",)], "text string")
    a, b = m.parse_with_rules(df, rules).select("plate", "fields").collect()
    assert a["fields"] == {"渠": "演示", "费": "5%"} and b["plate"] is None


def test_ledger_commands(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["发送台账 今天", "发送台账本周", "发送台账6月25日到7月5日", "发送台账6月31日", "发送台账6-10日", "发送台账6月9日到3日", "hello", None])], "i int, text string")
    got = [(x["label"], str(x["first_day"]), str(x["end_day"])) for x in m.ledger_commands(df, "2026-06-17").orderBy("i").collect()]
    none = (None, "None", "None")
    assert got == [("今日", "2026-06-17", "2026-06-18"), ("本周", "2026-06-15", "2026-06-22"), ("6月25日-7月5日", "2026-06-25", "2026-07-06"), none, ("6月6日-10日", "2026-06-06", "2026-06-11"), none, none, none]


def test_documents(spark):
    got = values(spark, t.document_category, "电子保单 保险单号", "投保人声明", "投保单 投保人 张三", "发票号码", "(CID:1)", "", None)
    assert got == ["保单", "条款", "投保单", "发票", "其他", "未知", "未知"]
    assert values(spark, t.page_range, "[PAGE:2][PAGE:1]", "[PAGE:1][PAGE:3]", "", None)[:3] == ["1-2", "1,3", ""]
    assert values(spark, t.undouble, "黄黄宝宝 x 0000 449999", None) == ["黄宝 x 0000 499", None]
    assert values(spark, t.clean_digits, "1 2 3 年 4 月") == ["123年4月"]
    df = spark.createDataFrame([(1, "标题A 保费1 车架2 " + "x" * 60 + "标题A 保费3 车架4"), (2, "nothing"), (3, None)], "doc_id long, text string")
    parts = t.split_policies(df, ["标题A"], ["保费", "车架"]).collect()
    assert sorted((p["doc_id"], p["part"]) for p in parts) == [(1, 0), (1, 1), (2, 0)]


def test_abnormal(spark):
    full = {"保险公司简称": "甲", "保单号": "1", "险种类型": "交强险", "车牌号": "京A12345", "投保人": "张三", "被保险人": "张三", "签单日期": "2026-06-03", "保险起期": "2026-06-03", "保险止期": "2027-06-02", "保费合计": "1"}
    rows = [(1, "done", "保单", full), (2, "done", None, full | {"投保人": ""}), (3, "success", "保单", full | {"签单日期": "2026/05/"}), (4, "failed", "保单", {}), (5, "done", "批单", {}), (6, "done", "", full | {"车牌号": "", "新车未上牌": "1"})]
    df = spark.createDataFrame(rows, "id int, status string, doc_category string, fields map<string,string>").withColumn("override_reason", F.lit(""))
    got = {x["id"]: (x["abnormal"], x["hint"]) for x in q.abnormal(df).collect()}
    assert got == {1: (False, ""), 2: (True, "缺少：投保人(交强险通常无)"), 3: (True, "日期不全：签单日期"), 4: (False, ""), 5: (False, ""), 6: (True, "新车无车牌")}


def test_second_reader(spark):
    df = spark.createDataFrame([(1, {"保费合计": "10", "投保人": "甲", "车牌号": ""}, {"保费合计": "¥10.00", "投保人": "乙", "车牌号": "京A1"}, ["投保人"], "x"), (2, {"保费合计": "10"}, {"保费合计": "12"}, None, "共 12.00 元")], "id int, fields map<string,string>, ai_fields map<string,string>, manual_fields array<string>, raw_text string")
    names = ["保费合计", "投保人", "车牌号"]
    got = {x["id"]: (x["result"], x["n_flagged"], x["fixed"]) for x in q.settle(q.differences(df, names), names).collect()}
    assert got[1] == ("flagged", 1, {"保费合计": "10", "投保人": "甲", "车牌号": "京A1"})
    assert got[2] == ("corrected", 0, {"保费合计": "12"})


def test_driver_quotes(spark):
    """Premiums of the driver's cover by its front and back part, with and without the word for cover."""
    df = spark.createDataFrame([(1, "粤BW44C6 业务员 王五 驾意后 12 驾意险前端：3"), (2, "粤BW44C6 驾意前端 3"), (3, "粤BW44C6 商业后端 3 商业 8")], "i int, text string")
    rows = {x["i"]: x["fields"] for x in m.parse_quotes(df).collect()}
    assert rows[1] == {"业务员#2": "王五", "驾意后端": "12", "驾意前端": "3"} and rows[2] is None and rows[3] == {"商业后端": "3", "政策商业险": "8"}
