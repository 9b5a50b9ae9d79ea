"""Laws of the ledger jobs on the driver's tables and on small frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions.columns import cents
from ledgerspark.operators import fill, ledger, renewal
from ledgerspark.plans.proxies import records
from ledgerspark.sources import tables
from tests.conftest import SMALL


def test_merge_keeps_amounts(spark):
    rows = records(spark, SMALL)
    merged = ledger.merge_by_car(rows).agg(F.sum(F.col("commercial_cents") + F.col("compulsory_cents") + F.col("other_cents"))).first()[0]
    each = ledger.merge_by_car(rows).select("car", F.explode("record_ids").alias("id"))
    first = rows.join(each, "id").groupBy("car", F.coalesce(F.nullif("policy_no", F.lit("")), F.concat(F.lit("#"), "id"))).agg(F.min_by(cents(F.col("total_premium")), "id").alias("c"))
    assert merged == first.agg(F.sum("c")).first()[0]
    assert each.count() == rows.count()


def test_fill_keeps_values(spark):
    rows = records(spark, SMALL)
    fields = ["owner", "id_number"]
    for job in (fill.fill_same_plate, fill.fill_same_vin, fill.fill_by_person):
        j = job(rows, fields).select("id", *[F.col(c).alias(f"n_{c}") for c in fields]).join(rows, "id")
        assert j.count() == rows.count()
        for c in fields:
            assert j.where((F.col(c) != "") & ~F.col(f"n_{c}").eqNullSafe(F.col(c))).count() == 0


def test_deduplicate_twice(spark):
    once = ledger.deduplicate(records(spark, SMALL))
    assert ledger.deduplicate(once).count() == once.count()


def test_upsert_twice(spark):
    t = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    i = spark.createDataFrame([(" a ", "9"), ("c", "3"), ("b", ""), ("", "7"), (None, "8")], "k string, v string")
    once = tables.upsert(t, i, "k")
    assert sorted(map(tuple, once.collect())) == [("a", "9", "updated"), ("b", "2", "updated"), ("c", "3", "inserted")]
    twice = tables.upsert(once.drop("outcome"), i, "k")
    assert sorted((r["k"], r["v"]) for r in twice.collect()) == [("a", "9"), ("b", "2"), ("c", "3")]


def test_fill_limits(spark):
    rows = [(i, "京A12345", "" if i == 99 else f"VIN{0:09d}" if i != 5 else "OTHERVIN0001", "" if i > 3 else f"o{i}", 0, "done") for i in [1, 2, 3, 5, *range(90, 100)]]
    df = spark.createDataFrame(rows, "id long, plate_no string, vin string, owner string, deleted int, status string")
    got = {r["id"]: r["owner"] for r in fill.fill_same_plate(df, ["owner"]).collect()}
    assert got[99] == "o3" or got[99] is None  # the ten newest others are 98..90 and 5: no owner among them
    assert got[99] is None and got[1] == "o1"


def test_priority(spark):
    df = spark.createDataFrame([(d,) for d in ("2026-06-01", "2026-06-24", "2026-06-25", "2026-07-17", "2026-07-18")], "d string").select(renewal.priority(F.col("d").cast("date"), "2026-06-17"))
    assert [r[0] for r in df.collect()] == [2, 2, 1, 1, 0]


def test_related_by_applicant(spark):
    """Policies that share an applicant only, dated by sign date, else start date, else creation."""
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    rows = [
        (1, "A", day(0), day(300), day(300), "家财险"), (2, "A", day(20), day(0), day(0), "机动车商业保险"),
        (3, "B", None, day(0), day(300), "家财险"), (4, "B", None, None, day(25), "机动车商业保险"),
        (5, "C", day(0), day(0), day(0), "家财险"), (6, "C", day(90), day(0), day(0), "机动车商业保险"),
        (7, "", day(0), day(0), day(0), "家财险"), (8, "", day(0), day(0), day(0), "机动车商业保险"),
    ]
    df = spark.createDataFrame(rows, "id long, applicant string, sign_date date, start_date date, created_day date, policy_type string")
    df = df.withColumns({"plate_no": F.lit(""), "vin": F.lit(""), "deleted": F.lit(0)})
    got = {r["id"] for r in fill.related(df, "commercial", 30, fill.RELATED_BY, fill.policy_day()).where("related").collect()}
    assert got == {1, 3}
    with pytest.raises(ValueError):
        fill.related(df, "commercial", 30, ("owner",))


def test_parties(spark):
    """Motor policies take longer valid names of motor policies, others the newest motor one; hand-edited fields stay."""
    rows = [
        (1, "京A11111", "机动车商业保险", "张三", "李四", "甲", None), (2, "京A11111", "机动车交通事故责任强制保险", "张三丰", "李四", "", None), (3, "京A11111", "家财险", "王五", "赵六", "乙", None),
        (4, "京A11111", "家财险", "王五", "赵六", "乙", ["insured"]), (5, "", "家财险", "孙七", "", "", None),
    ]
    df = spark.createDataFrame(rows, "id long, plate_no string, policy_type string, insured string, applicant string, owner string, manual_fields array<string>").withColumn("deleted", F.lit(0))
    got = {r["id"]: (r["insured"], r["applicant"], r["owner"]) for r in fill.correct_parties(df, manual="manual_fields").collect()}
    assert got == {1: ("张三丰", "李四", "甲"), 2: ("张三丰", "李四", ""), 3: ("张三丰", "李四", "乙"), 4: ("王五", "李四", "乙"), 5: ("孙七", "", "")}


def test_suspect_insurer(spark):
    rows = [(1, "h", "机动车交通事故责任强制保险", "平安", "张"), (2, "h", "机动车商业保险", "人保", "张三"), (3, "g", "机动车交通事故责任强制保险", "平安", "")]
    df = spark.createDataFrame(rows, "id long, file_md5 string, policy_type string, company_short string, insured string")
    got = {r["id"]: (r["company_short"], r["insured"]) for r in fill.fill_same_file(df, [], ["insured"]).collect()}
    assert got == {1: ("人保", "张三"), 2: ("人保", "张三"), 3: ("平安", None)}


def test_newest_of_all_people(spark):
    """The 20 newest records that share any person lend, not the 20 newest of each person."""
    rows = [(i, "A", "", "", 0, "done", "家财险", f"a{i}" if i == 1 else "") for i in range(1, 20)] + [(i, "", "B", "", 0, "done", "家财险", f"b{i}" if i == 30 else "") for i in range(30, 50)] + [(99, "A", "B", "", 0, "done", "家财险", "")]
    df = spark.createDataFrame(rows, "id long, insured string, applicant string, owner string, deleted int, status string, policy_type string, id_number string")
    got = {r["id"]: r["id_number"] for r in fill.fill_by_person(df, ["id_number"]).collect()}
    assert got[99] == "b30" and got[5] == "a1"


def test_export_of_completed_ledger(spark):
    """The ledger's blanks come from all records of the tenant, then columns are added, then cars are merged."""
    rows = records(spark, SMALL)
    plain = tables.export_ledger(rows, 7, "1995-01-01", "2002-01-01")
    done = tables.export_ledger(rows, 7, "1995-01-01", "2002-01-01", complete=tables.completed(["id_number", "owner"]), columns=lambda x: x.withColumn("tag", F.lit("t")))
    assert sorted(r["id"] for r in plain.select("id").collect()) == sorted(r["id"] for r in done.select("id").collect()) and "tag" in done.columns
    blank = lambda x: x.where("coalesce(owner, '') = ''").count()
    assert blank(done) < blank(plain)
    assert tables.export_ledger(rows, 7, "1995-01-01", "2002-01-01", True, tables.completed(["id_number", "insured"])).count() > 0


def test_search_conditions(spark):
    rows = records(spark, SMALL)
    assert ledger.search(rows, user_ids=[]).count() == 0 and ledger.search(rows, where_from="user").where("roomid != ''").count() == 0
    with pytest.raises(ValueError):
        ledger.search(rows, colour="red")


def test_last_upsert(spark):
    t = spark.createDataFrame([("a", "1")], "k string, v string")
    i = spark.createDataFrame([("a", "9", 1), ("a", "3", 2), ("a", "", 3)], "k string, v string, n int")
    assert [tuple(r) for r in tables.upsert(t, i, "k", "n").collect()] == [("a", "3", "updated")]


def test_plans_read_once(spark, capsys):
    """Related policies and merged cars: few scans, whatever the number of keys."""
    for df, most in ((fill.related(records(spark, SMALL), "commercial", 30, fill.RELATED_BY, fill.policy_day()), 8), (ledger.merge_by_car(records(spark, SMALL)), 2)):
        df.explain()
        assert capsys.readouterr().out.count("FileScan") <= most
