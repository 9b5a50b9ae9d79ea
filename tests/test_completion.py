"""Pools, dates and related policies from hand-made records; ids of the registered views."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import fill
from ledgerspark.plans import analytics, renewal
from ledgerspark.plans.proxies import view
from tests.conftest import SMALL

D = dt.date
COMPULSORY, COMMERCIAL = "机动车交通事故责任强制保险", "机动车商业保险"
SCHEMA = "id long, deleted int, status string, plate_no string, vin string, policy_type string, start_date date, end_date date, owner string, id_number string, applicant string, filename string"


def records(spark, rows):
    base = {"deleted": 0, "status": "done", "plate_no": "京A12345", "vin": "", "policy_type": COMPULSORY, "start_date": None, "end_date": None, "owner": "", "id_number": "", "applicant": "", "filename": ""}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((base | r)[c] for c in names) for r in rows], SCHEMA)


def test_only_finished_records_lend(spark):
    df = records(spark, [{"id": 1, "owner": "old"}, {"id": 2, "owner": "failed", "status": "failed"}, {"id": 3, "owner": "gone", "deleted": 1}, {"id": 4, "owner": ""}])
    assert [r["owner"] for r in fill.plate_pool(df, ["owner"]).collect()] == ["old"]


def test_newest_record_decides_dates(spark):
    rows = [
        {"id": 1, "start_date": D(2024, 1, 1), "end_date": D(2025, 12, 31)},
        {"id": 2, "start_date": D(2023, 1, 1), "end_date": D(2024, 12, 31)},  # a correction, earlier than the one before
        {"id": 3, "start_date": D(2026, 1, 1), "end_date": D(2027, 1, 1), "status": "failed"},
        {"id": 4},
        {"id": 5, "policy_type": COMMERCIAL, "start_date": D(2023, 2, 3), "end_date": D(2024, 2, 2)},
        {"id": 6, "policy_type": "驾乘人员意外险", "start_date": D(2029, 2, 3)},
    ]
    df = records(spark, rows)
    assert [tuple(r) for r in fill.latest_compulsory_end(df).collect()] == [("京A12345", D(2024, 12, 31), 2)]
    assert [r["dates"] for r in fill.dual_dates(df).collect()] == ["2023-02-03交1/1"]
    assert [r["dates"] for r in fill.dual_dates(df, "end_date").collect()] == ["2024-02-02交12/31"]


def test_failed_policies_are_not_related(spark):
    rows = [{"id": 1, "policy_type": COMMERCIAL, "start_date": D(2024, 1, 1)}, {"id": 2, "policy_type": COMMERCIAL, "start_date": D(2024, 1, 5), "status": "failed"}, {"id": 3, "start_date": D(2024, 1, 3)}]
    got = {r["id"]: r["related"] for r in fill.related(records(spark, rows), "commercial", 30).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_fill_by_pools(spark):
    rows = [
        {"id": 1, "vin": "lsva000001", "owner": "甲"},
        {"id": 2, "plate_no": "", "vin": "LSVA000001"},  # plate and owner from the frame number
        {"id": 3, "plate_no": "", "filename": "报价京A-12345.pdf"},  # plate from the file, then frame number from the plate
        {"id": 4, "plate_no": "新车", "vin": "short"},  # neither
        {"id": 5, "plate_no": "京B00001"},
    ]
    got = {r["id"]: (r["plate_no"], r["vin"], r["owner"]) for r in fill.fill_by_pools(records(spark, rows)).collect()}
    assert got == {1: ("京A12345", "lsva000001", "甲"), 2: ("京A12345", "LSVA000001", "甲"), 3: ("京A12345", "LSVA000001", None), 4: ("新车", "short", None), 5: ("京B00001", None, None)}


@pytest.mark.parametrize("sql, key", [(analytics.EXPORTS, "export_id"), (analytics.AI_LOGS, "log_id"), (renewal.FOLLOWUPS, "followup_id"), (analytics.TRANSACTIONS, "tx_id"), (analytics.OPTIONS, "option_id"), (analytics.PLANS, "order_id"), (renewal.TASKS, "task_id")])
def test_ids_are_unique(spark, sql, key):
    df = view(spark, SMALL, sql)
    assert df.count() == df.select(key).distinct().count()


def test_export_page_breaks_ties(spark):
    from ledgerspark.operators.analytics import export_page

    rows = spark.createDataFrame([(1, "a", "done", i) for i in range(40)], "export_id long, export_type string, status string, row_count long")
    pages = [r["row_count"] for k in (1, 2, 3, 4) for r in export_page(rows.repartition(7, F.rand()), k, 10).collect()]
    assert sorted(pages) == list(range(40))
