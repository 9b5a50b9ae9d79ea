"""Cars found through chains of records; conflicts; hot keys; against plain union-find."""

import random

from pyspark.sql import functions as F

from ledgerspark.operators import identity, ledger, renewal

SCHEMA = "id long, plate_no string, vin string, file_md5 string, insured string, applicant string, owner string"


def cars(spark, rows):
    """Groups of ids by car; rows are (id, plate, vin, file, insured)."""
    df = spark.createDataFrame([(i, p, v, f, a, "", None) for i, p, v, f, a in rows], SCHEMA)
    out = {}
    for r in identity.car_ids(df).collect():
        out.setdefault(r["car_id"], []).append(r["id"])
    assert all(min(ids) == car for car, ids in out.items())
    return sorted(sorted(ids) for ids in out.values())


V1, V2 = "LSVA000001", "LSVA000002"


def test_chain_of_five(spark):
    rows = [(1, "", "", "f1", "x"), (2, "京A1", "", "f1", ""), (3, "京-a1", "", "f2", ""), (4, "新车", V1.lower(), "f2", ""), (5, "京B1", V1, "", ""), (6, "京C1", "", "", "")]
    assert cars(spark, rows) == [[1, 2, 3, 4, 5], [6]]


def test_two_frame_numbers_under_one_plate(spark):
    rows = [(1, "京A1", V1, "", "甲"), (2, "京A1", V2, "", "乙"), (3, "京A1", "", "", "甲"), (4, "京A1", "", "", "乙"), (5, "京A1", "", "", "丙"), (6, "京B1", V2, "", ""), (7, "京B1", "", "", "丁")]
    assert cars(spark, rows) == [[1, 3], [2, 4, 6, 7], [5]]


def test_mixed_files_and_blanks_link_nothing(spark):
    rows = [(1, "京A1", "", "fleet", "甲"), (2, "京A2", "", "fleet", "乙"), (3, "", "", "fleet", ""), (4, "", "", "", "甲"), (5, "", "short", "", "丙"), (6, None, None, None, None), (7, "", "", "", "乙 "), (8, "京A3", "", "", "乙")]
    assert cars(spark, rows) == [[1, 4], [2], [3], [5], [6], [7], [8]]


def test_against_union_find(spark):
    random.seed(11)
    rows = [(i, random.choice(["", f"京A{random.randrange(60)}"]), "" if random.random() < 0.8 else f"LSVA{random.randrange(10**6):06d}", "", "") for i in range(1, 200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, p, v, _, _ in rows:
        for key in (p, v):
            if key:
                parent[root(key)] = root(i)
    parts, vins = {}, {}
    for i, _, v, _, _ in rows:
        parts.setdefault(root(i), []).append(i)
        vins.setdefault(root(i), set()).update([v] if v else [])
    plain = sorted(sorted(ids) for r, ids in parts.items() if len(vins[r]) < 2)
    got = cars(spark, rows)
    assert [ids for ids in got if ids in plain] == plain
    assert all(len({v for i, _, v, _, _ in rows if i in ids and v}) <= 1 for ids in got)


def test_long_path_and_star(spark):
    path = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)]
    star = [("hub", f"s{i}") for i in range(2000)]
    got = dict(map(tuple, identity.connected(spark.createDataFrame(path + star + [("z", "z")], "a string, b string")).collect()))
    assert {got[n] for e in path for n in e} == {"n0000"} and {got[n] for e in star for n in e} == {"hub"} and got["z"] == "z"


def test_hot_plate_is_reduced_before_it_is_exchanged(spark):
    edges = spark.range(20000).select(F.lit("p:hot").alias("a"), F.concat(F.lit("v:"), (F.col("id") % 3).cast("string")).alias("b"))
    assert identity.connected(edges.distinct()).count() == 4
    plan = edges.distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange")


def test_empty_and_used_by_merge_and_tasks(spark):
    kind = SCHEMA + ", policy_no string, policy_type string, total_premium string, company_short string, salesperson string, status string, doc_category string, deleted int, end_date date, enterprise_id long, sender string"
    assert identity.car_ids(spark.createDataFrame([], SCHEMA)).collect() == []
    rest = ("交强险", "10", "甲", "", "done", "保单", 0, __import__("datetime").date(2024, 6, 1), 7, "s")
    rows = spark.createDataFrame([(1, "京A1", "", "", "", "", "", "P1", *rest), (2, "京A1", V1, "", "", "", "", "P2", *rest), (3, "", V1, "", "", "", "", "P3", *rest)], kind)
    known = rows.join(identity.car_ids(rows), "id")
    merged = ledger.merge_by_car(known, car="car_id").collect()
    assert [(r["car"], r["n_records"], r["compulsory_cents"]) for r in merged] == [("1", 3, 3000)]
    found = renewal.tasks(known, "2024-05-20", "car_id").collect()
    assert [(r["customer_key"], r["record_ids"]) for r in found] == [("1", [1, 2, 3])]
