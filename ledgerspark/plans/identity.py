"""Registered queries of car identity, with their SQL: connections by a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.operators import identity
from ledgerspark.plans.analytics import sql
from ledgerspark.plans.ledger import PLATE, VIN
from ledgerspark.plans.proxies import view

#: Cars with blanks, second plates, files, and for one customer in ten two frame numbers.
CARS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 < 3 THEN '' WHEN o_orderkey % 7 = 3 AND o_custkey % 3 = 0 THEN '京B-' || lpad(CAST(o_custkey AS STRING), 6, '0') ELSE '京A-' || lpad(CAST(o_custkey AS STRING), 6, '0') END AS plate_no,
  CASE WHEN o_orderkey % 5 < 3 THEN '' ELSE 'lsva' || lpad(CAST(o_custkey * 2 + CASE WHEN o_custkey % 10 = 0 THEN o_orderkey % 2 ELSE 0 END AS STRING), 10, '0') END AS vin,
  CASE WHEN o_orderkey % 3 = 0 THEN 'f' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 4 AS STRING) WHEN o_orderkey % 41 = 0 THEN 'fleet' ELSE '' END AS file_md5,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE c_name END AS insured, CASE WHEN o_orderkey % 2 = 0 THEN c_name || ' even' ELSE '' END AS applicant, CASE WHEN o_orderkey % 13 = 0 THEN c_name || ' ' || CAST(o_orderkey % 3 AS STRING) ELSE '' END AS owner,
  o_totalprice AS price
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""


def _cars(s, d):
    rows = view(s, d, CARS)
    return rows.join(identity.car_ids(rows), "id").groupBy("car_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct(F.nullif("plate_no", F.lit(""))).alias("n_plates"), F.count_distinct(F.nullif("vin", F.lit(""))).alias("n_vins"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"))


QUERIES = {
    "F8_car_ids": lambda s, d: identity.car_ids(view(s, d, CARS)),
    "L8_cars": _cars,
}

_PARTIES = "list_distinct(list_filter([trim(insured), trim(applicant), trim(owner)], lambda x: x <> ''))"
#: Tables up to the car of each record.
_STEPS = {
    "nodes": f"SELECT id, 'p:' || ({PLATE}) AS p, 'v:' || ({VIN}) AS v, 'f:' || NULLIF(file_md5, '') AS f0, {_PARTIES} AS parties FROM cars",
    "files": "SELECT f0, count(DISTINCT p) > 1 OR count(DISTINCT v) > 1 AS mixed FROM nodes WHERE f0 IS NOT NULL GROUP BY f0",
    "rows_": "SELECT id, p, v, CASE WHEN NOT mixed THEN f0 END AS f, parties FROM nodes LEFT JOIN files USING (f0)",
    "ways": "SELECT a, b FROM (SELECT p AS a, v AS b FROM rows_ UNION SELECT v, p FROM rows_ UNION SELECT p, f FROM rows_ UNION SELECT f, p FROM rows_ UNION SELECT v, f FROM rows_ UNION SELECT f, v FROM rows_) WHERE a IS NOT NULL AND b IS NOT NULL",
    "reached": "SELECT n AS a, n AS b FROM (SELECT p AS n FROM rows_ UNION SELECT v FROM rows_ UNION SELECT f FROM rows_) WHERE n IS NOT NULL UNION SELECT r.a, w.b FROM reached r JOIN ways w ON w.a = r.b",
    "labels": "SELECT a AS node, min(b) AS label FROM reached GROUP BY a",
    "placed": "SELECT *, count(DISTINCT v) OVER (PARTITION BY label) > 1 AND label IS NOT NULL AS several FROM rows_ LEFT JOIN labels ON node = coalesce(v, p, f)",
    "plates": "SELECT p, min(v) AS plate_v FROM placed WHERE several AND p IS NOT NULL GROUP BY p HAVING count(DISTINCT v) = 1",
    "people": "SELECT label, party, min(v) AS low, max(v) AS high FROM (SELECT label, v, unnest(parties) AS party FROM placed WHERE several AND v IS NOT NULL) GROUP BY 1, 2",
    "asked": "SELECT id, min(low) AS party_v FROM (SELECT id, label, unnest(parties) AS party FROM placed WHERE several AND v IS NULL) JOIN people USING (label, party) GROUP BY id HAVING min(low) = max(high)",
    "named": "SELECT id, parties, CASE WHEN NOT several THEN label ELSE coalesce(v, plate_v, party_v, 'c:' || label) END AS car FROM placed LEFT JOIN plates USING (p) LEFT JOIN asked USING (id)",
    "owners": "SELECT party, min(car) AS low, max(car) AS high FROM (SELECT car, unnest(parties) AS party FROM named WHERE car IS NOT NULL) GROUP BY 1",
    "alone": "SELECT id, min(low) AS person_car FROM (SELECT id, unnest(parties) AS party FROM named WHERE car IS NULL) JOIN owners USING (party) GROUP BY id HAVING min(low) = max(high)",
    "final": "SELECT id, min(id) OVER (PARTITION BY coalesce(car, person_car, '#' || CAST(id AS VARCHAR))) AS car_id FROM named LEFT JOIN alone USING (id)",
}


def _identity(query: str) -> str:
    steps = ", ".join(f"{name} AS ({text})" for name, text in _STEPS.items())
    return sql(", " + steps + " " + query, cars=CARS).replace("WITH ", "WITH RECURSIVE ", 1).replace(") , nodes", "), nodes", 1)


ORACLE_SQL = {
    "F8_car_ids": _identity("SELECT id, car_id FROM final"),
    "L8_cars": _identity("SELECT car_id, count(*) AS n_records, count(DISTINCT NULLIF(plate_no, '')) AS n_plates, count(DISTINCT NULLIF(vin, '')) AS n_vins, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents FROM final JOIN cars USING (id) GROUP BY car_id"),
}
