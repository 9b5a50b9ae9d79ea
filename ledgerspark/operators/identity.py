"""Identity of cars (F8, R2, L8): records of one car, found through plates, frame numbers, files and parties.

Plates, frame numbers and files are nodes, a record links those that it holds, and what is connected is one car, unless it has several
frame numbers: a plate that went to another car, or was read wrong.  Then each frame number is a car, and records without one go where their
plate, else their parties, point to one of them alone.  Records without any node go to the only car of their parties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.columns import blank_to_null, plate_key, vin_key
from ledgerspark.sources.shared import cut

PARTIES = ("insured", "applicant", "owner")


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node reachable) of each node of ``edges`` (``a``, ``b``, strings; a loop is a node alone).

    Each round a node takes the least label around it, then the label of that label, so labels travel twice as far each round.  Minima are made
    before rows are exchanged, so a node with very many edges is no hot key; every round is kept in the shared folder.
    """
    pairs = edges.where("a is not null and b is not null")
    both = cut(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("near")).agg(F.min("label").alias("least"))
        step = labels.join(around, F.col("node") == F.col("near")).select("node", F.least("label", "least").alias("now"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("now"), F.col("label").alias("next"))
        after = cut(step.join(jump, "now", "left").select("node", F.least("now", "next").alias("label"), (F.least("now", "next") != F.col("was")).alias("moved")))
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels


def keyed(records: DataFrame, file: str = "file_md5") -> DataFrame:
    """``id``, the nodes ``p``, ``v`` and ``f`` of each record, and its ``parties``.  A file with several plates or frame numbers is no node."""
    parties = F.array_distinct(F.filter(F.array(*[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in PARTIES]), lambda x: x != ""))
    node = lambda kind, c: F.when(c.isNotNull(), F.concat(F.lit(kind), c))
    rows = records.select("id", node("p:", plate_key(F.col("plate_no"))).alias("p"), node("v:", vin_key(F.col("vin"))).alias("v"), node("f:", blank_to_null(F.col(file))).alias("f"), parties.alias("parties"))
    mixed = rows.where("f is not null").groupBy("f").agg(F.min("p").alias("p1"), F.max("p").alias("p2"), F.min("v").alias("v1"), F.max("v").alias("v2")).where("p1 != p2 or v1 != v2").select("f", F.lit(True).alias("mixed"))
    return rows.join(mixed, "f", "left").withColumn("f", F.when(F.col("mixed").isNull(), F.col("f"))).drop("mixed")


def only(value: Column) -> Column:
    """The value if a group has one alone, as an aggregate."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def car_ids(records: DataFrame, file: str = "file_md5") -> DataFrame:
    """``id`` and ``car_id``, the least id of the car's records, for each record (``id``, ``plate_no``, ``vin``, ``insured``, ``applicant``, ``owner``, a file hash).

    Blank and placeholder keys are none.  Records with neither keys nor a party of one car only are cars of their own.
    """
    rows = cut(keyed(records, file))
    first = F.coalesce("v", "p", "f")
    edges = rows.where(first.isNotNull()).select(first.alias("a"), F.explode(F.array_compact(F.array("v", "p", "f"))).alias("b"))
    labels = connected(edges.distinct())
    placed = rows.withColumn("node", first).join(labels, "node", "left").drop("node")
    several = placed.groupBy("label").agg((F.min("v") != F.max("v")).alias("several"), F.min("v").alias("one"))
    placed = cut(placed.join(several, "label", "left").withColumn("several", F.coalesce("several", F.lit(False))))
    # The car, where it is plain: the component, or in components of several frame numbers the record's own.
    plain = F.when(F.col("several"), F.col("v")).otherwise(F.col("label"))
    split = placed.where("several and v is not null")
    by_plate = split.where("p is not null").groupBy("p").agg(only(F.col("v")).alias("plate_v"))
    by_party = split.select("label", "v", F.explode("parties").alias("party")).groupBy("label", "party").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    asked = placed.where("several and v is null").select("id", "label", F.explode("parties").alias("party"))
    party_v = asked.join(by_party, ["label", "party"]).groupBy("id").agg(F.when(F.min("low") == F.max("high"), F.min("low")).alias("party_v"))
    car = placed.join(by_plate, "p", "left").join(party_v, "id", "left").withColumn("car", F.coalesce(plain, F.when(F.col("several"), F.coalesce("plate_v", "party_v", F.concat(F.lit("c:"), F.col("label"))))))
    car = cut(car.select("id", "car", "parties"))
    people = car.where("car is not null").select("car", F.explode("parties").alias("party")).groupBy("party").agg(F.min("car").alias("low"), F.max("car").alias("high"))
    alone = car.where("car is null").select("id", F.explode("parties").alias("party")).join(people, "party").groupBy("id").agg(F.when(F.min("low") == F.max("high"), F.min("low")).alias("person_car"))
    named = cut(car.join(alone, "id", "left").select("id", F.coalesce("car", "person_car", F.concat(F.lit("#"), F.col("id").cast("string"))).alias("car")))
    return named.join(named.groupBy("car").agg(F.min("id").alias("car_id")), "car").select("id", "car_id")
