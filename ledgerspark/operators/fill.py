"""Completion of records from others of the same file, car or people.

"Newest" is always the greatest id among non-blank values, as an aggregate, so that hot keys are reduced before the
shuffle; blank and placeholder keys are null and never join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.columns import PROVINCES, blank_to_null, normalize_plate, plate_key, product_class, vin_key

#: Newest other records that may lend values.
CANDIDATES, PERSON_CANDIDATES = 10, 20


def valid_name(c: Column) -> Column:
    """Two to forty characters, without digits at the start, labels or punctuation."""
    return c.isNotNull() & F.length(c).between(2, 40) & ~F.rlike(c, F.lit(r"^[\d\s]|[:：;；,，。]|(?:地址|电话|证件|号码|日期)"))


def newest(c: Column, order: str = "id") -> Column:
    """The non-blank value with the greatest order, as an aggregate; null if all are blank."""
    return F.max_by(blank_to_null(c), F.when(blank_to_null(c).isNotNull(), F.col(order)))


#: Fixed value: an insurer that readers take compulsory policies for by mistake.
SUSPECT_INSURER = "平安"


def fill_same_file(records: DataFrame, fields: list[str], names: list[str], suspect: str = SUSPECT_INSURER) -> DataFrame:
    """blanks take the first non-blank value of the same file hash; names the longest valid one, which also replaces shorter ones.

    A compulsory policy of the ``suspect`` insurer takes the insurer of the file's first policy of another one.
    Values are summed up by hash first and joined back; a blank hash fills nothing.
    """
    key = blank_to_null(F.col("file_md5"))
    aggs = [F.min_by(blank_to_null(F.col(c)), F.when(blank_to_null(F.col(c)).isNotNull(), F.col("id"))).alias(f"f_{c}") for c in fields]
    longest = [F.max_by(F.col(c), F.when(valid_name(F.col(c)), F.struct(F.length(c), -F.col("id")))).alias(f"f_{c}") for c in names]
    company = blank_to_null(F.col("company_short"))
    other = F.min_by(company, F.when(company.isNotNull() & ~F.contains(company, F.lit(suspect)), F.col("id"))).alias("f_company")
    pool = records.where(key.isNotNull()).groupBy(key.alias("f_key")).agg(*aggs, *longest, other)
    joined = records.join(pool, key == F.col("f_key"), "left")
    shorter = lambda c: F.length(F.col(f"f_{c}")) > F.length(F.coalesce(F.col(c), F.lit("")))
    doubtful = (product_class(F.col("policy_type")) == "compulsory") & F.contains("company_short", F.lit(suspect)) & F.col("f_company").isNotNull()
    new = {c: F.coalesce(blank_to_null(F.col(c)), F.col(f"f_{c}")) for c in fields}
    new |= {c: F.when(shorter(c), F.col(f"f_{c}")).otherwise(blank_to_null(F.col(c))) for c in names}
    new["company_short"] = F.when(doubtful, F.col("f_company")).otherwise(F.col("company_short"))
    return joined.withColumns(new).drop("f_key", "f_company", *[f"f_{c}" for c in [*fields, *names]])


def fill_by_key(records: DataFrame, key: Column, fields: list[str], guard: Column | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """blanks of each record from the newest ``candidates`` other finished records with the same key.

    ``guard`` (a column, the frame number for plates) must be equal or missing on one side.  The lenders are ranked within the key
    before the join, one more than needed since the record itself may be one, so a key brings at most that many.
    """
    g = F.lit(None).cast("string") if guard is None else guard
    keyed = records.withColumns({"k": key, "g": g})
    lend = keyed.where("k is not null and deleted = 0 and status in ('done', 'success')").withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("id")))).where(F.col("place") <= candidates + 1)
    pool = lend.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("place", "id", "g", *fields))).alias("pool"))
    joined = keyed.join(pool, "k", "left")
    fine = F.slice(F.filter("pool", lambda x: (x["id"] != F.col("id"))), 1, candidates)
    usable = F.filter(fine, lambda x: x["g"].isNull() | F.col("g").isNull() | (x["g"] == F.col("g")))

    def filled(c: str) -> Column:
        values = F.filter(F.transform(usable, lambda x: blank_to_null(x[c])), lambda v: v.isNotNull())
        return F.coalesce(blank_to_null(F.col(c)), F.get(values, F.lit(0)))

    return joined.withColumns({c: filled(c) for c in fields}).drop("k", "g", "pool")


def fill_same_plate(records: DataFrame, fields: list[str]) -> DataFrame:
    """by plate, without lenders whose frame number differs."""
    return fill_by_key(records, plate_key(F.col("plate_no")), fields, vin_key(F.col("vin")))


def fill_same_vin(records: DataFrame, fields: list[str]) -> DataFrame:
    """by frame number of ten or more characters; fills the plate too."""
    return fill_by_key(records, vin_key(F.col("vin")), fields)


def fill_by_person(records: DataFrame, fields: list[str]) -> DataFrame:
    """from the newest ``PERSON_CANDIDATES`` records that share a person with it, motor policies first.

    A person's newest lenders are one array, and so are those of each set of people that records have, one more than a record
    may take, as it is no lender of its own.  Records meet their set's array once and pick from it in the row.
    """
    people = F.array_sort(F.array_distinct(F.filter(F.array(*[blank_to_null(F.col(c)) for c in ("insured", "applicant", "owner")]), lambda v: v.isNotNull())))
    motor = product_class(F.col("policy_type")).isin("compulsory", "commercial")
    lender = F.struct(motor.alias("motor"), F.col("id"), *fields)
    rows = records.where("deleted = 0 and status in ('done', 'success')").select(lender.alias("lender"), F.explode(people).alias("person"))
    order = Window.partitionBy("person").orderBy(F.desc("lender.motor"), F.desc("lender.id"))
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PERSON_CANDIDATES + 1)
    lenders = top.groupBy("person").agg(F.collect_list("lender").alias("lenders"))
    sets = records.select(people.alias("people")).where(F.size("people") > 0).distinct()
    merged = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lenders"))), asc=False), 1, PERSON_CANDIDATES + 1)
    pool = sets.select("people", F.explode("people").alias("person")).join(lenders, "person").groupBy("people").agg(merged.alias("__lenders"))
    joined = records.withColumn("people", people).join(pool, "people", "left").drop("people")
    joined = joined.withColumn("__lenders", F.slice(F.filter("__lenders", lambda x: x["id"] != F.col("id")), 1, PERSON_CANDIDATES))
    lent = lambda c: F.get(F.filter("__lenders", lambda x: blank_to_null(x[c]).isNotNull()), F.lit(0))[c]
    return joined.withColumns({c: F.coalesce(blank_to_null(F.col(c)), lent(c)) for c in fields}).drop("__lenders")


PARTIES = ("insured", "applicant", "owner")


def correct_parties(records: DataFrame, parties: tuple[str, ...] = PARTIES, manual: str | None = None) -> DataFrame:
    """within a plate, each party of motor policies takes the longest valid name that motor policies have for it, if that is
    longer; others take the newest valid one of motor policies.  Fields edited by hand (``manual``) stay.
    """
    key, motor = plate_key(F.col("plate_no")), product_class(F.col("policy_type")).isin("compulsory", "commercial")
    keyed = records.withColumns({"k": key, "motor": motor})
    pool = []
    for c in parties:
        ok = F.col("motor") & valid_name(F.col(c))
        pool += [F.max_by(c, F.when(ok, F.struct(F.length(c), "id"))).alias(f"l_{c}"), F.max_by(c, F.when(ok, F.col("id"))).alias(f"n_{c}")]
    joined = keyed.join(keyed.where("k is not null and deleted = 0").groupBy("k").agg(*pool), "k", "left")
    free = lambda c: ~F.array_contains(F.coalesce(F.col(manual), F.array().cast("array<string>")), c) if manual else F.lit(True)
    better = lambda c: F.when(F.col("motor"), F.when(F.length(f"l_{c}") > F.length(F.coalesce(c, F.lit(""))), F.col(f"l_{c}"))).otherwise(F.col(f"n_{c}"))
    return joined.withColumns({c: F.coalesce(F.when(free(c), better(c)), F.col(c)) for c in parties}).drop("k", "motor", *[f"{x}_{c}" for c in parties for x in "ln"])


def reverse_fill(records: DataFrame, fields: list[str], manual: str = "manual_fields", parties: tuple[str, ...] = PARTIES) -> DataFrame:
    """every blank takes the newest non-blank value of other records of the plate, older or newer, but not in hand-edited fields.

    Parties take valid names only; ``correct_parties`` with the same ``manual`` then puts shorter names right.  Filling on arrival depends on
    the order of arrival; this rule does not.  A blank field never has its own value in the pool.
    """
    key = plate_key(F.col("plate_no"))
    lent = lambda c: F.when(valid_name(F.col(c)), F.col(c)) if c in parties else F.col(c)
    pool = records.where(key.isNotNull() & (F.col("deleted") == 0)).groupBy(key.alias("k")).agg(*[newest(lent(c)).alias(f"f_{c}") for c in fields])
    joined = records.join(pool, key == F.col("k"), "left")
    free = lambda c: ~F.array_contains(F.coalesce(F.col(manual), F.array().cast("array<string>")), c)
    return joined.withColumns({c: F.coalesce(blank_to_null(F.col(c)), F.when(free(c), F.col(f"f_{c}"))) for c in fields}).drop("k", *[f"f_{c}" for c in fields])


def finished(records: DataFrame) -> Column:
    """Records that may lend to pools, dates and related policies: not deleted, and of status done, where records have a status."""
    return (F.col("deleted") == 0) & ((F.col("status") == "done") if "status" in records.columns else F.lit(True))


def plate_pool(records: DataFrame, fields: list[str]) -> DataFrame:
    """the newest non-blank value of each field by plate, of finished records."""
    key = plate_key(F.col("plate_no"))
    return records.where(key.isNotNull() & finished(records)).groupBy(key.alias("plate")).agg(*[newest(F.col(c)).alias(c) for c in fields])


def vin_pool(records: DataFrame) -> DataFrame:
    """F8: the newest plate, owner and id number by frame number."""
    key = vin_key(F.col("vin"))
    return records.where(key.isNotNull() & (F.col("deleted") == 0)).groupBy(key.alias("vin")).agg(newest(plate_key(F.col("plate_no"))).alias("plate"), newest(F.col("owner")).alias("owner"), newest(F.col("id_number")).alias("id_number"))


def plate_vin_pool(records: DataFrame) -> DataFrame:
    """F8: the newest frame number by plate."""
    key = plate_key(F.col("plate_no"))
    return records.where(key.isNotNull() & (F.col("deleted") == 0)).groupBy(key.alias("plate")).agg(newest(vin_key(F.col("vin"))).alias("vin")).where("vin is not null")


def fill_by_pools(records: DataFrame) -> DataFrame:
    """F8: records without a plate take plate, owner and id number of their frame number's pool, then a plate from the file's name;
    records without a frame number then take their plate's.
    """
    own = records.withColumns({"__k": vin_key(F.col("vin")), "__blank": plate_key(F.col("plate_no")).isNull()})
    pool = vin_pool(records).select(F.col("vin").alias("__k"), F.col("plate").alias("__plate"), F.col("owner").alias("__owner"), F.col("id_number").alias("__id"))
    met = own.join(pool, "__k", "left")
    lend = lambda c, lent: F.coalesce(blank_to_null(F.col(c)), F.when(F.col("__blank"), F.col(lent)))
    named = blank_to_null(normalize_plate(F.regexp_extract("filename", rf"[{PROVINCES}][A-Z]-?[A-Z0-9]{{4,6}}", 0)))
    met = met.withColumns({"plate_no": F.when(F.col("__blank"), F.coalesce("__plate", named, F.col("plate_no"))).otherwise(F.col("plate_no")), "owner": lend("owner", "__owner"), "id_number": lend("id_number", "__id")})
    plated = met.select(*records.columns).withColumn("__k", plate_key(F.col("plate_no")))
    pool = plate_vin_pool(plated).select(F.col("plate").alias("__k"), F.col("vin").alias("__vin"))
    return plated.join(pool, "__k", "left").withColumn("vin", F.coalesce(blank_to_null(F.col("vin")), F.col("__vin"))).select(*records.columns)


def latest_compulsory_end(records: DataFrame) -> DataFrame:
    """end date of the newest finished compulsory policy with one by plate, and that record.  A corrected, earlier date counts."""
    key = plate_key(F.col("plate_no"))
    own = records.where(key.isNotNull() & finished(records) & (product_class(F.col("policy_type")) == "compulsory") & F.col("end_date").isNotNull())
    return own.groupBy(key.alias("plate")).agg(F.max_by("end_date", "id").alias("end_date"), F.max("id").alias("record_id"))


def dual_dates(records: DataFrame, date: str = "start_date") -> DataFrame:
    """start (or end) date of the newest finished commercial and compulsory policy with one by plate, and both as one text.

    One date alone stands as it is; two equal ones once; of two, the commercial one, 交, and month and day of the compulsory one.
    """
    key = plate_key(F.col("plate_no"))
    kind = product_class(F.col("policy_type"))
    dates = records.where(key.isNotNull() & finished(records)).groupBy(key.alias("plate")).agg(*[newest_date(date, kind == k).alias(k) for k in ("commercial", "compulsory")])
    both = F.concat(F.col("commercial").cast("string"), F.lit("交"), F.month("compulsory").cast("string"), F.lit("/"), F.day("compulsory").cast("string"))
    text = F.when(F.col("commercial") == F.col("compulsory"), F.col("commercial").cast("string")).otherwise(F.coalesce(both, F.col("commercial").cast("string"), F.col("compulsory").cast("string"), F.lit("")))
    return dates.withColumn("dates", text)


def newest_date(date: str, ok: Column) -> Column:
    """The date of the greatest id among rows that have one and are ``ok``, as an aggregate."""
    return F.max_by(date, F.when(ok & F.col(date).isNotNull(), F.col("id")))


def siblings(records: DataFrame, index: str = "policy_index") -> DataFrame:
    """for each record, the newest other records of its file, one a policy index; without an index each record is its own."""
    slot = F.coalesce(F.nullif(F.col(index), F.lit(0)), -F.col("id"))
    each = records.where("file_md5 != ''").groupBy("file_md5", slot.alias("slot")).agg(F.max("id").alias("sibling_id"))
    own = records.where("file_md5 != ''").select("id", "file_md5", slot.alias("own_slot"))
    return own.join(each, "file_md5").where((F.col("sibling_id") != F.col("id")) & (F.col("slot") != F.col("own_slot"))).groupBy("id").agg(F.array_sort(F.collect_list("sibling_id")).alias("sibling_ids"))


#: Buckets of policies without a date, and of all policies of a key.
_UNDATED, _ANY = -(1 << 40), -(1 << 41)
#: Keys and day by which the source relates policies.
RELATED_BY = ("plate", "vin", "applicant")


def policy_day() -> Column:
    """Sign date, else start date, else day of creation."""
    return F.coalesce("sign_date", "start_date", "created_day")


def related(records: DataFrame, other_class: str, days: int, keys: tuple[str, ...] = ("plate", "vin"), day: Column | None = None) -> DataFrame:
    """whether another policy of a class exists for the same car or applicant, dated within ``days`` of this one.

    ``keys`` are some of ``RELATED_BY``, others are refused.  ``day`` is the start date unless given; the source takes ``policy_day()``.
    A missing date fits.  Only finished records count as related.  Records of the class are summed up by key and day, each record is compared with its keys' days
    through buckets of ``days`` width, so a key with very many policies does not meet itself; all keys go through one equi-join.
    """
    unknown = sorted(set(keys) - set(RELATED_BY))
    if unknown:
        raise ValueError(f"unknown keys: {unknown}")
    by = {"plate": plate_key(F.col("plate_no")), "vin": vin_key(F.col("vin")), "applicant": blank_to_null(F.col("applicant"))}
    day = F.col("start_date") if day is None else day
    width = max(1, days)
    taken = records.where("deleted = 0").select("id", *[by[name].alias(name) for name in keys], day.alias("d"), (finished(records) & (product_class(F.col("policy_type")) == other_class)).alias("fits"))
    # Every key of a record is a row of one table, so all keys go through one join; keys of a kind begin alike.
    named = F.array_compact(F.array(*[F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}:"), F.col(name))) for name in keys]))
    rows = taken.select("id", "d", "fits", F.explode(named).alias("k"), F.floor(F.datediff("d", F.lit("1970-01-01").cast("date")) / width).alias("b"))
    lend = rows.where("fits").groupBy("k", "d", "b").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    near = lend.select(F.col("k").alias("lk"), F.col("d").alias("ld"), "low", "high", F.explode(F.when(F.col("b").isNull(), F.array(F.lit(_UNDATED), F.lit(_ANY))).otherwise(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1, F.lit(_ANY)))).alias("lb"))
    near = near.groupBy("lk", "lb", F.when(F.col("lb") != _ANY, F.col("ld")).alias("ld")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    asked = rows.select("id", "k", "d", F.explode(F.when(F.col("b").isNull(), F.array(F.lit(_ANY))).otherwise(F.array(F.col("b"), F.lit(_UNDATED)))).alias("b"))
    fits = F.col("d").isNull() | F.col("ld").isNull() | (F.abs(F.datediff("d", "ld")) <= days)
    hits = asked.join(near, (F.col("k") == F.col("lk")) & (F.col("b") == F.col("lb")) & fits).where("low != id or high != id").select("id").distinct()
    return records.select("id").join(hits.withColumn("related", F.lit(True)), "id", "left").select("id", F.coalesce("related", F.lit(False)).alias("related"))
