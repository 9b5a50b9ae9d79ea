"""Ledger: search, de-duplication, order, counters, merge by car, and the export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.columns import CLASS_LABELS, SORT_CLASSES, blank_to_null, cents, class_rank, normalize_plate, plate_key, product_class, sort_class, vin_key
from ledgerspark.operators import paging
from ledgerspark.operators.analytics import POLICY, n

STATUS_FOLDS = {"success": ("done", "success"), "done": ("done", "success")}


#: Statuses of records that have no outcome yet or repeat another file.
UNSETTLED = ("processing", "pending", "duplicate")
#: Columns of ``predicates`` by the argument that seeks a part of them.
PARTS = {
    "company": "company_short", "policy_no": "policy_no", "product": "policy_type", "room": "roomid", "applicant": "applicant", "insured": "insured",
    "owner": "owner", "vin": "vin", "filename": "filename",
}
#: Columns by the argument with their exact value, and by the argument with their span of days.
EXACT = {"source": "source", "category": "doc_category", "engine": "ocr_engine", "enterprise_id": "enterprise_id", "short_name": "company_short", "sender": "sender"}
SPANS = {"created": "created_day", "signed": "sign_date", "starts": "start_date", "ends": "end_date", "updated": "updated_day"}
#: Columns that a keyword is sought in.
KEYWORD = ("policy_no", "insured", "applicant", "plate_no", "filename", "company_short")


def predicates(
    *,
    status: str | None = None,
    keyword: str | None = None,
    keyword_in: tuple[str, ...] = KEYWORD,
    not_category: str | None = None,
    only_policies: bool = False,
    plate: str | None = None,
    salesperson: str | None = None,
    salesperson_in: tuple[str, ...] = ("salesperson",),
    sort_class_is: str | None = None,
    where_from: str | None = None,
    senders: list[str] | None = None,
    user_ids: list[int] | None = None,
    abnormal: bool | None = None,
    settled: bool = False,
    **others: object,
) -> Column:
    """L1: all given conditions, as one predicate on the records.

    Besides those named here: parts of columns (``PARTS``), exact values (``EXACT``) and spans of days (``SPANS``), which take their
    first day and not their last.  ``where_from`` is ``room`` or ``user`` (private messages).  ``settled`` leaves out records without an
    outcome, and repeated files.  ``only_policies`` keeps blank categories too.  An empty list of senders or users finds nothing.
    """
    unknown = sorted(set(others) - set(PARTS) - set(EXACT) - set(SPANS))
    if unknown:
        raise ValueError(f"unknown conditions: {unknown}")
    out: list[Column] = [F.col("deleted") == 0]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))

    def in_any(names: tuple[str, ...], part: str) -> Column:
        hit = F.lit(False)
        for c in names:
            hit = hit | F.contains(text(c), F.lit(part))
        return hit

    if settled:
        out.append(~F.col("status").isin(*UNSETTLED))
    if status:
        out.append(F.col("status").isin(*STATUS_FOLDS.get(status, (status,))))
    if keyword:
        out.append(in_any(keyword_in, keyword))
    if salesperson:
        out.append(in_any(salesperson_in, salesperson))
    if not_category:
        out.append(text("doc_category") != not_category)
    if only_policies:
        out.append(text("doc_category").isin(POLICY, ""))
    if where_from:
        out.append((text("roomid") != "") == (where_from == "room"))
    if plate:
        out.append(F.contains(F.coalesce(normalize_plate(F.col("plate_no")), F.lit("")), normalize_plate(F.lit(plate))))
    if sort_class_is:
        out.append(sort_class(F.col("policy_type")) == sort_class_is)
    if senders is not None:
        out.append(F.col("sender").isin(senders))
    if user_ids is not None:
        out.append(F.col("user_id").isin(user_ids))
    if abnormal is not None:
        out.append(F.col("is_abnormal") == int(abnormal))
    for name, value in others.items():
        if value is None or value == "":
            continue
        if name in PARTS:
            out.append(F.contains(text(PARTS[name]), F.lit(value)))
        elif name in EXACT:
            out.append(F.col(EXACT[name]) == value)
        else:
            first, end = value
            out.append((F.col(SPANS[name]) >= F.lit(first).cast("date")) & (F.col(SPANS[name]) < F.lit(end).cast("date")))
    both = out[0]
    for p in out[1:]:
        both = both & p
    return both


def search(records: DataFrame, **conditions) -> DataFrame:
    """Records that meet all conditions."""
    return records.where(predicates(**conditions))


def reviewed(records: DataFrame, notes: DataFrame, today: str, done: bool = True) -> DataFrame:
    """L1: records that have (or have not) an internal note of today."""
    noted = notes.where(F.col("created_day") == F.lit(today).cast("date")).select(F.col("record_id").alias("id")).distinct()
    return records.join(noted, "id", "left_semi" if done else "left_anti")


def deduplicate(records: DataFrame) -> DataFrame:
    """L2: of policies with a number, the newest for each number and day; all other records stay.

    The newest are found by a partial maximum, so a number with very many records is reduced before the shuffle.
    """
    numbered = (F.col("doc_category") == POLICY) & (F.coalesce(F.col("policy_no"), F.lit("")) != "")
    keep = records.where(numbered).groupBy("policy_no", "created_day").agg(F.max("id").alias("id")).select("id")
    return records.where(numbered).join(keep, "id", "left_semi").unionByName(records.where(~F.coalesce(numbered, F.lit(False))))


def sort_by_anchor(records: DataFrame, by: str = "created_day") -> DataFrame:
    """L3: cars by their greatest sort value, then plate, class and id.  Records without a plate stand on their own."""
    key = F.coalesce(plate_key(F.col("plate_no")), F.concat(F.lit("#"), F.col("id").cast("string")))
    keyed = records.withColumn("__car", key)
    anchored = keyed.join(keyed.groupBy("__car").agg(F.max(by).alias("anchor")), "__car")
    return anchored.orderBy(F.desc("anchor"), "__car", class_rank(F.col("policy_type")), F.desc("id")).drop("__car")


def enrich(records: DataFrame, rooms: DataFrame, checks: DataFrame, users: DataFrame) -> DataFrame:
    """L4: room name, whether there was a second reading, owner's name."""
    checked = checks.select("record_id").distinct().withColumn("checked", F.lit(True))
    joined = records.join(rooms.select("roomid", "room_name"), "roomid", "left").join(checked, records["id"] == checked["record_id"], "left").join(users.select("user_id", "user_name"), "user_id", "left")
    return joined.withColumns({"room_name": F.coalesce(blank_to_null(F.col("room_name")), F.col("roomid")), "checked": F.coalesce("checked", F.lit(False))}).drop("record_id")


def page(records: DataFrame, number: int, size: int) -> DataFrame:
    """A page, newest first, with the count of all rows and pages beside each row."""
    total = records.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return records.orderBy(F.desc("id")).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def bucket_of() -> Column:
    """The one bucket of a record."""
    done, category = F.col("status").isin("done", "success"), F.coalesce(F.col("doc_category"), F.lit(""))
    return F.when(F.col("status") == "failed", "failed").when(~done, "other").when(~category.isin("", POLICY), "non_policy").when(F.col("is_abnormal") == 1, "abnormal").otherwise("success")


def deep_page(records: DataFrame, number: int, size: int, order: tuple[str, ...] = ("created_day", "id")) -> DataFrame:
    """A page far behind, newest first by ``order``, found by counts of key ranges (``paging``); with the count of all rows and pages."""
    total = records.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return paging.deep_page(records, list(order), number, size).crossJoin(F.broadcast(total))


def counters(records: DataFrame) -> DataFrame:
    """By bucket and in all, records, and records when policies of one number and day count once in their bucket.

    The buckets' counts without repetition need not add up to the total's.
    """
    numbered = (F.col("doc_category") == POLICY) & (F.coalesce(F.col("policy_no"), F.lit("")) != "")
    key = F.when(numbered, F.struct(F.col("policy_no"), F.col("created_day").cast("string").alias("day"))).otherwise(F.struct(F.lit("#").alias("policy_no"), F.col("id").cast("string").alias("day")))
    tagged = records.where("deleted = 0").select(F.explode(F.array(bucket_of(), F.lit("total"))).alias("bucket"), key.alias("key"))
    each = tagged.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("rows"))
    return each.groupBy("bucket").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


def daily_counters(records: DataFrame) -> DataFrame:
    """The counters of each tenant, day and bucket: ``enterprise_id``, ``created_day``, ``bucket``, ``n``, ``n_distinct``.

    Repetition is by number and day, so the counts of a tenant's days add up exactly.
    """
    numbered = (F.col("doc_category") == POLICY) & (F.coalesce(F.col("policy_no"), F.lit("")) != "")
    key = F.when(numbered, F.concat(F.lit("p"), F.col("policy_no"))).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    tagged = records.where("deleted = 0").select("enterprise_id", "created_day", F.explode(F.array(bucket_of(), F.lit("total"))).alias("bucket"), key.alias("key"))
    each = tagged.groupBy("enterprise_id", "created_day", "bucket", "key").agg(F.count(F.lit(1)).alias("rows"))
    return each.groupBy("enterprise_id", "created_day", "bucket").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


def counters_of(daily: DataFrame, enterprise_id: int, first: str | None = None, last: str | None = None) -> DataFrame:
    """The counters of a tenant, of a period or in all, from ``daily_counters`` alone."""
    rows = daily.where(F.col("enterprise_id") == enterprise_id)
    rows = rows if first is None else rows.where(F.col("created_day") >= F.lit(first).cast("date"))
    rows = rows if last is None else rows.where(F.col("created_day") <= F.lit(last).cast("date"))
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_distinct").alias("n_distinct"))


def engine_counts(records: DataFrame) -> DataFrame:
    """Records by reading engine."""
    return records.where("deleted = 0").groupBy("ocr_engine").agg(n().alias("n"))


def top_rooms(records: DataFrame, limit: int = 50) -> DataFrame:
    """Rooms with most records."""
    return records.where("deleted = 0 and roomid != ''").groupBy("roomid").agg(n().alias("n")).orderBy(F.desc("n"), "roomid").limit(limit)


SHARED = ["company_short", "plate_no", "applicant", "insured", "owner", "salesperson"]


def merge_by_car(records: DataFrame, order: str = "id", shared: list[str] | None = None, own: dict[str, list[str]] | None = None, car: str | None = None) -> DataFrame:
    """One row a car: by the column ``car`` if it is named (``identity.car_ids``), else by plate, without one by frame number, without that by record.

    Shared fields are the first non-blank in input order; premiums add up by class, each policy number once (blank numbers
    each time); policy numbers are the first by class.  ``own`` has, by class label, further fields that are kept by class, the first
    non-blank each, as ``<class>_<field>``.  Records are summed up by car and number first, then by car, so the table is read once and
    a car with very many records is reduced before it is put together; only its ids are gathered.
    """
    names = {"商业险": "commercial", "交强险": "compulsory", "非车险": "other"}
    key = F.col(car).cast("string") if car else F.coalesce(plate_key(F.col("plate_no")), F.concat(F.lit("vin:"), vin_key(F.col("vin"))), F.concat(F.lit("#"), F.col("id").cast("string")))
    label = F.lit(None).cast("string")
    for kind, name in CLASS_LABELS.items():
        label = F.when(F.col("__class") == kind, name).otherwise(label)
    number = F.coalesce(blank_to_null(F.col("policy_no")), F.concat(F.lit("#"), F.col("id").cast("string")))
    keyed = records.withColumn("__class", product_class(F.col("policy_type"))).withColumns({"car": key, "label": label, "number": number})
    taken = {c: blank_to_null(F.col(c)) for c in (shared or SHARED)}
    taken |= {f"{v}_policy_no": F.when(F.col("label") == k, blank_to_null(F.col("policy_no"))) for k, v in names.items()}
    taken |= {f"{names[k]}_{c}": F.when(F.col("label") == k, blank_to_null(F.col(c))) for k, cs in (own or {}).items() for c in cs}
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct(F.col(order).alias("o"), c.alias("v"))))
    each = keyed.groupBy("car", "number").agg(
        F.min(F.struct(F.col(order).alias("o"), "label", cents(F.col("total_premium")).alias("cents"))).alias("__first"),
        *[first(c).alias(name) for name, c in taken.items()], F.min("id").alias("first_id"), n().alias("n_records"), F.collect_list("id").alias("ids"),
    )
    sums = [F.coalesce(F.sum(F.when(F.col("__first.label") == k, F.col("__first.cents"))), F.lit(0)).alias(f"{v}_cents") for k, v in names.items()]
    whole = each.groupBy("car").agg(*[F.min(c).alias(c) for c in taken], F.min("first_id").alias("first_id"), F.sum("n_records").alias("n_records"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("record_ids"), *sums)
    return whole.withColumns({c: F.col(c)["v"] for c in taken})


def plain_order(records: DataFrame) -> DataFrame:
    """By plate, class and id."""
    return records.orderBy(F.coalesce(plate_key(F.col("plate_no")), F.lit("")), class_rank(F.col("policy_type"), SORT_CLASSES), "id")


def companies(records: DataFrame, **visible) -> DataFrame:
    """Distinct insurers within what is visible."""
    return search(records, **visible).where("company_short != ''").select("company_short").distinct()


# Words of corporate names.
CORPORATE = "公司|企业|厂|店|中心|合作社"


def seal_groups(records: DataFrame, merging: list[int], pattern: str = CORPORATE) -> DataFrame:
    """Stamp tasks of corporate policies; tenants in ``merging`` group by car and sign date, others by record."""
    car = F.coalesce(plate_key(F.col("plate_no")), vin_key(F.col("vin")), F.col("id").cast("string"))
    key = F.when(F.col("enterprise_id").isin(merging), F.concat_ws("|", car, F.coalesce(F.col("sign_date").cast("string"), F.lit("")))).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    corporate = records.where(F.rlike("insured", F.lit(pattern)) & (F.col("deleted") == 0) & (F.col("status") == "done"))
    names = lambda c: F.concat_ws("、", F.array_sort(F.collect_set(blank_to_null(F.col(c)))))
    found = corporate.groupBy("enterprise_id", key.alias("seal_key")).agg(names("policy_type").alias("products"), names("company_short").alias("insurers"), F.sum(cents(F.col("total_premium"))).alias("cents"), F.min("total_premium").alias("some_text"), F.every(F.col("seal_paid") == 1).alias("paid"), n().alias("children"), F.min("id").alias("first_id"))
    return found.withColumn("premium", F.coalesce(F.col("cents").cast("string"), F.col("some_text"))).drop("some_text", "cents")


def sender_names(records: DataFrame, bindings: DataFrame, users: DataFrame) -> DataFrame:
    """Display name of the sender: alias, else the bound user's name, else the sender; a tenant's binding goes before a global one.

    ``bindings``: ``sender``, ``enterprise_id`` (null: global), ``alias``, ``user_id``; small, as are users.
    """
    b = bindings.join(users.select("user_id", "user_name"), "user_id", "left").select("sender", F.col("enterprise_id").alias("bound_to"), F.coalesce(blank_to_null(F.col("alias")), blank_to_null(F.col("user_name"))).alias("display"))
    own = b.where("bound_to is not null").groupBy("sender", F.col("bound_to").alias("enterprise_id")).agg(F.min("display").alias("own"))
    everyone = b.where("bound_to is null").groupBy("sender").agg(F.min("display").alias("everyone"))
    return records.join(own, ["sender", "enterprise_id"], "left").join(everyone, "sender", "left").withColumn("sender_name", F.coalesce("own", "everyone", "sender")).drop("own", "everyone")
