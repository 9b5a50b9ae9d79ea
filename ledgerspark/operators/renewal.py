"""Renewal tasks and reminders (R1 to R13).  ``today`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.columns import blank_to_null, plate_key, vin_key
from ledgerspark.operators.analytics import POLICY, n

WINDOW_DAYS = 30
CLOSED = ("renewed", "lost", "closed")
OPEN = ("pending", "following", "contacted")


def day(today: str) -> Column:
    return F.lit(today).cast("date")


def policies(records: DataFrame) -> DataFrame:
    return records.where(F.col("status").isin("done", "success") & (F.col("doc_category") == POLICY) & (F.col("deleted") == 0))


def customer_key() -> Column:
    return F.coalesce(plate_key(F.col("plate_no")), vin_key(F.col("vin")))


def window_records(records: DataFrame, today: str, days: int = WINDOW_DAYS) -> DataFrame:
    """Policies that end within ``days`` before or after today."""
    return policies(records).where(F.col("end_date").between(F.date_sub(day(today), days), F.date_add(day(today), days)))


def priority(end: Column, today: str) -> Column:
    """R2: 2 up to seven days before the end (and after it), 1 up to thirty, else 0."""
    left = F.datediff(end, day(today))
    return F.when(left <= 7, 2).when(left <= 30, 1).otherwise(0)


def tasks(records: DataFrame, today: str, car: str | None = None) -> DataFrame:
    """R2: one task a car, product and tenant: from the policy that ends first, with all ids and the newest record's sender.

    A car is its plate, else its frame number, or what the column ``car`` says (``identity.car_ids``).
    """
    return snapshot(window_records(records, today).withColumn("customer_key", F.col(car).cast("string") if car else customer_key()), today)


def snapshot(due: DataFrame, today: str) -> DataFrame:
    """R2: the tasks of policies with a ``customer_key``; rows without one have none."""
    due = due.where("customer_key is not null")
    first = F.struct("end_date", "id")
    fields = [F.min_by(F.col(c), first).alias(c) for c in ("plate_no", "vin", "insured", "company_short", "policy_no", "total_premium", "end_date")]
    found = due.groupBy("customer_key", F.substring("policy_type", 1, 64).alias("policy_type"), "enterprise_id").agg(*fields, F.min_by("id", first).alias("primary_record_id"), F.array_sort(F.collect_set("id")).alias("record_ids"), F.max_by("sender", "id").alias("sender"))
    return found.withColumn("priority", priority(F.col("end_date"), today))


def default_assignee(found: DataFrame, bindings: DataFrame) -> DataFrame:
    """The user bound to the sender: the tenant's binding before a global one, the lowest user of several."""
    own = bindings.where("enterprise_id is not null").groupBy("sender", "enterprise_id").agg(F.min("user_id").alias("own"))
    everyone = bindings.where("enterprise_id is null").groupBy("sender").agg(F.min("user_id").alias("everyone"))
    return found.join(own, ["sender", "enterprise_id"], "left").join(everyone, "sender", "left").withColumn("assignee", F.coalesce("own", "everyone")).drop("own", "everyone")


def merge_tasks(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Closed tasks stay as they are; open ones take the new fields but keep assignee and status; new ones are pending."""
    key = ["customer_key", "policy_type", "enterprise_id"]
    e, f = existing.alias("e"), found.alias("f")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}"))
    closed = F.coalesce(F.col("e.status").isin(*CLOSED), F.lit(False))
    old, new = F.col("e.status").isNotNull(), F.col("f.priority").isNotNull()
    take = lambda c: F.when(closed | ~new, F.col(f"e.{c}")).otherwise(F.col(f"f.{c}")).alias(c)
    outcome = F.when(~old, "inserted").when(closed, "closed").when(new, "updated").otherwise("kept")
    return e.join(f, same, "full").select(*[F.coalesce(F.col(f"e.{k}"), F.col(f"f.{k}")).alias(k) for k in key], take("end_date"), take("priority"), take("primary_record_id"), F.coalesce("e.assignee", "f.assignee").alias("assignee"), F.coalesce("e.status", F.lit("pending")).alias("status"), outcome.alias("outcome"))


def hints(found: DataFrame, records: DataFrame) -> DataFrame:
    """For each pending task, the policy that seems to renew it.

    Same plate or same frame number (two equi-joins), tenant and product, not among the task's records, starting from 7 days before
    to 35 days after its end; the latest end wins, then the greatest id.  Another insurer means transfer, else renewal.
    """
    kept = policies(records).select(F.col("id").alias("hint_id"), plate_key(F.col("plate_no")).alias("plate"), vin_key(F.col("vin")).alias("frame"), "enterprise_id", F.substring("policy_type", 1, 64).alias("policy_type"), F.col("start_date").alias("hint_start"), F.col("end_date").alias("hint_end"), F.col("company_short").alias("hint_company"))
    t = found.select("customer_key", "enterprise_id", "policy_type", plate_key(F.col("plate_no")).alias("plate"), vin_key(F.col("vin")).alias("frame"), "end_date", "record_ids", "company_short")
    hits = None
    for key in ("plate", "frame"):
        other = "frame" if key == "plate" else "plate"
        j = t.drop(other).join(kept.drop(other), [key, "enterprise_id", "policy_type"]).drop(key)
        hits = j if hits is None else hits.unionByName(j)
    ok = F.datediff("hint_start", "end_date").between(-7, 35) & ~F.array_contains("record_ids", F.col("hint_id"))
    best = hits.where(ok).groupBy("customer_key", "policy_type", "enterprise_id").agg(F.max_by(F.struct("hint_id", "hint_end", "hint_company", "company_short"), F.struct("hint_end", "hint_id")).alias("h"))
    both = (F.coalesce("h.hint_company", F.lit("")) != "") & (F.coalesce("h.company_short", F.lit("")) != "")
    kind = F.when(both & (F.col("h.hint_company") != F.col("h.company_short")), "transfer").otherwise("renew")
    return best.select("customer_key", "policy_type", "enterprise_id", "h.hint_id", "h.hint_end", kind.alias("hint"))


def task_list(existing: DataFrame, enterprise_id: int | None = None, status: tuple[str, ...] = OPEN) -> DataFrame:
    """Tasks to act on: most urgent first, then by end, then by key."""
    rows = existing.where(F.col("status").isin(*status))
    rows = rows if enterprise_id is None else rows.where(F.col("enterprise_id") == enterprise_id)
    return rows.orderBy(F.desc("priority"), "end_date", "customer_key", "policy_type")


def task_stats(existing: DataFrame, today: str) -> DataFrame:
    """By tenant, overdue, due within 30 days, renewed this month and open tasks."""
    open_, d = F.col("status").isin(*OPEN), day(today)
    return existing.groupBy("enterprise_id").agg(n(open_ & (F.col("end_date") < d)).alias("overdue"), n(open_ & F.col("end_date").between(d, F.date_add(d, 30))).alias("due"), n((F.col("status") == "renewed") & (F.col("updated_day") >= F.trunc(d, "month"))).alias("renewed"), n(open_).alias("open"))


def reminders(records: DataFrame, users: DataFrame, existing: DataFrame, log: DataFrame, today: str) -> DataFrame:
    """Expiring policies to remind of: opted-in owner, no closed task for the car, not reminded today; newest of (number, plate).

    Policies with a blank number are all kept.  Tasks match by plate or frame number: one anti-join for each.
    """
    owners = users.where("renewal_enabled = 1").select("user_id")
    due = window_records(records, today).join(owners, "user_id", "left_semi")
    closed = existing.where(F.col("status").isin(*CLOSED)).select(F.col("customer_key").alias("ck"), F.col("enterprise_id").alias("ce")).distinct()
    for key in (plate_key(F.col("plate_no")), vin_key(F.col("vin"))):
        due = due.join(closed, (key == F.col("ck")) & (F.col("enterprise_id") == F.col("ce")), "left_anti")
    due = due.join(log.where(F.col("remind_date") == day(today)).select(F.col("record_id").alias("id")), "id", "left_anti")
    group = F.coalesce(blank_to_null(F.col("policy_no")), F.concat(F.lit("#"), F.col("id").cast("string")))
    newest = due.groupBy(group.alias("g"), F.coalesce("plate_no", F.lit("")).alias("p")).agg(F.max("id").alias("id")).select("id")
    return due.join(newest, "id", "left_semi")


def digest(rows: DataFrame, today: str) -> DataFrame:
    """A text a tenant and sender: overdue, soon (7 days) and later policies, each section by end and number."""
    left = F.datediff("end_date", day(today))
    section = F.when(left < 0, F.lit(0)).when(left <= 7, 1).otherwise(2)
    line = F.concat_ws(" ", F.coalesce(blank_to_null(F.col("plate_no")), F.lit("-")), F.col("policy_no"), F.col("end_date").cast("string"))
    lists = rows.groupBy("enterprise_id", "sender").agg(F.array_sort(F.collect_list(F.struct(section.alias("s"), "end_date", "policy_no", "id", line.alias("line")))).alias("all"), n().alias("n_policies"))

    def part(i: int, title: str) -> Column:
        mine = F.transform(F.filter("all", lambda x: x["s"] == i), lambda x: x["line"])
        return F.when(F.size(mine) > 0, F.concat(F.lit(f"[{title}]\n"), F.array_join(mine, "\n")))

    parts = [part(i, title) for i, title in enumerate(("overdue", "soon", "later"))]
    return lists.select("enterprise_id", "sender", "n_policies", F.concat_ws("\n", *parts).alias("text"))


def seal_digest(groups: DataFrame, first: int = 10) -> DataFrame:
    """By tenant, the first unpaid stamp groups in a text and how many more there are."""
    ranked = groups.where("not paid").withColumn("place", F.row_number().over(Window.partitionBy("enterprise_id").orderBy("first_id")))
    line = F.when(F.col("place") <= first, F.struct("place", F.concat_ws(" ", F.col("seal_key"), F.col("premium")).alias("line")))
    found = ranked.groupBy("enterprise_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), n().alias("total"))
    return found.select("enterprise_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), F.greatest(F.col("total") - first, F.lit(0)).alias("more"))


def history(records: DataFrame, plate: str | None, vin: str | None, product: str | None = None) -> DataFrame:
    """A customer's policies by plate or frame number, the latest end first."""
    by = [records.where(k == v) for k, v in ((plate_key(F.col("plate_no")), plate), (vin_key(F.col("vin")), vin)) if v]
    rows = by[0] if len(by) == 1 else by[0].unionByName(by[1]).dropDuplicates(["id"])
    rows = rows.where("deleted = 0")
    return (rows.where(F.col("policy_type") == product) if product else rows).orderBy(F.desc("end_date"), F.desc("id"))


def next_reminder(existing: DataFrame, followups: DataFrame) -> DataFrame:
    """Follow-ups of each task, the last one's text and the last reminder date that was set."""
    found = followups.groupBy("task_id").agg(n().alias("followups"), F.max_by("content", "followup_id").alias("last_content"), F.max_by("next_remind_at", F.when(F.col("next_remind_at").isNotNull(), F.col("followup_id"))).alias("remind_at"))
    return existing.join(found, "task_id", "left").withColumn("followups", F.coalesce("followups", F.lit(0)))


def followup_digest(tenants: DataFrame, today: str) -> DataFrame:
    """Tenants with a note of today in their JSON list, and the first such note."""
    notes = F.filter(F.from_json("remark", "array<struct<date:string,text:string>>"), lambda x: x["date"] == today)
    return tenants.withColumn("note", F.get(notes, F.lit(0))).where("note is not null").select("enterprise_id", "note.date", "note.text")


def refresh(existing: DataFrame, records: DataFrame, changed: DataFrame, today: str) -> DataFrame:
    """Tasks made anew for the cars of changed records only, merged into the existing ones of those cars."""
    keys = changed.select(customer_key().alias("customer_key"), "enterprise_id").where("customer_key is not null").distinct()
    mine = records.withColumn("customer_key", customer_key()).join(keys, ["customer_key", "enterprise_id"], "left_semi")
    found = tasks(mine.drop("customer_key"), today).withColumn("assignee", F.lit(None).cast("long"))
    return merge_tasks(existing.join(keys, ["customer_key", "enterprise_id"], "left_semi"), found)


CUSTOMER = ["customer_key", "enterprise_id"]


def rebuild(existing: DataFrame, records: DataFrame, today: str, customers: DataFrame | None = None) -> DataFrame:
    """The tasks of all customers, or of some (``customer_key``, ``enterprise_id``), as they are after ``records``.

    Policies around their end make and renew tasks.  Where a customer has none of these but open tasks, all its policies renew them, so that a
    date that was put right does not stay behind.  ``active`` says whether a task's product has any policy left.
    """
    rows = policies(records).where("end_date is not null").withColumn("customer_key", customer_key()).where("customer_key is not null")
    if customers is not None:
        rows, existing = (df.join(customers, CUSTOMER, "left_semi") for df in (rows, existing))
    near = F.col("end_date").between(F.date_sub(day(today), WINDOW_DAYS), F.date_add(day(today), WINDOW_DAYS))
    due = rows.groupBy(*CUSTOMER).agg(F.max(near).alias("due"))
    opened = existing.where(~F.col("status").isin(*CLOSED)).select(*CUSTOMER).distinct().withColumn("opened", F.lit(True))
    source = rows.join(due, CUSTOMER).join(opened, CUSTOMER, "left").where(near | (~F.col("due") & F.col("opened"))).drop("due", "opened")
    found = snapshot(source, today).withColumn("assignee", F.lit(None).cast("long"))
    held = rows.groupBy(*CUSTOMER, F.substring("policy_type", 1, 64).alias("policy_type")).agg(F.lit(True).alias("held"))
    return merge_tasks(existing, found).join(held, [*CUSTOMER, "policy_type"], "left").withColumn("active", F.coalesce("held", F.lit(False))).drop("held")


def changed_customers(changes: DataFrame) -> DataFrame:
    """Customers of both images of changes (``before`` and ``after``, structs of a record, null where there is none)."""
    images = changes.select(F.explode(F.array("before", "after")).alias("r")).where("r is not null").select("r.*")
    return images.select(customer_key().alias("customer_key"), "enterprise_id").where("customer_key is not null and enterprise_id is not null").distinct()
