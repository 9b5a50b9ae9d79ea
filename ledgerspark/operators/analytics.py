"""Analytics over policy records: counters, trends, rankings, targets, and tenant jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.columns import blank_to_null, cents, product_class
from ledgerspark.operators.paging import newest_page

POLICY = "保单"
UNASSIGNED, OTHER = "未归属", "其他"
# Months are priced singly, and years by the dozen.
PLAN_PRICES = {"basic": (99, 990), "pro": (299, 2990), "trial": (0, 0)}


def n(condition: Column | None = None) -> Column:
    """Rows, or rows that meet a condition, as a long."""
    return F.count(F.lit(1)) if condition is None else F.count(F.when(condition, 1))


def live(records: DataFrame) -> DataFrame:
    return records.where("deleted = 0")


def rate(part: Column, whole: Column) -> Column:
    """Percentage with two decimals; 0 without a whole."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(0.0))


def calendar(records: DataFrame, first: str, last: str, name: str = "day") -> DataFrame:
    return records.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(name))


def company_stats(records: DataFrame) -> DataFrame:
    """A1: finished policies with a positive confidence, by insurer."""
    fine = live(records).where((F.col("status") == "done") & (F.col("doc_category") == POLICY) & (F.col("confidence") > 0) & (F.col("company_short") != ""))
    return fine.groupBy("company_short").agg(n().alias("n")).orderBy(F.desc("n"), "company_short")


def company_detail(records: DataFrame, today: str) -> DataFrame:
    """A2: by insurer, all and this month's policies, the four classes, first and last time."""
    fine = live(records).where((F.col("status") == "done") & (F.col("doc_category") == POLICY)).withColumn("class", product_class(F.col("policy_type")))
    month = (F.col("created_day") >= F.trunc(F.lit(today).cast("date"), "month")) & (F.col("created_day") <= F.lit(today).cast("date"))
    classes = [n(F.col("class") == c).alias(f"n_{c}") for c in ("compulsory", "commercial", "accident", "non_vehicle")]
    return fine.groupBy("company_short").agg(n().alias("total"), n(month).alias("this_month"), *classes, F.min("created_day").alias("first_day"), F.max("created_day").alias("last_day"))


def unrecovered(records: DataFrame) -> DataFrame:
    """Failed records without a finished one of the same file; a blank hash is never the same."""
    failed, done = live(records).where("status = 'failed'"), live(records).where("status in ('done', 'success') and file_md5 != ''").select("file_md5").distinct()
    hashed = failed.where("file_md5 != ''").join(done, "file_md5", "left_anti")
    return hashed.unionByName(failed.where("file_md5 = '' or file_md5 is null"))


def file_error(message: Column) -> Column:
    return F.rlike(F.coalesce(message, F.lit("")), F.lit("损坏|加密|无法打开|格式"))


def tenant_report(records: DataFrame) -> DataFrame:
    """A3: by tenant, success, abnormal, non-policy, true failures split by file errors, and rates."""
    done = live(records).where("status in ('done', 'success')")
    policy = F.col("doc_category") == POLICY
    counts = done.groupBy("enterprise_id").agg(n(policy & (F.col("is_abnormal") == 0)).alias("success"), n(policy & (F.col("is_abnormal") == 1)).alias("abnormal"), n(F.col("doc_category") != POLICY).alias("non_policy"))
    failed = unrecovered(records).groupBy("enterprise_id").agg(n(~file_error(F.col("error_message"))).alias("failed"), n(file_error(F.col("error_message"))).alias("file_errors"))
    both = counts.join(failed, "enterprise_id", "full").na.fill(0)
    total = F.col("success") + F.col("abnormal") + F.col("failed")
    return both.withColumns({"success_rate": rate(F.col("success"), total), "recognized_rate": rate(F.col("success") + F.col("abnormal"), total)})


def daily_trend(records: DataFrame, first: str, last: str) -> DataFrame:
    """A4: every day of a span with all, finished and faultless records and two rates."""
    done = F.col("status").isin("done", "success")
    days = live(records).where(F.col("created_day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy(F.col("created_day").alias("day")).agg(n().alias("total"), n(done).alias("done"), n(done & (F.col("is_abnormal") == 0)).alias("faultless"))
    filled = calendar(records, first, last).join(days, "day", "left").na.fill(0)
    return filled.withColumns({"done_rate": rate(F.col("done"), F.col("total")), "faultless_rate": rate(F.col("faultless"), F.col("total"))})


def premium_by(records: DataFrame, key: str) -> DataFrame:
    """A5: policies and premium, in cents, by a column; texts without a number add nothing."""
    return live(records).where((F.col("status") == "done") & (F.col("doc_category") == POLICY)).groupBy(key).agg(n().alias("n"), F.coalesce(F.sum(cents(F.col("total_premium"))), F.lit(0)).alias("premium_cents"))


def counts_by(records: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Records by a column, the most frequent first; with ``limit`` only so many."""
    found = live(records).where(blank_to_null(F.col(key).cast("string")).isNotNull()).groupBy(key).agg(n().alias("n")).orderBy(F.desc("n"), key)
    return found.limit(limit) if limit else found


def uploader_ranking(records: DataFrame, users: DataFrame) -> DataFrame:
    """Records and finished ones by user, with the user's name, or the id where there is none."""
    done = F.col("status").isin("done", "success")
    found = live(records).groupBy("user_id").agg(n().alias("total"), n(done).alias("success"))
    return found.join(users.select("user_id", "user_name"), "user_id", "left").withColumn("user_name", F.coalesce(blank_to_null(F.col("user_name")), F.col("user_id").cast("string")))


def failure_list(records: DataFrame, limit: int = 200) -> DataFrame:
    """The newest unrecovered failures, with their kind."""
    kind = F.when(file_error(F.col("error_message")), "file").otherwise("system")
    return unrecovered(records).select("id", "enterprise_id", "error_message", kind.alias("kind"), "created_day").orderBy(F.desc("created_day"), F.desc("id")).limit(limit)


def overview(records: DataFrame, today: str, days: int | None = None) -> DataFrame:
    """One row of counters; the last seven days reach back to today - 7, eight days in all."""
    day, r = F.lit(today).cast("date"), live(records)
    inside = F.lit(True) if days is None else F.col("created_day") > F.date_sub(day, days)
    status = [n(inside & (F.col("status") == s)).alias(f"n_{s}") for s in ("done", "failed", "pending", "success")]
    return r.agg(n(inside).alias("total"), *status, n(F.col("created_day") == day).alias("today"), n(F.col("created_day").between(F.date_sub(day, 7), day)).alias("last_7_days"))


def hourly(messages: DataFrame) -> DataFrame:
    """A10: messages for each hour of the day, 0 to 23, without gaps."""
    hours = messages.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(messages.groupBy(F.hour("sent_at").alias("hour")).agg(n().alias("n")), "hour", "left").na.fill(0)


def daily(rows: DataFrame, first: str, last: str, day: str = "sent_day") -> DataFrame:
    """A10: rows for each day of a span, without gaps."""
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    found = rows.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy(F.col(day).alias("day")).agg(n().alias("n"))
    return days.join(found, "day", "left").na.fill(0, ["n"])


def source_split(records: DataFrame) -> DataFrame:
    """Overlapping counters by where records come from."""
    return live(records).agg(n(F.col("source") == "upload").alias("uploads"), n(F.col("roomid") != "").alias("rooms"), n((F.col("source") == "chat") & (F.col("roomid") == "")).alias("private"), n(F.col("ocr_engine") == "scan").alias("scans"))


def tenant_series(records: DataFrame, today: str, top: int = 10) -> DataFrame:
    """For the tenants with most records in the seven days up to today, a count for each day."""
    day = F.lit(today).cast("date")
    recent = live(records).where(F.col("created_day").between(F.date_sub(day, 6), day))
    best = recent.groupBy("enterprise_id").agg(n().alias("total")).orderBy(F.desc("total"), "enterprise_id").limit(top)
    days = records.sparkSession.range(7).select(F.date_sub(day, F.col("id").cast("int")).alias("day"))
    counts = recent.groupBy("enterprise_id", F.col("created_day").alias("day")).agg(n().alias("n"))
    return best.crossJoin(F.broadcast(days)).join(counts, ["enterprise_id", "day"], "left").na.fill(0, ["n"])


OPERATORS = {
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "not_contains": lambda c, v: ~F.contains(c, F.lit(v)),
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
}


def filters(conditions: list[dict]) -> Column:
    """All of {field, op, value}; a null counts as empty, unknown operators are left out."""
    out = F.lit(True)
    for f in conditions:
        if f.get("op") in OPERATORS and f.get("field"):
            out = out & OPERATORS[f["op"]](F.coalesce(F.col(f["field"]).cast("string"), F.lit("")), str(f.get("value", "")))
    return out


def metric(kind: str, field: str | None = None) -> Column:
    """Count, or sum or average of the amounts of a text column in cents (average rounded)."""
    if kind == "count":
        return n()
    total = F.coalesce(F.sum(cents(F.col(field))), F.lit(0))
    return total if kind == "sum" else F.coalesce(F.round(F.sum(cents(F.col(field))) / F.count(cents(F.col(field)))).cast("long"), F.lit(0))


def metric_cards(records: DataFrame, cards: list[dict]) -> DataFrame:
    """One row, a column for each card {name, kind, field, filters}, from one pass."""
    columns = []
    for card in cards:
        ok = filters(card.get("filters", []))
        value = F.lit(1) if card["kind"] == "count" else F.when(ok, cents(F.col(card["field"])))
        if card["kind"] == "count":
            columns.append(n(ok).alias(card["name"]))
        elif card["kind"] == "sum":
            columns.append(F.coalesce(F.sum(value), F.lit(0)).alias(card["name"]))
        else:
            columns.append(F.coalesce(F.round(F.sum(value) / F.count(value)).cast("long"), F.lit(0)).alias(card["name"]))
    return records.agg(*columns)


def grain(first: str, last: str) -> str:
    """Day up to 31 days, week up to 92, else month."""
    import datetime

    days = (datetime.date.fromisoformat(last) - datetime.date.fromisoformat(first)).days + 1
    return "day" if days <= 31 else "week" if days <= 92 else "month"


def trend(records: DataFrame, first: str, last: str, day: str = "created_day") -> DataFrame:
    """Count and premium by bucket, without gaps, at most 400 buckets."""
    unit = grain(first, last)
    bucket = F.date_trunc(unit, F.col(day).cast("timestamp_ntz")).cast("date")
    span = F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    found = records.where(span).groupBy(bucket.alias("bucket")).agg(n().alias("n"), F.coalesce(F.sum(cents(F.col("total_premium"))), F.lit(0)).alias("premium_cents"))
    buckets = calendar(records, first, last).select(F.date_trunc(unit, F.col("day").cast("timestamp_ntz")).cast("date").alias("bucket")).distinct().orderBy("bucket").limit(400)
    return buckets.join(found, "bucket", "left").na.fill(0)


def group_chart(records: DataFrame, key: str, top: int = 5, merge: dict[str, str] | None = None) -> DataFrame:
    """A metric by a merged dimension; blanks are unassigned, groups behind the top ones are made anew as other.

    Ties go by name.  Only group totals are ranked, so the ranking window is small.
    """
    name = F.coalesce(blank_to_null(F.col(key).cast("string")), F.lit(UNASSIGNED))
    for old, new in (merge or {}).items():
        name = F.when(name == old, new).otherwise(name)
    totals = records.groupBy(name.alias("name")).agg(n().alias("n"), F.coalesce(F.sum(cents(F.col("total_premium"))), F.lit(0)).alias("premium_cents"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("premium_cents"), "name")))
    shown = F.when(F.col("rank") <= top, F.col("name")).otherwise(OTHER)
    return ranked.groupBy(shown.alias("name")).agg(F.sum("n").alias("n"), F.sum("premium_cents").alias("premium_cents"))


def ranking(records: DataFrame, targets: DataFrame, person: str = "salesperson") -> DataFrame:
    """Count, premium, target and attainment for each person; a personal target goes before the unified one.

    ``targets`` has ``employee_name`` (blank: for all) and ``target_cents``; it is configuration, a few rows.
    """
    name = F.coalesce(blank_to_null(F.col(person)), F.lit(UNASSIGNED))
    found = records.groupBy(name.alias("name")).agg(n().alias("n"), F.coalesce(F.sum(cents(F.col("total_premium"))), F.lit(0)).alias("premium_cents"))
    own = targets.where("employee_name != ''").groupBy(F.col("employee_name").alias("name")).agg(F.max("target_cents").alias("own"))
    unified = targets.where("employee_name = ''").agg(F.max("target_cents").alias("unified"))
    goal = F.coalesce("own", "unified")
    return found.join(own, "name", "left").crossJoin(F.broadcast(unified)).select("name", "n", "premium_cents", goal.alias("target_cents"), F.when(goal > 0, F.round(F.col("premium_cents") * 100.0 / goal, 2)).alias("attained"))


def period(kind: Column, start: Column, end: Column, today: str) -> tuple[Column, Column]:
    """First and last day of the current month, quarter or year, or of a custom period."""
    day = F.lit(today).cast("date")
    first = F.when(kind == "month", F.trunc(day, "month")).when(kind == "quarter", F.trunc(day, "quarter")).when(kind == "year", F.trunc(day, "year")).otherwise(start)
    months = F.when(kind == "month", 1).when(kind == "quarter", 3).otherwise(12)
    return first, F.when(kind.isin("month", "quarter", "year"), F.date_sub(F.add_months(first, months), 1)).otherwise(end)


def running_totals(records: DataFrame) -> DataFrame:
    """Premium of each tenant up to each day, in cents: ``enterprise_id``, ``day`` (every day from its first record to its last), ``total``, ``first_day`` and ``last_day``."""
    days = records.groupBy("enterprise_id", F.col("created_day").alias("day")).agg(F.sum(cents(F.col("total_premium"))).alias("cents")).where("day is not null")
    spans = days.groupBy("enterprise_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    calendar = spans.withColumn("day", F.explode(F.sequence("first_day", "last_day")))
    up_to = Window.partitionBy("enterprise_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return calendar.join(days, ["enterprise_id", "day"], "left").select("enterprise_id", "day", F.coalesce(F.sum("cents").over(up_to), F.lit(0)).alias("total"), "first_day", "last_day")


def attainment(records: DataFrame, targets: DataFrame, today: str) -> DataFrame:
    """Actual premium of each target's tenant and period.

    ``targets``: ``target_id``, ``enterprise_id``, ``period_type``, ``period_start``, ``period_end``, ``target_cents``.  A period's premium is the tenant's
    running total at its end without that before its start: two look-ups by tenant and day a target, however long periods are and however they overlap.
    """
    first, last = period(F.col("period_type"), F.col("period_start"), F.col("period_end"), today)
    totals = running_totals(records)
    ends = totals.where(F.col("day") == F.col("last_day")).select("enterprise_id", F.col("last_day").alias("__last"))
    spans = targets.select("target_id", "enterprise_id", "target_cents", first.alias("first_day"), last.alias("last_day")).join(ends, "enterprise_id", "left")
    whole = F.col("first_day") <= F.col("last_day")
    look = lambda sign, day: F.struct(F.lit(sign).alias("sign"), F.when(whole, F.least(day, F.col("__last"))).alias("day"))
    asked = spans.select("target_id", "enterprise_id", "target_cents", "first_day", "last_day", F.explode(F.array(look(1, F.col("last_day")), look(-1, F.date_sub("first_day", 1)))).alias("l")).select("*", "l.sign", "l.day").drop("l")
    # days before the tenant's first record meet nothing and count as 0
    met = asked.join(totals.select("enterprise_id", "day", "total"), ["enterprise_id", "day"], "left")
    found = met.groupBy("target_id", "first_day", "last_day", "target_cents").agg(F.coalesce(F.sum(F.col("sign") * F.col("total")), F.lit(0)).alias("actual_cents"))
    return found.withColumn("attained", F.when(F.col("target_cents") > 0, F.round(F.col("actual_cents") * 100.0 / F.col("target_cents"), 2)))


def base_set(records: DataFrame, first: str, last: str) -> DataFrame:
    """Finished live policies, or records without category, of a period by sign date, else the day of creation."""
    day = F.coalesce("sign_date", "created_day")
    ok = (F.col("status") == "done") & (F.coalesce(blank_to_null(F.col("doc_category")), F.lit(POLICY)) == POLICY)
    return live(records).where(ok).withColumn("period_day", day).where(F.col("period_day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def ai_stats(logs: DataFrame, records: DataFrame) -> DataFrame:
    """By tenant and in all (null), checks by result, accuracy, tokens, records, and the three fields most often wrong.

    ``logs`` has ``diffs``, an array of field names.  Field counts are made before they are ranked.
    """
    result = [n(F.col("result") == r).alias(f"n_{r}") for r in ("pass", "corrected", "flagged")]
    main = logs.rollup("enterprise_id").agg(n().alias("checks"), *result, F.sum("tokens").alias("tokens"), F.grouping("enterprise_id").alias("in_all"))
    wrong = logs.select("enterprise_id", F.explode("diffs").alias("field")).rollup("field", "enterprise_id").agg(n().alias("n"), F.grouping("enterprise_id").alias("in_all")).where("field is not null")
    best = wrong.withColumn("rank", F.row_number().over(Window.partitionBy("in_all", "enterprise_id").orderBy(F.desc("n"), "field"))).where("rank <= 3")
    fields = best.groupBy("in_all", "enterprise_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "field"))), lambda x: x["field"])).alias("top_fields"))
    totals = live(records).rollup("enterprise_id").agg(n().alias("records"), F.grouping("enterprise_id").alias("in_all"))
    m, f, t = main.alias("m"), fields.alias("f"), totals.alias("t")
    joined = m.join(f, (F.col("m.in_all") == F.col("f.in_all")) & F.col("m.enterprise_id").eqNullSafe(F.col("f.enterprise_id")), "left").join(t, (F.col("m.in_all") == F.col("t.in_all")) & F.col("m.enterprise_id").eqNullSafe(F.col("t.enterprise_id")), "left")
    return joined.select("m.enterprise_id", "m.checks", "m.n_pass", "m.n_corrected", "m.n_flagged", rate(F.col("n_pass"), F.col("checks")).alias("accuracy"), "m.tokens", F.coalesce("top_fields", F.lit("")).alias("top_fields"), F.coalesce("records", F.lit(0)).alias("records"))


def ai_issues(logs: DataFrame) -> DataFrame:
    """For each record that was ever corrected or flagged, its checks and the newest differences that are not null."""
    return logs.groupBy("record_id").agg(n().alias("checks"), F.max_by("result", F.struct("log_id", "result")).alias("last_result"), F.max_by("diff_text", F.when(F.col("diff_text").isNotNull(), F.struct("log_id", "diff_text"))).alias("last_diff"), n(F.col("result") != "pass").alias("issues")).where("issues > 0")


def ai_logs(logs: DataFrame, number: int, size: int, enterprise_id: int | None = None, result: str | None = None) -> DataFrame:
    """A page of checks, newest first, with the number of all and their tokens beside each."""
    rows = logs if enterprise_id is None else logs.where(F.col("enterprise_id") == enterprise_id)
    rows = rows if result is None else rows.where(F.col("result") == result)
    totals = rows.agg(n().alias("total"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    return newest_page(rows, ["log_id"], number, size).crossJoin(F.broadcast(totals))


def ai_pending(records: DataFrame, logs: DataFrame) -> DataFrame:
    """By tenant, finished policies that no check has seen."""
    done = live(records).where(F.col("status").isin("done", "success") & (F.col("doc_category") == POLICY))
    return done.join(logs.select(F.col("record_id").alias("id")).distinct(), "id", "left_anti").groupBy("enterprise_id").agg(n().alias("pending"))


def ai_usage(logs: DataFrame, price_per_million: int, threshold: int) -> DataFrame:
    """Tokens a day, their cost in micro-units of money, and whether the day is above the threshold."""
    return logs.groupBy("day").agg(n().alias("checks"), F.sum("tokens").alias("tokens")).withColumns({"cost_micros": F.col("tokens") * price_per_million, "above": F.col("tokens") > threshold})


def export_audit(exports: DataFrame) -> DataFrame:
    """Exports by type: all, failed, and rows written."""
    return exports.groupBy("export_type").agg(n().alias("exports"), n(F.col("status") == "failed").alias("failed"), F.sum("row_count").alias("rows"))


def export_page(exports: DataFrame, number: int, size: int, kind: str | None = None, status: str | None = None) -> DataFrame:
    """A page of exports, newest first, with the number of all beside each; exports of one id stand by their other columns."""
    rows = exports if kind is None else exports.where(F.col("export_type") == kind)
    rows = rows if status is None else rows.where(F.col("status") == status)
    return newest_page(rows, ["export_id", *[c for c in rows.columns if c != "export_id"]], number, size).crossJoin(F.broadcast(rows.agg(n().alias("total"))))


def sender_list(messages: DataFrame) -> DataFrame:
    """Messages of each sender over all names, with the most used name that is not empty (ties by name)."""
    names = messages.groupBy("sender", "name").agg(n().alias("n"))
    key = F.struct((F.coalesce(F.col("name"), F.lit("")) != "").alias("named"), F.col("n").alias("n"), F.col("name").alias("name"))
    return names.groupBy("sender").agg(F.sum("n").alias("n"), F.max_by(F.coalesce("name", F.lit("")), key).alias("name"))


def tenant_overview(tenants: DataFrame, records: DataFrame, members: DataFrame, today: str) -> DataFrame:
    """This month's records, members and distinct rooms of each tenant, 0 where there are none."""
    day = F.lit(today).cast("date")
    month = F.col("created_day").between(F.trunc(day, "month"), day)
    used = live(records).groupBy("enterprise_id").agg(n(month).alias("this_month"), F.count_distinct(blank_to_null(F.col("roomid"))).alias("rooms"))
    people = members.groupBy("enterprise_id").agg(n().alias("members"))
    return tenants.join(used, "enterprise_id", "left").join(people, "enterprise_id", "left").na.fill(0, ["this_month", "rooms", "members"])


def tenant_links(tenants: DataFrame, pushes: DataFrame, monitors: DataFrame, users: DataFrame) -> DataFrame:
    """Of each tenant the rooms that reminders are pushed to, the distinct rooms that its monitors name, and who referred it.

    ``tenants``: ``enterprise_id``, ``referrer_id``; ``pushes``: ``config_id``, ``enterprise_id``, ``roomid``, ``room_name``, ``enabled``; ``monitors``:
    ``enterprise_id`` and ``rooms``, a JSON list of ids or of objects with an ``id``; ``users``: ``user_id``, ``user_name``, ``phone``.
    """
    live_ = pushes.where("enabled = 1 and enterprise_id is not null")
    named = F.coalesce(blank_to_null(F.col("room_name")), F.col("roomid"))
    pushed = live_.groupBy("enterprise_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("config_id", named.alias("name")))), lambda x: x["name"]).alias("push_rooms"))
    ids = F.transform(F.from_json("rooms", "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.id"), x))
    watched = monitors.where("enterprise_id is not null").select("enterprise_id", F.explode(ids).alias("roomid")).where(F.coalesce("roomid", F.lit("")) != "").groupBy("enterprise_id").agg(F.count_distinct("roomid").alias("monitored"))
    people = users.select(F.col("user_id").alias("referrer_id"), F.coalesce(blank_to_null(F.col("user_name")), blank_to_null(F.col("phone")), F.lit("")).alias("referrer"))
    joined = tenants.select("enterprise_id", "referrer_id").join(pushed, "enterprise_id", "left").join(watched, "enterprise_id", "left").join(people, "referrer_id", "left")
    rooms = F.coalesce("push_rooms", F.array().cast("array<string>"))
    return joined.select("enterprise_id", F.size(rooms).cast("long").alias("pushes"), rooms.alias("push_rooms"), F.coalesce("monitored", F.lit(0)).cast("long").alias("monitored"), F.coalesce("referrer", F.lit("")).alias("referrer"))


def quota(tenants: DataFrame, used: DataFrame, packs: DataFrame, today: str, per_month: int = 3000) -> DataFrame:
    """Whether a tenant may go on: a plan that has begun and not ended, the month's limit, then boost packs.

    ``tenants``: ``enterprise_id``, ``plan_type``, ``plan_months``, ``plan_start``; ``used``: ``enterprise_id``, ``n``; ``packs``: ``enterprise_id``,
    ``total_count``, ``used_count``, ``expires``.  Plans called ``unlimited`` have no limit.
    """
    day = F.lit(today).cast("date")
    boost = packs.where((F.col("expires") >= day) & (F.col("total_count") > F.col("used_count"))).groupBy("enterprise_id").agg(F.sum(F.col("total_count") - F.col("used_count")).alias("boost"), F.min("expires").alias("boost_expires"))
    joined = tenants.join(used, "enterprise_id", "left").join(boost, "enterprise_id", "left").na.fill(0, ["n", "boost"])
    ends = F.add_months("plan_start", F.col("plan_months"))
    state = F.when(F.col("plan_start") > day, "queued").when(ends <= day, "expired").when(F.col("plan_type") == "unlimited", "unlimited").when(F.col("n") < per_month, "within").when(F.col("boost") > 0, "boost").otherwise("exhausted")
    return joined.select("enterprise_id", ends.alias("plan_ends"), F.col("n").alias("used"), "boost", "boost_expires", state.alias("state"), state.isin("unlimited", "within", "boost").alias("allowed"))


def mask_phone(c: Column) -> Column:
    """Three first and four last digits."""
    return F.when(F.length(c) >= 8, F.concat(F.substring(c, 1, 3), F.lit("****"), F.substring(c, -4, 4))).otherwise(c)


def users_with_senders(users: DataFrame, bindings: DataFrame) -> DataFrame:
    """Users with their bound senders in order, as one text, and a masked phone."""
    bound = bindings.groupBy("user_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("sender"))).alias("senders"), F.count_distinct("sender").alias("n_senders"))
    return users.join(bound, "user_id", "left").select("user_id", "user_name", mask_phone(F.col("phone")).alias("phone"), F.coalesce("senders", F.lit("")).alias("senders"), F.coalesce("n_senders", F.lit(0)).alias("n_senders"))


def referrals(users: DataFrame) -> DataFrame:
    """The users that each referrer brought in: number, and each one's name and masked phone in order of id."""
    line = F.concat_ws(" ", F.col("user_name"), mask_phone(F.col("phone")))
    brought = users.where("referrer_id is not null").groupBy("referrer_id").agg(n().alias("n"), F.array_sort(F.collect_list(F.struct("user_id", line.alias("line")))).alias("all"))
    return brought.select("referrer_id", "n", F.array_join(F.transform("all", lambda x: x["line"]), ";").alias("people"))


def option_lookup(options: DataFrame, text: str) -> DataFrame:
    """The option with exactly this text; without one, all options that contain it; by first id."""
    pool = option_pool(options, text).withColumn("exact", F.col("option") == text)
    best = pool.agg(F.max("exact").alias("best"))
    return pool.crossJoin(F.broadcast(best)).where("exact = best").drop("exact", "best").orderBy("first_id")


def option_import(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming options that are not blank and not there yet, each once, with the number of times it came."""
    fresh = incoming.select(F.trim("option").alias("option")).where("option != ''").groupBy("option").agg(n().alias("times"))
    return fresh.join(existing.select(F.trim("option").alias("option")).distinct(), "option", "left_anti")


def option_pool(options: DataFrame, keyword: str = "") -> DataFrame:
    """Distinct options that contain a keyword, with the first id and the number of imports."""
    found = options.where(F.contains("option", F.lit(keyword)) & (F.trim("option") != ""))
    return found.groupBy(F.trim("option").alias("option")).agg(F.min("option_id").alias("first_id"), n().alias("imports"), F.count_distinct("batch").alias("batches"))


def commission(orders: DataFrame, share: int = 20) -> DataFrame:
    """Referral commission in cents: the yearly price for multiples of twelve months, none for trials."""
    price = F.lit(0)
    for plan, (month, year) in PLAN_PRICES.items():
        by_month = F.when(F.col("months") % 12 == 0, F.lit(year) * (F.col("months") / 12).cast("int")).otherwise(F.lit(month) * F.col("months"))
        price = F.when(F.col("plan_type") == plan, by_month).otherwise(price)
    return orders.withColumn("commission_cents", (price * share).cast("long"))


def wallet(transactions: DataFrame) -> DataFrame:
    """Balance by user: commissions less withdrawals that were not rejected."""
    signed = F.when(F.col("type") == "commission", F.col("cents")).when((F.col("type") == "withdraw") & (F.col("status") != "rejected"), -F.col("cents")).otherwise(0)
    return transactions.groupBy("user_id").agg(F.sum(signed).alias("balance_cents"), n().alias("transactions"))


def wallet_history(transactions: DataFrame) -> DataFrame:
    """The running balance behind each transaction."""
    signed = F.when(F.col("type") == "commission", F.col("cents")).when((F.col("type") == "withdraw") & (F.col("status") != "rejected"), -F.col("cents")).otherwise(0)
    order = Window.partitionBy("user_id").orderBy("tx_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return transactions.select("tx_id", "user_id", F.sum(signed).over(order).alias("balance_cents"))
