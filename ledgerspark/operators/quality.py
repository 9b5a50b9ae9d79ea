"""Quality and identity of records (Q1 to Q11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.columns import blank_to_null, parse_date
from ledgerspark.operators.analytics import POLICY, n

# Required output columns with their source keys, and the labels of the dates that must be whole.
REQUIRED = {
    "承保公司": ["保险公司", "保险公司简称"], "保单号": ["保单号"], "险种": ["险种类型"], "车牌": ["车牌号"], "投保人": ["投保人"],
    "被保人": ["被保险人"], "签单日期": ["签单日期"], "起保日期": ["保险起期"], "终保日期": ["保险止期"], "保费": ["保费合计"],
}
DATES = {"保险起期": "起保日期", "保险止期": "终保日期", "签单日期": "签单日期"}


def abnormal(records: DataFrame, fields: str = "fields", waive_applicant: bool = False) -> DataFrame:
    """Q1: ``abnormal`` and ``hint`` of finished policies (a blank category counts as policy) from a map of fields.

    Records marked as normal by hand (``override_reason``) and all other records are normal.  Each key is taken out of the map once.
    """
    keys = list(dict.fromkeys([k for pair in REQUIRED.values() for k in pair] + [*DATES, "新车未上牌"]))
    at = {k: f"__k{i}" for i, k in enumerate(keys)}
    rows = records.withColumns({c: blank_to_null(F.element_at(fields, F.lit(k))) for k, c in at.items()})
    has = lambda k: F.col(at[k]).isNotNull()
    product = F.coalesce(at["险种类型"], F.lit(""))
    flags = {f"__g{i}": F.coalesce(*[F.col(at[k]) for k in REQUIRED[c]]).isNull() for i, c in enumerate(REQUIRED)}
    gone = {c: F.col(f"__g{i}") for i, c in enumerate(REQUIRED)}
    rows = rows.withColumns(flags | {"__compulsory": F.contains(product, F.lit("交强")) | F.contains(product, F.lit("交通事故责任强制"))})
    new_car = has("新车未上牌")
    applicant = gone["投保人"] & gone["被保人"] if waive_applicant else gone["投保人"]
    missing = gone | {"投保人": applicant}
    labels = [F.when(missing[c] & ~(new_car if c == "车牌" else F.lit(False)), F.when(F.col("__compulsory"), "投保人(交强险通常无)").otherwise(c) if c == "投保人" else F.lit(c)) for c in REQUIRED]
    whole = r"\d{1,2}[日号]|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
    torn = [F.when(has(k) & ~F.rlike(at[k], F.lit(whole)), v) for k, v in DATES.items()]
    any_gone = F.lit(False)
    for v in missing.values():
        any_gone = any_gone | v
    checked = F.col("status").isin("done", "success") & F.coalesce(blank_to_null(F.col("doc_category")), F.lit(POLICY)).isin(POLICY) & blank_to_null(F.col("override_reason")).isNull()
    rows = rows.withColumns({"__missing": F.concat_ws("、", *labels), "__torn": F.concat_ws("、", *torn), "__any": any_gone, "__new": new_car & gone["车牌"], "__checked": checked})
    hint = F.concat_ws("；", F.when(F.col("__new"), "新车无车牌"), F.when(F.col("__missing") != "", F.concat(F.lit("缺少："), "__missing")), F.when(F.col("__torn") != "", F.concat(F.lit("日期不全："), "__torn")))
    judged = rows.withColumns({"abnormal": F.col("__checked") & (F.col("__any") | (F.col("__torn") != "")), "hint": F.when(F.col("__checked"), hint).otherwise("")})
    return judged.drop(*at.values(), *flags, "__compulsory", "__missing", "__torn", "__any", "__new", "__checked")


def backfill(records: DataFrame, side: DataFrame, short_names: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Q2: records with a blank short name filled in and the flag made anew; and the records that have no side row.

    The short name is the one among the fields, else the first of ``short_names`` (part of the insurer's name, short name) that fits.
    """
    company = F.element_at("fields", F.lit("保险公司"))
    known = [F.when(F.contains(company, F.lit(part)), F.lit(short)) for part, short in short_names or []]
    short = F.coalesce(blank_to_null(F.col("company_short")), blank_to_null(F.element_at("fields", F.lit("保险公司简称"))), *known)
    return abnormal(records.withColumn("company_short", short)), records.select("id").join(side.select(F.col("record_id").alias("id")), "id", "left_anti")


def backfill_dates(side: DataFrame, dates: dict[str, str]) -> DataFrame:
    """Q2: dates from their texts (text column to date column), where there is none yet; unreadable texts give none."""
    return side.withColumns({iso: F.coalesce(F.col(iso), parse_date(F.col(text))) for text, iso in dates.items()})


def backfill_display(records: DataFrame, columns: dict[str, str], owner: str = "车主") -> DataFrame:
    """Q2: ``display`` of records that have none, from ``fields`` under their names for display (``columns``; others keep theirs, internal ones are left out);
    and the owner in the displays that lack it.
    """
    names = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv]) if columns else F.create_map().cast("map<string,string>")
    shown = F.filter(F.map_entries("fields"), lambda e: ~F.startswith(e["key"], F.lit("_")) & (F.coalesce(e["value"], F.lit("")) != ""))
    # of several fields with one name the first by key
    renamed = F.transform(F.array_sort(shown), lambda e: F.struct(F.coalesce(F.element_at(names, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    made = F.aggregate(renamed, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.create_map(e["key"], e["value"]))))
    old = F.coalesce(F.col("display"), F.create_map().cast("map<string,string>"))
    display = F.when(F.size(old) == 0, F.coalesce(made, old)).otherwise(old)
    own = blank_to_null(F.element_at("fields", F.lit(owner)))
    rows = records.withColumn("display", display)
    lacks = blank_to_null(F.element_at("display", F.lit(owner))).isNull() & own.isNotNull()
    return rows.withColumn("display", F.when(lacks, F.map_concat(F.map_filter("display", lambda k, _: k != owner), F.create_map(F.lit(owner), own))).otherwise(F.col("display")))


def recheck(records: DataFrame, waive_applicant: bool = False) -> DataFrame:
    """Q2: the flag made anew both ways: ``outcome`` is ``raised``, ``cleared``, ``reworded`` or ``kept``, from ``is_abnormal`` and ``hint`` as they were."""
    rows = abnormal(records.withColumnRenamed("hint", "__hint") if "hint" in records.columns else records.withColumn("__hint", F.lit("")), waive_applicant=waive_applicant)
    was = F.coalesce(F.col("is_abnormal"), F.lit(0)) == 1
    outcome = F.when(~was & F.col("abnormal"), "raised").when(was & ~F.col("abnormal"), "cleared").when(was & ~F.col("hint").eqNullSafe(F.col("__hint")), "reworded").otherwise("kept")
    return rows.withColumn("outcome", outcome).drop("__hint")


def strip_disabled(fields: Column, disabled: list[str], manual: Column) -> Column:
    """Q3: a map without disabled keys, but for those edited by hand."""
    by_hand = F.coalesce(manual, F.array().cast("array<string>"))
    return F.map_filter(fields, lambda k, v: ~k.isin(disabled) | F.array_contains(by_hand, k))


def reread(records: DataFrame) -> DataFrame:
    """Q4: a second reading: ``merged`` fields (hand-edited ones stay), and ``conflicts`` where that hides a different value."""
    manual = F.coalesce("manual_fields", F.array().cast("array<string>"))
    kept = F.map_filter("old_fields", lambda k, v: F.array_contains(manual, k))
    fresh = F.map_filter("new_fields", lambda k, v: ~F.map_contains_key(kept, k))
    differ = F.filter(F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.struct(k.alias("field"), F.element_at(kept, k).alias("manual"), F.element_at("new_fields", k).alias("read"))), lambda x: (F.coalesce(x["read"], F.lit("")) != "") & ~x["read"].eqNullSafe(x["manual"]))
    return records.withColumns({"merged": F.map_concat(fresh, kept), "conflicts": differ, "first_read_at": F.coalesce("first_read_at", "read_at")})


def file_identity(records: DataFrame) -> DataFrame:
    """Q5: each record against the first finished one of its file hash: ``duplicate`` (same message), ``copy`` (another) or ``new``."""
    done = records.where("file_md5 != '' and status in ('done', 'success')").groupBy("file_md5").agg(F.min(F.struct("id", "msg_seq")).alias("first"))
    j = records.join(done, "file_md5", "left")
    outcome = F.when(F.col("first").isNull() | (F.col("first.id") >= F.col("id")), "new").when(F.col("first.msg_seq") == F.col("msg_seq"), "duplicate").otherwise("copy")
    return j.select("id", "file_md5", F.when(outcome != "new", F.col("first.id")).alias("source_id"), outcome.alias("outcome"))


def upsert_by_policy(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Q6: incoming rows with the id of the newest existing row of the same number, user and tenant (null equals null), or null to insert."""
    newest = existing.where("policy_no != ''").groupBy("policy_no", "user_id", "enterprise_id").agg(F.max("id").alias("target_id"))
    e, i = newest.alias("e"), incoming.alias("i")
    same = (F.col("i.policy_no") == F.col("e.policy_no")) & F.col("i.user_id").eqNullSafe(F.col("e.user_id")) & F.col("i.enterprise_id").eqNullSafe(F.col("e.enterprise_id"))
    return i.join(e, same, "left").select("i.*", "target_id")


def backfill_owner(records: DataFrame, rooms: DataFrame, senders: DataFrame) -> DataFrame:
    """Q7: owner by room, for private messages by sender; the old one stays where there is no new one."""
    by_room = rooms.groupBy("roomid").agg(F.min("user_id").alias("u1"))
    by_sender = senders.groupBy("sender").agg(F.min("user_id").alias("u2"))
    j = records.join(by_room, "roomid", "left").join(by_sender, "sender", "left")
    fresh = F.when(F.col("roomid") != "", F.col("u1")).otherwise(F.col("u2"))
    return j.withColumn("user_id", F.coalesce(fresh, "user_id")).drop("u1", "u2")


AMOUNT_FIELDS, DATE_FIELDS = ("保费合计", "不含税保费", "增值税额", "车船税"), ("保险起期", "保险止期", "签单日期", "初次登记日期", "收费确认时间")


def comparable(field: str, value: Column, strip_zeros: bool = False) -> Column:
    """Q8: a value as it is compared: amounts with two decimals, dates as digits, plates and frame numbers in upper case."""
    v = F.trim(F.coalesce(value, F.lit("")))
    if field in AMOUNT_FIELDS:
        bare = F.regexp_replace(v, r"[¥￥,，\s元]", "")
        return F.coalesce(F.format_string("%.2f", bare.try_cast("double")), bare)
    if field in DATE_FIELDS:
        parts = F.regexp_extract_all(v, F.lit(r"(\d+)"), F.lit(1))
        digits = F.array_join(F.transform(parts, lambda x, i: F.when(i.isin(1, 2), F.lpad(x, F.greatest(F.length(x), F.lit(2)), F.lit("0"))).otherwise(x)), "")
        return F.regexp_replace(digits, "0+$", "") if strip_zeros else digits
    if field == "车牌号":
        return F.upper(F.regexp_replace(v, r"[-—\s·]", ""))
    return F.upper(F.regexp_replace(v, r"\s", "")) if field == "车架号VIN" else F.regexp_replace(v, r"\s", "")


def differences(records: DataFrame, fields: list[str], current: str = "fields", other: str = "ai_fields", manual: str = "manual_fields") -> DataFrame:
    """Q8: ``diffs``: fields in which a second reader differs (``diff``) or knows more (``supplement``), and whether they were edited by hand.

    Values, their comparable forms and the kinds are columns of their own on the way, so each is made once; ``norm`` is the comparable form of the
    second reader's value.
    """
    by_hand = F.coalesce(F.col(manual), F.array().cast("array<string>"))
    value = lambda c, f: F.trim(F.coalesce(F.element_at(c, F.lit(f)), F.lit("")))
    a, b, norm, kind = ({f: f"__{x}{i}" for i, f in enumerate(fields)} for x in "abnk")
    rows = records.withColumns({a[f]: value(current, f) for f in fields} | {b[f]: value(other, f) for f in fields})
    rows = rows.withColumns({norm[f]: F.when(F.col(b[f]) != "", comparable(f, F.col(b[f]))) for f in fields})
    same = lambda f: (F.col(a[f]) == F.col(b[f])) | (comparable(f, F.col(a[f])) == F.col(norm[f]))
    rows = rows.withColumns({kind[f]: F.when(F.col(b[f]) == "", None).when(F.col(a[f]) == "", "supplement").when(~same(f), "diff") for f in fields})
    entry = lambda f: F.when(F.col(kind[f]).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(a[f]).alias("current"), F.col(b[f]).alias("ai"), F.col(kind[f]).alias("type"), F.array_contains(by_hand, F.lit(f)).alias("manual"), F.col(norm[f]).alias("norm")))
    return rows.withColumn("diffs", F.array_compact(F.array(*[entry(f) for f in fields]))).drop(*a.values(), *b.values(), *norm.values(), *kind.values())


def settle(records: DataFrame, fields: list[str], text: str = "raw_text") -> DataFrame:
    """Q9: ``fixed`` fields, ``result`` and ``n_flagged`` from ``diffs`` (see ``differences``), of which those of ``fields`` can be put right.

    A difference is put right if it was not edited by hand and is a supplement, or its value stands in the text; all others are flagged.
    The text is brought into its three forms once, and only where there are differences.
    """
    some = F.size("diffs") > 0
    rows = records.withColumn("__t", F.when(some, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\s,，¥￥]", "")))
    rows = rows.withColumns({"__digits": F.regexp_replace("__t", r"\D", ""), "__upper": F.upper("__t")})
    searched = lambda d: F.when(d["field"].isin(*DATE_FIELDS), F.col("__digits")).when(d["field"].isin("车牌号", "车架号VIN"), F.col("__upper")).otherwise(F.col("__t"))
    ok = lambda d: d["field"].isin(*fields) & ~d["manual"] & ((d["type"] == "supplement") | ((d["norm"] != "") & F.contains(searched(d), d["norm"])))
    rows = rows.withColumn("fixable", F.filter("diffs", ok))
    new = F.map_from_entries(F.transform("fixable", lambda x: F.struct(x["field"].alias("key"), x["ai"].alias("value"))))
    old = F.map_filter("fields", lambda k, v: ~F.exists("fixable", lambda x: x["field"] == k))
    flagged = F.size("diffs") - F.size("fixable")
    result = F.when(F.size("diffs") == 0, "pass").when(flagged > 0, "flagged").otherwise("corrected")
    fixed = F.when(F.size("fixable") == 0, F.col("fields")).otherwise(F.map_concat(old, new))
    return rows.withColumns({"fixed": fixed, "n_flagged": flagged, "result": result}).drop("__t", "__digits", "__upper")


def in_check_scope(records: DataFrame, statuses: list[str], companies: list[str], rare_below: int) -> DataFrame:
    """Q10: records of some kinds, of some insurers, or of insurers with few records so far."""
    history = records.groupBy("company_short").agg(n().alias("history"))
    kind = F.when(F.col("is_abnormal") == 1, "abnormal").when(F.col("doc_category") != POLICY, "non_policy").otherwise("normal")
    j = records.join(history, "company_short", "left")
    return j.where(kind.isin(statuses) | F.col("company_short").isin(companies) | (F.col("history") < rare_below))


def note_summary(notes: DataFrame, today: str) -> DataFrame:
    """Q11: by record, notes, the latest one, and whether there is one of today."""
    return notes.groupBy("record_id").agg(n().alias("notes"), F.max_by("content", "note_id").alias("last_content"), F.max("created_day").alias("last_day"), F.max(F.col("created_day") == F.lit(today).cast("date")).alias("reviewed_today"))


def newest_per_file(records: DataFrame) -> DataFrame:
    """Q5: the newest record of each file hash."""
    return records.withColumn("k", F.row_number().over(Window.partitionBy("file_md5").orderBy(F.desc("id")))).where("k = 1 and file_md5 != ''").drop("k")
