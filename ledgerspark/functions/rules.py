"""Configured columns (C1 to C9): aliases, dates, percents, ratio rules and formulas, compiled to Column expressions.

Configuration is small and lives on the driver; compiling it never touches the records.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.columns import CLASS_LABELS, SORT_CLASSES, blank_to_null, formula_number, format_date, hyphen_plate, product_class


def resolve_scope(configs: DataFrame, order: list[str], key: str = "config_key", active: str | None = None) -> DataFrame:
    """For each key, the configuration of the first scope in ``order`` that has one; within a scope active ones, then the newest.

    ``configs`` has ``scope``, ``config_id``, the key and a value; unknown scopes do not count.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("scope"))
    first = [F.desc(active)] if active else []
    ranked = configs.where(place > 0).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(place, *first, F.desc("config_id"))))
    return ranked.where("place = 1").drop("place")


def alias(c: Column, names: dict[str, str]) -> Column:
    """A value's alias: an equal name first, else the longest name that the value contains; others stay."""
    out = c
    for old in sorted(names, key=lambda k: (len(k), k)):
        out = F.when(F.contains(c, F.lit(old)), names[old]).otherwise(out)
    for old, new in names.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def apply_aliases(records: DataFrame, aliases: dict[str, dict[str, str]], manual: str | None = None) -> DataFrame:
    """Aliases for several columns; fields edited by hand are left alone."""
    out = {}
    for c, names in aliases.items():
        value = alias(F.col(c), names)
        out[c] = F.when(F.array_contains(F.coalesce(F.col(manual), F.array().cast("array<string>")), c), F.col(c)).otherwise(value) if manual else value
    return records.withColumns(out)


def quick_class(product: Column) -> Column:
    """The four-class mode: the class's label."""
    out = F.lit("非车险")
    for k, v in CLASS_LABELS.items():
        out = F.when(product_class(product) == k, v).otherwise(out)
    return out


def fixed_values(records: DataFrame, values: dict[str, str]) -> DataFrame:
    """C4: constants for blanks."""
    return records.withColumns({c: F.coalesce(blank_to_null(F.col(c)), F.lit(v)) for c, v in values.items()})


def percent_to_number(c: Column) -> Column:
    """10 or 10% is 0.1; null without a number."""
    text = F.trim(c)
    number = F.regexp_replace(text, "%", "").try_cast("double") / 100
    return F.when(F.rlike(text, F.lit(r"^-?\d+(?:\.\d+)?%?$")), number)


def number_to_percent(c: Column) -> Column:
    """0.1 is 10%, with up to four decimals and no trailing zeros."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.round(c * 100, 4)), "0+$", ""), r"\.$", "")
    return F.when(c.isNotNull(), F.concat(text, F.lit("%")))


def rule_matches(rule: str, value: Column) -> Column:
    """A rule's insurer or class fits if either contains the other; blank rules, the word for all and blank values always fit."""
    if not rule or rule == "全部":
        return F.lit(True)
    v = F.coalesce(value, F.lit(""))
    return F.contains(v, F.lit(rule)) | F.contains(F.lit(rule), v)


def condition(c: dict, columns: dict[str, Column]) -> Column:
    """{field, op, value}: eq, ne, contains, not_contains, empty, not_empty, gt, ge, lt, le; numbers are compared as such.

    A condition of type ``related`` takes a boolean column that is made before (see ``related`` in completion).
    """
    if c.get("type") == "related":
        found = F.coalesce(columns[c["column"]], F.lit(False))
        return ~found if c.get("op") == "not_exists" else found
    v, value, op = F.coalesce(columns[c["field"]].cast("string"), F.lit("")), str(c.get("value", "")), c.get("op", "eq")
    if op in ("gt", "ge", "lt", "le"):
        left, right = F.regexp_replace(v, r"[^\d.\-]", "").try_cast("double"), float(value)
        return F.coalesce({"gt": left > right, "ge": left >= right, "lt": left < right, "le": left <= right}[op], F.lit(False))
    return {"eq": v == value, "ne": v != value, "contains": F.contains(v, F.lit(value)), "not_contains": ~F.contains(v, F.lit(value)), "empty": v == "", "not_empty": v != ""}[op]


def ratio(rules: list[dict], target: str, columns: dict[str, Column], insurer: Column, product: Column) -> Column:
    """The value of ``target`` by the last fitting rule {target, company, product, branches, default}, as text.

    Of a rule's branches {conditions, value} the first whose conditions all hold decides, else the default; a rule
    without a value leaves what earlier rules gave.
    """
    out = F.lit(None).cast("string")
    for r in (r for r in rules if r["target"] == target):
        value = F.lit(r.get("default")).cast("string")
        for b in reversed(r.get("branches") or []):
            ok = F.lit(bool(b.get("conditions")))
            for c in b.get("conditions") or []:
                ok = ok & condition(c, columns)
            value = F.when(ok, F.lit(b.get("value")).cast("string")).otherwise(value)
        fits = rule_matches(r.get("company", ""), insurer) & rule_matches(r.get("product", ""), product)
        out = F.when(fits, F.coalesce(value, out)).otherwise(out)
    return out


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


PRIORITY = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3}


def tokens(formula: str, names: list[str]) -> list[Token] | None:
    """Numbers, operators, brackets and fields, the longest field first; unknown Chinese words are the number 0; None for anything else."""
    out, rest = [], formula.replace("×", "*").replace("÷", "/")
    ordered = sorted(names, key=lambda n: (-len(n), n))
    while rest := rest.lstrip():
        name = next((n for n in ordered if n and rest.startswith(n)), None)
        if name:
            out.append(Token("field", name))
            rest = rest[len(name) :]
        elif m := re.match(r"\d+(?:\.\d+)?|\.\d+", rest):
            out.append(Token("number", m.group(0)))
            rest = rest[m.end() :]
        elif rest[0] in "+-*/()":
            out.append(Token("op", rest[0]))
            rest = rest[1:]
        elif m := re.match(r"[一-鿿][一-鿿\w#]*", rest):
            out.append(Token("number", "0"))
            rest = rest[m.end() :]
        else:
            return None
    return out


def formula(text: str, columns: dict[str, Column]) -> Column:
    """A formula as a double, floored to two decimals; null for bad formulas and divisions by zero.

    Operators are put in order with two stacks; fields are read by ``formula_number``.
    """
    found = tokens(text, list(columns))
    bad = F.lit(None).cast("double")
    values: list[Column] = []
    waiting: list[str] = []

    def reduce() -> None:
        op = waiting.pop()
        if op == "neg":
            values.append(-values.pop())
            return
        b, a = values.pop(), values.pop()
        values.append({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b != 0, a / b)}[op]())

    try:
        before = None
        for t in found or []:
            if t.kind == "number":
                values.append(F.lit(float(t.text)))
            elif t.kind == "field":
                values.append(formula_number(columns[t.text]))
            elif t.text == "(":
                waiting.append("(")
            elif t.text == ")":
                while waiting[-1] != "(":
                    reduce()
                waiting.pop()
            else:
                unary = before is None or before.kind == "op" and before.text != ")"
                if unary and t.text == "+":
                    continue
                op = "neg" if unary and t.text == "-" else t.text
                if unary and t.text in "*/":
                    return bad
                while not unary and waiting and waiting[-1] != "(" and PRIORITY[waiting[-1]] >= PRIORITY[op]:
                    reduce()
                waiting.append(op)
            before = t
        while waiting:
            reduce()
        (value,) = values
    except (IndexError, KeyError, ValueError):
        return bad
    return F.floor(value * 100) / 100


def formula_text(value: Column) -> Column:
    """Whole numbers without decimals, others with two; blank for null."""
    whole = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.format_string("%.2f", value))
    return F.when(value.isNull(), "").otherwise(whole)


def ordered(formulas: list[dict]) -> list[dict]:
    """Formulas after those they use; where they use each other in a circle, the given order twice."""
    targets = {f["target"] for f in formulas}
    uses = lambda f: {t for t in targets if t != f["target"] and t in f["expr"]}
    done: list[dict] = []
    left = list(formulas)
    while left:
        ready = [f for f in left if not uses(f) & {x["target"] for x in left}]
        if not ready:
            return done + left + left
        done += ready
        left = [f for f in left if f not in ready]
    return done


def apply_formulas(records: DataFrame, formulas: list[dict], fields: list[str], insurer: str = "company_short", product: str = "policy_type") -> DataFrame:
    """Columns by formulas {target, company, product, expr}; where no formula fits, a target keeps its value."""
    out = records
    for f in ordered(formulas):
        known = {n: F.col(n) for n in [*fields, *[x["target"] for x in formulas]] if n in out.columns}
        fits = rule_matches(f.get("company", ""), F.col(insurer)) & rule_matches(f.get("product", ""), F.col(product))
        old = F.col(f["target"]) if f["target"] in out.columns else F.lit(None).cast("string")
        out = out.withColumn(f["target"], F.when(fits, formula_text(formula(f["expr"], known))).otherwise(old))
    return out


def split_premium(records: DataFrame, premium: str = "total_premium", product: str = "policy_type") -> DataFrame:
    """A premium column for each label, the own one with the premium, the others 0, unless the records have them."""
    label = quick_class(F.col(product))
    new = {f"{p}保费": F.when(label == p, F.coalesce(F.col(premium), F.lit("0"))).otherwise("0") for p in SORT_CLASSES if f"{p}保费" not in records.columns}
    return records.withColumns(new)


def finish(records: DataFrame, hyphen_insurer: str, fill_applicant: bool = True) -> DataFrame:
    """Plates with a hyphen for one insurer; a blank applicant is the insured."""
    plate = F.when(F.contains("company_short", F.lit(hyphen_insurer)), hyphen_plate(F.replace("plate_no", F.lit("-"), F.lit("")))).otherwise(F.col("plate_no"))
    applicant = F.coalesce(blank_to_null(F.col("applicant")), F.col("insured")) if fill_applicant else F.col("applicant")
    return records.withColumns({"plate_no": plate, "applicant": applicant})


def format_dates(records: DataFrame, formats: dict[str, tuple[str, bool]]) -> DataFrame:
    """Date columns by their pattern and whether it pads."""
    return records.withColumns({c: format_date(F.col(c), tokens_, pad) for c, (tokens_, pad) in formats.items()})
