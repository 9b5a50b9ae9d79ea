"""Rules of many tenants as tables (M16, C6, C7): one plan for all tenants, whatever their number.

A tenant's rules are one row of a rule table, an array in the order in which they count.  Records meet them by an equi-join on the
tenant, and higher-order functions run them: keyword rules cut a text at all keywords at once, ratio rules filter their branches, and
formulas are postfix programs on a stack.  The plan holds no rule, so it does not grow with tenants or rules.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.columns import blank_to_null, formula_number
from ledgerspark.functions.rules import PRIORITY, formula_text, tokens

# Patterns of typed values; texts end at blanks and punctuation.
VALUE_PATTERNS = {"number": r"(\d+(?:\.\d+)?)", "phone": r"(\d(?:[\- ]?\d){2,19})", "mobile": r"(1[3-9]\d{9})", "percent": r"(\d+(?:\.\d+)?%?)", "name": r"([一-鿿A-Za-z]{1,6})"}
#: What matches nothing, for tenants without keywords.
NOTHING = "(?!)"


# Keyword rules


def keyword_pattern(keywords: Column, gap: str) -> Column:
    """A pattern of all keywords, the longest first, each with ``gap`` between its characters."""
    longest = F.array_sort(F.array_distinct(F.transform(keywords, lambda k: F.struct((-F.length(k)).alias("less"), k.alias("word")))))
    one = lambda k: F.array_join(F.transform(F.split(k["word"], ""), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), gap)
    return F.when(F.size(longest) > 0, F.array_join(F.transform(longest, one), "|")).otherwise(F.lit(NOTHING))


def keyword_table(rules: DataFrame, tenant: str = "enterprise_id", gap: str = r"[ \t]*") -> DataFrame:
    """By tenant ``rules`` and ``pattern``, from rows of ``rule_no``, ``target``, ``keywords``, ``value_type`` and ``enabled``.

    Disabled rules, and rules without a target or a keyword, do not count.  Of rules with one target the first number goes first, of its keywords the first one.
    """
    live = rules.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("target", F.lit("")) != ""))
    each = live.select(tenant, "rule_no", "target", F.lower(F.coalesce(blank_to_null(F.col("value_type")), F.lit("text"))).alias("kind"), F.posexplode("keywords").alias("word_no", "word"))
    named = each.withColumn("word", F.regexp_replace(F.trim("word"), r"\s", "")).where("word != ''")
    rows = named.groupBy(tenant).agg(F.array_sort(F.collect_list(F.struct("rule_no", "word_no", "target", "word", "kind"))).alias("rules"))
    return rows.withColumn("pattern", keyword_pattern(F.transform("rules", lambda r: r["word"]), gap))


def keyword_column(rules: list[dict], gap: str = r"[ \t]*") -> tuple[Column, Column]:
    """The columns ``rules`` and ``pattern`` of one tenant's rules {target, keywords, value_type, enabled}."""
    live = [(i, r) for i, r in enumerate(rules) if r.get("enabled", True) and r.get("target")]
    words = [(i, j, r["target"], "".join(k.split()), (r.get("value_type") or "text").lower()) for i, r in live for j, k in enumerate(r.get("keywords") or []) if k and k.strip()]
    row = lambda values: F.struct(*[F.lit(v).alias(c) for c, v in zip(("rule_no", "word_no", "target", "word", "kind"), values)])
    # literals, so that the pattern is compiled once
    longest = sorted({w[3] for w in words}, key=lambda w: (-len(w), w))
    pattern = "|".join(gap.join(f"\\Q{c}\\E" for c in w) for w in longest) or NOTHING
    return F.array(*map(row, words or [(0, 0, "", "", "")])), F.lit(pattern)


def typed_value(rest: Column, kind: Column, gap: str, colon_ends: bool) -> Column:
    """The value of a type at the head of what follows a keyword; blank if there is none."""
    head = lambda p: F.trim(F.regexp_extract(rest, f"^{gap}[:：]?{gap}{p}", 1))
    plain = lambda most: rf"([^\s，,。、；;{':：' if colon_ends else ''}]{{1,{most}}})"
    out = F.when(kind == "short", head(plain(10)))
    for name, pattern in VALUE_PATTERNS.items():
        out = out.when(kind == name, head(pattern))
    return out.otherwise(head(plain(20)))


def keyword_fields(text: Column, rules: Column, pattern: Column, gap: str = r"[ \t]*", stop: bool = True) -> Column:
    """A map of the targets' values in a text.

    The text is cut at all keywords in one pass, from left to right and the longest first, into hits and what follows each.  A value stands at the
    head of what follows; it ends where the next keyword begins, unless ``stop`` is off.  Of a target the first keyword with a value wins, of its hits the first.
    """
    hits, pieces, all_ = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern), F.lit(1 << 30)
    word = lambda h: F.regexp_replace(h, r"\s", "").alias("word")
    if stop:
        pairs = F.zip_with(hits, F.slice(pieces, F.lit(2), all_), lambda h, r: F.struct(word(h), r.alias("rest")))
    else:  # behind each hit, the rest of the text
        steps = F.zip_with(hits, pieces, lambda h, p: F.struct(word(h), (F.length(p) + F.length(h)).alias("step")))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<word:string,rest:string>>").alias("found"))
        add = lambda a, s: F.struct((a["at"] + s["step"]).alias("at"), F.concat(a["found"], F.array(F.struct(s["word"], F.substr(text, a["at"] + s["step"]).alias("rest")))).alias("found"))
        pairs = F.aggregate(F.filter(steps, lambda s: s["word"].isNotNull()), start, add, lambda a: a["found"])
    one = lambda p, i: F.transform(F.filter(rules, lambda r: r["word"] == p["word"]), lambda r: F.struct(r["rule_no"].alias("rule_no"), r["word_no"].alias("word_no"), i.alias("at"), r["target"].alias("target"), typed_value(p["rest"], r["kind"], gap, stop).alias("value")))
    found = F.transform(pairs, one)
    filled = F.array_sort(F.filter(F.flatten(found), lambda c: c["value"] != ""))
    none = F.create_map().cast("map<string,string>")
    return F.when(text.isNotNull() & rules.isNotNull(), F.aggregate(filled, none, lambda m, c: F.when(F.map_contains_key(m, c["target"]), m).otherwise(F.map_concat(m, F.create_map(c["target"], c["value"])))))


# Ratio rules


def holds(c: Column, values: Column) -> Column:
    """A condition (``field``, ``op``, ``value``) on a map of a record's texts; related policies are fields with the text true."""
    text, value, op = F.coalesce(F.element_at(values, c["field"]), F.lit("")), F.coalesce(c["value"], F.lit("")), c["op"]
    left, right = F.regexp_replace(text, r"[^\d.\-]", "").try_cast("double"), value.try_cast("double")
    compared = F.when(op == "gt", left > right).when(op == "ge", left >= right).when(op == "lt", left < right).when(op == "le", left <= right)
    out = F.when(op == "eq", text == value).when(op == "ne", text != value).when(op == "contains", F.contains(text, value)).when(op == "not_contains", ~F.contains(text, value))
    out = out.when(op == "empty", text == "").when(op == "not_empty", text != "").when(op == "exists", text == "true").when(op == "not_exists", text != "true")
    return F.coalesce(out.otherwise(compared), F.lit(False))


def fits(rule: Column, value: Column) -> Column:
    """A rule's insurer or class fits if either contains the other; blank rules, the word for all and blank values always fit."""
    r, v = F.coalesce(rule, F.lit("")), F.coalesce(value, F.lit(""))
    return (r == "") | (r == "全部") | F.contains(v, r) | F.contains(r, v)


def put(values: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(values, lambda k, _: k != key), F.create_map(key, value))


def ratio_values(rules: Column, values: Column, insurer: Column, product: Column) -> Column:
    """A map of targets to ratios; ``rules`` is an array of ``target``, ``company``, ``product``, ``branches`` (``conditions``, ``value``) and ``fallback``.

    Of a rule's branches the first whose conditions all hold decides, else the fallback; a rule without a value leaves what earlier rules gave.
    """

    def apply(found: Column, r: Column) -> Column:
        hit = F.filter(r["branches"], lambda b: (F.size(b["conditions"]) > 0) & F.forall(b["conditions"], lambda c: holds(c, values)))
        value = F.when(F.size(hit) > 0, F.element_at(hit, 1)["value"]).otherwise(r["fallback"])
        return F.when(fits(r["company"], insurer) & fits(r["product"], product) & value.isNotNull(), put(found, r["target"], value)).otherwise(found)

    return F.aggregate(F.coalesce(rules, F.filter(rules, lambda r: F.lit(False))), F.create_map().cast("map<string,string>"), apply)


# formulas


def postfix(expr: str, names: list[str]) -> list[tuple[str, str]] | None:
    """A formula as a program (kind, text) for a stack, operators after their operands; None for anything that is no formula."""
    out: list[tuple[str, str]] = []
    waiting: list[str] = []
    depth, before = 0, None
    for t in tokens(expr, names) or []:
        operand = before is not None and (before.kind != "op" or before.text == ")")
        if t.kind != "op":
            if operand:
                return None
            out.append((t.kind, t.text))
        elif t.text == "(":
            if operand:
                return None
            waiting.append("(")
        elif t.text == ")":
            if not operand or "(" not in waiting:
                return None
            while (op := waiting.pop()) != "(":
                out.append(("op", op))
        elif operand:
            while waiting and waiting[-1] != "(" and PRIORITY[waiting[-1]] >= PRIORITY[t.text]:
                out.append(("op", waiting.pop()))
            waiting.append(t.text)
        elif t.text == "-":
            waiting.append("neg")
        elif t.text != "+":
            return None
        before = t
    if "(" in waiting or before is None or (before.kind == "op" and before.text != ")"):
        return None
    out += [("op", op) for op in reversed(waiting)]
    for kind, text in out:
        depth += 1 if kind != "op" else 0 if text == "neg" else -1
    return out if depth == 1 else None


def run_order(formulas: list[tuple[int, str, str]]) -> list[int]:
    """The order in which a tenant's formulas (number, target, expression) run, after those they use; circles run twice as they stand."""
    left, done = sorted(formulas), []
    while left:
        open_ = {t for _, t, _ in left}
        ready = [f for f in left if not any(t != f[1] and t in f[2] for t in open_)]
        if not ready:
            return done + [f[0] for f in left] * 2
        done += [f[0] for f in ready]
        left = [f for f in left if f not in ready]
    return done


PROGRAM = "array<struct<kind:string,text:string>>"


def formula_table(formulas: DataFrame, fields: list[str], tenant: str = "enterprise_id") -> DataFrame:
    """By tenant its formulas as programs in the order in which they run: ``formulas``.

    ``formulas`` has ``formula_no``, ``target``, ``company``, ``product`` and ``expr``.  A tenant's formulas are compiled in one task, tenants in many.
    """

    def compile_(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame.sort_values("formula_no").itertuples(index=False))
        names = [*fields, *[r.target for r in rows]]
        place = {r.formula_no: r for r in rows}
        order = run_order([(r.formula_no, r.target, r.expr or "") for r in rows])
        compiled = []
        for i, no in enumerate(order):
            r = place[no]
            program = postfix(r.expr or "", names)
            compiled.append((getattr(r, tenant), i, r.target, r.company or "", r.product or "", None if program is None else [{"kind": k, "text": t} for k, t in program]))
        return pd.DataFrame(compiled, columns=[tenant, "place", "target", "company", "product", "program"])

    kind = dict(formulas.dtypes)[tenant]
    each = formulas.select(tenant, "formula_no", "target", "company", "product", "expr").groupBy(tenant).applyInPandas(compile_, f"{tenant} {kind}, place int, target string, company string, product string, program {PROGRAM}")
    return each.groupBy(tenant).agg(F.array_sort(F.collect_list(F.struct("place", "target", "company", "product", "program"))).alias("formulas"))


def run_program(program: Column, values: Column) -> Column:
    """The value of a postfix program, floored to two decimals; null for no program and divisions by zero."""

    def step(stack: Column, t: Column) -> Column:
        top, under = F.element_at(stack, -1), F.try_element_at(stack, F.lit(-2))
        rest = lambda n: F.slice(stack, 1, F.size(stack) - n)
        number = F.when(t["kind"] == "number", t["text"].try_cast("double")).otherwise(formula_number(F.element_at(values, t["text"])))
        binary = F.when(t["text"] == "+", under + top).when(t["text"] == "-", under - top).when(t["text"] == "*", under * top).otherwise(F.when(top != 0, under / top))
        return F.when(t["kind"] != "op", F.concat(stack, F.array(number))).when(t["text"] == "neg", F.concat(rest(1), F.array(-top))).otherwise(F.concat(rest(2), F.array(binary)))

    value = F.aggregate(program, F.array().cast("array<double>"), step, lambda stack: F.element_at(stack, 1))
    return F.floor(value * 100) / 100


def formula_values(formulas: Column, values: Column, insurer: Column, product: Column) -> Column:
    """The record's texts after all formulas that fit it; a later formula reads what an earlier one wrote."""
    step = lambda now, f: F.when(fits(f["company"], insurer) & fits(f["product"], product), put(now, f["target"], formula_text(run_program(f["program"], now)))).otherwise(now)
    return F.aggregate(formulas, values, step)


def texts_of(fields: list[str]) -> Column:
    """A map of columns as texts."""
    return F.create_map(*[x for c in fields for x in (F.lit(c), F.col(c).cast("string"))])


def apply_formula_table(records: DataFrame, formulas: DataFrame, fields: list[str], tenant: str = "enterprise_id", insurer: str = "company_short", product: str = "policy_type") -> DataFrame:
    """Records with ``computed``, a map of their tenant's targets; ``formulas`` is the result of :func:`formula_table`.

    Where no formula of a target fits, the target has no entry unless the record has a field of that name.  Tenants without formulas get an empty map.
    """
    met = records.join(formulas, tenant, "left")
    targets = F.transform("formulas", lambda f: f["target"])
    after = formula_values(F.col("formulas"), texts_of(fields), F.col(insurer), F.col(product))
    kept = F.map_filter(after, lambda k, v: F.array_contains(targets, k))
    return met.withColumn("computed", F.when(F.col("formulas").isNotNull(), kept).otherwise(F.create_map().cast("map<string,string>"))).drop("formulas")


def apply_ratio_table(records: DataFrame, rules: DataFrame, fields: list[str], tenant: str = "enterprise_id", insurer: str = "company_short", product: str = "policy_type") -> DataFrame:
    """Records with ``ratios``, a map of targets; ``rules`` has ``rule_no`` and the columns that :func:`ratio_values` reads, a row for each rule."""
    own = rules.groupBy(tenant).agg(F.array_sort(F.collect_list(F.struct("rule_no", "target", "company", "product", "branches", "fallback"))).alias("__rules"))
    met = records.join(own, tenant, "left")
    return met.withColumn("ratios", F.coalesce(ratio_values(F.col("__rules"), texts_of(fields), F.col(insurer), F.col(product)), F.create_map().cast("map<string,string>"))).drop("__rules")
