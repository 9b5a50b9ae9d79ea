"""Column helpers: blanks, plates, dates, amounts, product classes.  All are built-in expressions but ``chinese_amount``."""

import decimal
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Traditional province characters of plates and their simplified forms.
PLATE_TRADITIONAL, PLATE_SIMPLIFIED = "粵蘇魯贛瓊貴雲遼寧陝晉滬閩", "粤苏鲁赣琼贵云辽宁陕晋沪闽"
# Province characters that may begin a plate.
PROVINCES = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤川青藏琼宁"
# Entries that stand for a missing plate.
PLATE_PLACEHOLDERS = ("新车", "暂未上牌", "*-*", "未上牌")


def text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def blank_to_null(c: Column, strip: bool = False) -> Column:
    """Null for the empty string; with ``strip`` also for white space, and the value is trimmed."""
    return F.nullif(F.trim(c) if strip else c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def normalize_plate(c: Column) -> Column:
    """Simplified province, without hyphens, dots and spaces, in upper case; null stays null."""
    return F.upper(F.regexp_replace(F.translate(c, PLATE_TRADITIONAL, PLATE_SIMPLIFIED), r"[-－\s　·.]", ""))


def plate_key(c: Column) -> Column:
    """A plate to match by: normalized, null for blanks and placeholders, so that those never form one huge key."""
    plate = normalize_plate(c)
    return F.when(~plate.isin("", "*", "**", *[p.replace("-", "") for p in PLATE_PLACEHOLDERS]), plate)


def vin_key(c: Column) -> Column:
    """A frame number to match by: upper case, null below ten characters."""
    vin = F.upper(F.trim(c))
    return F.when(F.length(vin) >= 10, vin)


def repair_plate_letters(c: Column) -> Column:
    """Behind the second character, O is read as 0 and I as 1."""
    return F.concat(F.substring(c, 1, 2), F.translate(F.substr(c, F.lit(3)), "OI", "01"))


def hyphen_plate(c: Column) -> Column:
    """A hyphen behind province and letter, where there is none."""
    fits = (F.length(c) >= 3) & ~F.contains(c, F.lit("-")) & F.rlike(c, F.lit(f"^[{PROVINCES}][A-Z]"))
    return F.when(fits, F.concat(F.substring(c, 1, 2), F.lit("-"), F.substr(c, F.lit(3)))).otherwise(c)


def parse_date(c: Column) -> Column:
    """The first date of the shapes Y-M-D, Y/M/D, Y年M月D日; impossible days are null."""
    part = [F.regexp_extract(c, r"(\d{4})\s*[-/年]\s*(\d{1,2})\s*[-/月]\s*(\d{1,2})", i) for i in (1, 2, 3)]
    return F.when(part[0] != "", F.try_to_date(F.concat_ws("-", *part), "yyyy-M-d"))


def parse_datetime(c: Column) -> Column:
    """A time stamp from seven shapes, the ones with a time first; null if none fits.

    Shapes: date and time with T or space, date glued to hours, Chinese date and time, then the
    dates Y-M-D, Y/M/D, Y年M月D日 and YYYYMMDD.
    """
    c = F.trim(c)

    def made(pattern: str, groups: int) -> Column:
        g = [F.regexp_extract(c, "^" + pattern, i) for i in range(1, groups + 1)]
        padded = [F.lpad(F.when(x == "", "0").otherwise(x), 2, "0") for x in g[1:]] + [F.lit("00")] * (6 - groups)
        stamp = F.concat(g[0], F.lit("-"), padded[0], F.lit("-"), padded[1], F.lit(" "), padded[2], F.lit(":"), padded[3], F.lit(":"), padded[4])
        return F.when(g[0] != "", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")))

    return F.coalesce(
        made(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", 6),
        made(r"(\d{4})[-/](\d{1,2})[-/](\d{2})(\d{2}):(\d{1,2})", 5),
        made(r"(\d{4})年(\d{1,2})月(\d{1,2})日?\s*(\d{1,2})[时:](\d{1,2})", 5),
        made(r"(\d{4})-(\d{1,2})-(\d{1,2})", 3),
        made(r"(\d{4})/(\d{1,2})/(\d{1,2})", 3),
        made(r"(\d{4})年(\d{1,2})月(\d{1,2})日?", 3),
        made(r"(\d{4})(\d{2})(\d{2})", 3),
    )


def format_date(c: Column, tokens: str, pad: bool = True) -> Column:
    """Dates in a pattern of YYYY, MM, DD, HH, mm; unreadable texts stay. Hours and minutes are always padded."""
    java = tokens.replace("YYYY", "yyyy").replace("MM", "MM" if pad else "M").replace("DD", "dd" if pad else "d")
    return F.coalesce(F.date_format(parse_datetime(c), java), c)


def formula_number(c: Column) -> Column:
    """Digits and dots of a text as a number; blank or unreadable is 0.  The minus sign is dropped."""
    return F.coalesce(F.regexp_replace(c, r"[^\d.]", "").try_cast("double"), F.lit(0.0))


def amount(c: Column) -> Column:
    """A signed amount; percent texts are divided by 100; null without a number."""
    number = F.regexp_replace(c, r"[^\d.\-]", "").try_cast("double")
    return F.when(F.endswith(F.trim(c), F.lit("%")), number / 100).otherwise(number)


def cents(c: Column) -> Column:
    """An amount as whole cents, so that sums do not depend on their order."""
    return F.round(amount(c) * 100).cast("long")


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


# Words of product names by class, in the order in which they decide.
CLASS_WORDS = [
    ("compulsory", ("交强",)),
    ("commercial", ("商业",)),
    ("accident", ("驾意",)),
    ("compulsory", ("交通事故责任强制", "交通事故强制保险")),
    ("commercial", ("机动车辆保险", "机动车辆综合险")),
    ("accident", ("家乘", "司乘")),
    ("accident", ("驾乘", "意外", "出行险", "出行无忧", "安心行", "E车无忧", "卓越全意保")),
    ("non_vehicle", ("账户", "资金安全", "信用卡", "盗用", "雇主", "承运人", "货运", "货物", "责任险", "家财")),
]
CLASS_LABELS = {"compulsory": "交强险", "commercial": "商业险", "accident": "非车险", "non_vehicle": "非车险"}
SORT_CLASSES = ("交强险", "商业险", "非车险")


def product_class(c: Column) -> Column:
    """T5: four-way class of a product name; blank and unknown names are ``accident``."""
    out = F.lit("accident")
    for name, words in reversed(CLASS_WORDS):
        out = F.when(contains_any(c, words), name).otherwise(out)
    return out


def sort_class(c: Column) -> Column:
    """Three-way class; blank and unknown names are 非车险."""
    return F.when(contains_any(c, ("交强", "交通事故责任强制", "交通事故强制保险")), SORT_CLASSES[0]).when(contains_any(c, ("商业", "机动车辆保险", "机动车辆综合险")), SORT_CLASSES[1]).otherwise(SORT_CLASSES[2])


def class_rank(c: Column, order: tuple[str, ...] = SORT_CLASSES) -> Column:
    """Place of the class in a configured order, from 0; classes that are not in it are last."""
    place = F.array_position(F.array(*map(F.lit, order)), sort_class(c)) - 1
    return F.when(place < 0, len(SORT_CLASSES)).otherwise(place).cast("int")


# Capital digits and units of amounts.
CN_DIGITS = {c: i for i, c in enumerate("零壹贰叁肆伍陆柒捌玖")} | {"〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "貳": 2, "參": 3, "陸": 6}
CN_UNITS = {"拾": 10, "十": 10, "佰": 100, "百": 100, "仟": 1000, "千": 1000}
CN_GROUPS = {"万": 10_000, "萬": 10_000, "亿": 100_000_000, "億": 100_000_000}


def _whole(part: str) -> int:
    whole = group = digit = 0
    for ch in part:
        if ch in CN_DIGITS:
            digit = CN_DIGITS[ch]
        elif ch in CN_UNITS:
            group += (digit or (1 if CN_UNITS[ch] == 10 and not group else 0)) * CN_UNITS[ch]
            digit = 0
        elif ch in CN_GROUPS:
            unit = CN_GROUPS[ch]
            whole = whole + (group + digit) * unit if unit < 10**8 else (whole + group + digit) * unit
            group = digit = 0
    return whole + group + digit


def _capitals(t: str | None) -> decimal.Decimal | None:
    m = _CAPITALS.search(t or "")
    if not m:
        return None
    small = {unit: CN_DIGITS[d] for d, unit in re.findall(r"(.)([角分])", m.group(2) or "") if d in CN_DIGITS}
    total = _whole(m.group(1)) * 100 + small.get("角", 0) * 10 + small.get("分", 0)
    return decimal.Decimal(total).scaleb(-2) if total else None


_CAPITALS = re.compile(r"([一-鿿]+)元(?:整|([一-鿿]*[分角整]))?")


def chinese_amount(c: Column) -> Column:
    """Amount in Chinese capitals as decimal(18,2); null where there is none or it is zero."""

    def amounts(texts: pd.Series) -> pd.Series:
        return texts.map(_capitals).astype("object")

    return F.pandas_udf(amounts, "decimal(18,2)")(c)
