"""Texts of policies to fields (T1 to T24).  Rules are arguments; fixed word lists are those of the domain."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.columns import PLATE_SIMPLIFIED, PLATE_TRADITIONAL, blank_to_null, contains_any, parse_date
from ledgerspark.operators.analytics import n
from ledgerspark.operators.dictionary import identify_companies  # noqa: F401


def clean_digits(c: Column) -> Column:
    """Without spaces between digits (three times, for longer runs) and beside the units of dates."""
    for _ in range(3):
        c = F.regexp_replace(c, r"(\d)\s+(\d)", "$1$2")
    return F.regexp_replace(F.regexp_replace(c, r"(\d)\s+([年月日时分秒])", "$1$2"), r"([年月日])\s+(\d)", "$1$2")


def _doubled(token: str) -> bool:
    half = token[::2]
    return len(token) >= 4 and half == token[1::2] and len(set(half)) > 1


def undouble(c: Column) -> Column:
    """Tokens in which every character stands twice, with each once; a null text stays null."""
    token = re.compile(r"\S{4,}")

    def halve(m: re.Match) -> str:
        return m.group(0)[::2] if _doubled(m.group(0)) else m.group(0)

    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else token.sub(halve, t)).astype("object")

    return F.pandas_udf(repair, "string")(c)


def identify_company(c: Column, full_names: list[tuple[str, str]], keywords: list[tuple[str, str]], joint: list[tuple[tuple[str, ...], str]] = ()) -> Column:
    """Short name by the first full name in order, else the first keyword; names of joint cover, by several words, go first."""
    out = F.lit(None).cast("string")
    for word, short in reversed([*full_names, *keywords]):
        out = F.when(F.contains(c, F.lit(word)), short).otherwise(out)
    for words, short in joint:
        every = F.lit(True)
        for w in words:
            every = every & F.contains(c, F.lit(w))
        out = F.when(every, short).otherwise(out)
    return out


def first_match(c: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern with a value that is not blank."""
    return F.coalesce(*[blank_to_null(F.trim(F.regexp_extract(c, p, 1))) for p in patterns]) if patterns else F.lit(None).cast("string")


def product_name(c: Column, titles: list[str], labelled: list[str]) -> Column:
    """T4: a product's name from the first 1000 characters by title patterns, then behind labels in the whole text."""
    return F.coalesce(first_match(F.substring(c, 1, 1000), titles), first_match(c, labelled))


def extract_fields(texts: DataFrame, rules: dict[str, list[str]], by_company: dict[str, dict[str, list[str]]] | None = None, column: str = "text", company: str = "company_short") -> DataFrame:
    """A column for each field, by ordered patterns; the insurer's own patterns go before the common ones."""
    t, out = F.col(column), {}
    for name, patterns in rules.items():
        value = first_match(t, patterns)
        for short, own in (by_company or {}).items():
            if own.get(name):
                value = F.when(F.col(company) == short, F.coalesce(first_match(t, own[name]), value)).otherwise(value)
        out[name] = value
    return texts.withColumns(out)


# Words that mark policies in the first 500 characters.
STRONG_MARKS = ("保险单号", "保单号", "号牌号码", "电子保单", "投保确认")
# Phrases and patterns by which kinds of documents are told apart.
INSURED, PROPOSER, DECLARATION = "被保险人", "投保人", "投保人声明"
INSURED_IN_CLAUSES = "被保险人(?:义务|的权利|应当|须)"
STICKER, STICKER_SEAL, STICKER_CHECK, PREMIUM = ("此标志粘贴在机动车前窗", "此标志正面的年份", "强制保险标志"), "保险人签章", "单证查验", "保险费"
POLICY_TERMS = "被保险人|保险费|投保人|保险金额|承保险种|责任限额"
INVOICE, PAYMENT, EXEMPTIONS, MANDATE, NOTICE = ("电子发票", "发票号码"), "缴款通知书", "免责事项说明书", "授权委托书", "告知单"
CLAUSES, CLAUSE_HEADS = "保险示范条款", ("总则", "第一条")
CLAUSE_PATTERNS = (r"示范条款[（(]\d{4}版[)）]", r"保险条款[（(](?:\d{4}版|条款编码)")
ENDORSEMENT = r"电子批单|保险批单|批\s*单\s*号|批改日期|批改确认码"
PROPOSAL = r"投保[单书](?!号)"
NO_PROPOSAL = ("保险条款[、，]投保单", r"投保单\s*是本保险[单合]", "(?:由|包括)投保单")
BROKEN_FONT = "(cid:"


def document_category(c: Column, premium: Column | None = None, start: Column | None = None) -> Column:
    """Kind of a document by its length and its first 500 characters; the first rule that fits decides."""
    text = F.coalesce(c, F.lit(""))
    head = F.substring(text, 1, 500)
    has = lambda *w: contains_any(head, w)
    anywhere = lambda *w: contains_any(text, w)
    like = lambda p, col=head: F.rlike(col, F.lit(p))
    strong = has(*STRONG_MARKS)
    marked = strong | (has(INSURED) & ~like(INSURED_IN_CLAUSES)) | (has(PROPOSER) & ~has(DECLARATION))
    short = F.length(text) < 500
    sticker = anywhere(*STICKER) & (~like(POLICY_TERMS, text) | ~marked)
    clauses = ~marked & (has(CLAUSES) | like(CLAUSE_PATTERNS[0]) | like(CLAUSE_PATTERNS[1]) | (has(CLAUSE_HEADS[0]) & has(CLAUSE_HEADS[1])))
    proposal = like(PROPOSAL) & ~strong & ~like(NO_PROPOSAL[0]) & ~like(NO_PROPOSAL[1]) & ~like(NO_PROPOSAL[2]) & marked
    paid = F.lit(False) if premium is None or start is None else blank_to_null(premium).isNotNull() & blank_to_null(start).isNotNull()
    return (
        F.when(F.contains(F.substring(F.lower(text), 1, 200), F.lit(BROKEN_FONT)), "其他")
        .when(short & anywhere(STICKER_SEAL), "电子标志")
        .when(sticker, "电子标志")
        .when(short & anywhere(STICKER_CHECK) & ~anywhere(INSURED) & ~anywhere(PREMIUM), "电子标志")
        .when(has(*INVOICE), "发票")
        .when(has(PAYMENT), "缴款通知")
        .when(has(EXEMPTIONS) | (has(DECLARATION) & ~strong), "条款")
        .when(has(MANDATE), "其他")
        .when(has(NOTICE) & ~strong, "告知单")
        .when(clauses, "条款")
        .when(like(ENDORSEMENT), "批单")
        .when(proposal, F.when(paid, "保单").otherwise("投保单"))
        .when(marked, "保单")
        .otherwise("未知")
    )


def places(text: Column, pattern: str) -> Column:
    """Hits of a pattern in a text: an array of ``at`` (from 0) and ``hit``, from the lengths of what stands between them."""
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    none = F.array().cast("array<struct<at:int,hit:string>>")
    start = F.struct(F.lit(0).alias("end"), none.alias("found"))

    def add(acc: Column, p: Column) -> Column:
        at = acc["end"] + F.length(p["b"])
        return F.struct((at + F.length(p["h"])).alias("end"), F.concat(acc["found"], F.array(F.struct(at.alias("at"), p["h"].alias("hit")))).alias("found"))

    pairs = F.zip_with(hits, F.slice(between, F.lit(1), F.size(hits)), lambda h, b: F.struct(h.alias("h"), b.alias("b")))
    return F.aggregate(pairs, start, add, lambda acc: acc["found"])


#: What follows a title that only heads a list of clauses; words before the number of another policy, and of a part of this one.
CLAUSE_LIST, OTHERS_NUMBER, PARTS_NUMBER = r"^\s*保险条款名称", "交强险", r"分项\s*$"
PAGE_MARK = r"\[PAGE:\d+\]\n?"


def boundaries(text: Column, titles: list[str], number: str) -> tuple[Column, Column]:
    """Two arrays of places where policies begin: hits of titles in their order, 50 characters apart, but not those of clause lists.

    The second array holds numbers of which none begins another, 200 characters from titles (column ``__titles``); they count where there are fewer than two titles.
    """
    far = lambda at, taken, least: F.forall(taken, lambda p: F.abs(p - at) >= least)
    taken = F.array().cast("array<int>")
    for title in titles:
        listed = lambda h: F.rlike(F.substr(text, h["at"] + F.length(h["hit"]) + 1, F.lit(80)), F.lit(CLAUSE_LIST))
        taken = F.aggregate(places(text, title), taken, lambda acc, h: F.when(far(h["at"], acc, 50) & ~listed(h), F.concat(acc, F.array(h["at"]))).otherwise(acc))
    value = lambda h: F.regexp_extract(h["hit"], number, 1)
    before = lambda h: F.substr(text, F.greatest(h["at"] - 19, F.lit(1)), F.least(h["at"], F.lit(20)))
    own = F.filter(places(text, number), lambda h: ~F.contains(before(h), F.lit(OTHERS_NUMBER)) & ~F.rlike(before(h), F.lit(PARTS_NUMBER)))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("more"))

    def add(acc: Column, h: Column) -> Column:
        known = F.exists(acc["seen"], lambda s: F.startswith(value(h), s) | F.startswith(s, value(h)))
        more = F.when(known | ~far(h["at"], F.col("__titles"), 200), acc["more"]).otherwise(F.concat(acc["more"], F.array(h["at"])))
        return F.struct(F.when(known, acc["seen"]).otherwise(F.concat(acc["seen"], F.array(value(h)))).alias("seen"), more.alias("more"))

    return taken, F.aggregate(own, start, add, lambda acc: acc["more"])


def split_policies(texts: DataFrame, titles: list[str], core: list[str], least: int = 2, number: str = r"保[险]?单号码?[：:\s]*([A-Za-z0-9]{10,30})") -> DataFrame:
    """A row for each policy in a text: ``doc_id``, ``part`` (from 0), ``start``, ``text`` and ``page_range``.

    A part begins with the line of a boundary, the first one with the text, and ends before the line of the next (without a line
    break before that, at the boundary).  Parts with fewer than ``least`` matches of ``core`` are left out; if none is left, or there are fewer than two boundaries,
    the text stays whole.  Page marks are taken out.  Null texts have no part.
    """
    text = F.col("text")
    taken, more = boundaries(text, titles, number)
    # Boundaries are columns of their own, so that they are made once.
    rows = texts.where(text.isNotNull()).select("doc_id", "text", taken.alias("__titles"))
    rows = rows.withColumn("__more", F.when(F.size("__titles") <= 1, more).otherwise(F.array().cast("array<int>")))
    at = F.array_sort(F.when(F.size("__titles") + F.size("__more") > 1, F.concat("__titles", "__more")).otherwise(F.col("__titles")))
    rows = rows.withColumn("__at", at)
    line = lambda p: p - F.length(F.substring_index(F.substr(text, F.lit(1), p), "\n", -1))
    broken = lambda p: F.contains(F.substr(text, F.lit(1), p), F.lit("\n"))

    def part(p: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(line(p))
        follower = F.get(F.col("__at"), i + 1)
        end = F.when(follower.isNull(), F.length(text)).when(broken(follower), line(follower)).otherwise(follower)
        return F.struct(start.alias("start"), F.trim(F.substr(text, start + 1, end - start), F.lit(" \n\r\t\f\x0b　")).alias("text"))

    hits = lambda t: sum((F.rlike(t, F.lit(p)).cast("int") for p in core), F.lit(0))
    good = F.filter(F.transform("__at", part), lambda x: (x["text"] != "") & (hits(x["text"]) >= least))
    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("text")))
    parts = F.when((F.size("__at") > 1) & (F.size(good) > 0), good).otherwise(whole)
    each = rows.select("doc_id", F.posexplode(parts).alias("part", "__p"))
    return each.select("doc_id", "part", F.col("__p.start").alias("start"), F.regexp_replace("__p.text", PAGE_MARK, "").alias("text"), page_range(F.col("__p.text")).alias("page_range"))


def cover_lines(texts: DataFrame, words: list[str], column: str = "text") -> DataFrame:
    """Lines with a cover word and an amount: line number, cover, the last amount and the limit, if one is named."""
    each = texts.select("doc_id", F.posexplode(F.split(F.col(column), "\n")).alias("line_no", "line"))
    amounts = F.regexp_extract_all("line", F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    cover = F.lit(None).cast("string")
    for w in reversed(words):
        cover = F.when(F.contains("line", F.lit(w)), w).otherwise(cover)
    limit = blank_to_null(F.regexp_extract("line", r"(?:限额|保额|limit)[：:\s]*(\d[\d,]*(?:\.\d+)?)", 1))
    return each.withColumn("cover", cover).where(F.col("cover").isNotNull() & (F.size(amounts) > 0)).select("doc_id", "line_no", "cover", F.replace(F.element_at(amounts, -1), F.lit(","), F.lit("")).alias("amount"), limit.alias("limit"))


def page_range(c: Column) -> Column:
    """Pages named by markers: one number, first-last if there is no gap, else a list; empty without any."""
    pages = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[PAGE:(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))
    first, last = F.element_at(pages, 1), F.element_at(pages, -1)
    text = F.transform(pages, lambda x: x.cast("string"))
    return F.when(F.size(pages) == 0, "").when(F.size(pages) == 1, F.get(text, F.lit(0))).when(last - first == F.size(pages) - 1, F.concat_ws("-", first.cast("string"), last.cast("string"))).otherwise(F.array_join(text, ","))


def confidence(fields: list[str]) -> Column:
    """Share of the fields that are filled."""
    hits = sum((blank_to_null(F.col(c)).isNotNull().cast("int") for c in fields), F.lit(0))
    return hits / len(fields)


def energy_class(plate: Column) -> Column:
    """Plates of eight characters are those of new energy cars."""
    return F.when(F.length(plate) == 8, "新能源").when(F.length(plate) == 7, "燃油").otherwise("")


def person_name(c: Column) -> Column:
    """A name without labels and titles behind it; null if it cannot be one."""
    clean = F.trim(F.regexp_replace(c, r"(?:\s|先生|女士|小姐|证件.*|联系.*|电话.*|地址.*|身份证.*)+$", ""))
    good = F.rlike(clean, F.lit(r"^(?:[一-鿿·]{2,20}|[A-Za-z][A-Za-z .#0-9]{1,39}|[一-鿿（）()A-Za-z]{2,40}(?:公司|企业|厂|店|中心|合作社|学校|医院))$"))
    bad = F.rlike(clean, F.lit(r"被保险人|投保人|保险|日期|号码|证件|地址|电话"))
    return F.when(good & ~bad, clean)


# Entries that are labels and no names.
NO_NAMES = (
    "地址", "手机号", "信息", "名称", "保单验真码", "行驶证车主", "行驶证", "为", "身份证", "证件", "姓名", "证件类型", "证件号码", "申请", "投保申请", "个人信息", "手机号码", "联系人", "联系住址", "通讯地址", "电子邮箱",
    "法定", "法定受益人", "受益人", "主被保人", "特定", "出生日期", "手机电话", "联系电话", "机关", "声明", "社会统一信用", "统一社会信用代码", "须如实告知", "公司", "尊敬的客户", "车主",
)
# Words and endings of names of organisations.
ORGANISATION_WORDS = (
    "公司", "集团", "合伙", "工厂", "商行", "服务行", "修理行", "维修行", "经营行", "贸易行", "百货行", "批发行", "批发部", "五金行", "建材行", "机电行", "文具行", "商贸", "车行(?!驶)", "车队", "事务所", "经营部", "经营店", "经销商", "专营店", "服务部",
    "加工厂", "养殖场", "合作社", "回收站", "收购站", "废品站", "加油站", "加气站", "充电站", "换电站", "维修站", "服务站", "研究院", "研究所", "设计院", "分院", "医院", "卫生院", "学院", "小学", "中学", "大学", "幼儿园", "学校",
    "村民委员会", "居民委员会", "村委会", "居委会", "管理处", "中心", "个体工商户", "协会", "商会", "学会", "联合会", "促进会", "基金会",
)
ORGANISATION_ENDS = ("店", "厂", "铺")
# Words of sentences that name organisations, and that no person's name has.
SENTENCE_WORDS = ("提出", "提供", "负责", "承担", "向.*公司", "本公司.*的", "申请", "告知", "声明", "附加.*险", "附加.*费", "损失费", "保险费", "约定", "载明", "查询", "异议", "渠道", "联系", "客服", "拨打", "核对", "办理", "满意", "反映", "投诉", "若", "请", "通过")
NO_PERSON_WORDS = (
    "保险", "保单", "保费", "条款", "申请", "投保", "理赔", "赔偿", "责任", "免责", "免赔", "绑单", "验真", "承保", "退保", "批改", "核保", "出险", "报案", "死亡", "伤害", "伤残", "遭受", "宣告", "期间", "约定", "告知", "声明", "同意", "签署",
    "解除", "终止", "变更", "转让", "撤销", "无效", "违约", "纠纷", "诉讼", "仲裁", "民事", "刑事", "行为", "能力", "限制", "法定", "监护", "主险", "附加", "合同", "条件", "生效", "届满", "届时", "交通", "机动车", "车辆", "证件", "身份证", "手机", "电话",
    "姓名", "号码", "地址", "发动机", "车架号", "车牌", "行驶证", "户籍", "证明", "或者", "信息", "个人信", "序号", "编号", "日期", "时间", "金额", "费用", "合计", "总计", "本公司", "该公司", "受益人", "被保人", "投保人", "提出", "提供", "负责", "承担", "享有",
    "具有", "应当", "可以", "不得", "下列", "上述", "以下", "以上", "其中", "根据", "按照", "依据", "本人", "雇佣", "义务", "权利", "鉴于", "甲方", "乙方", "丙方", "若干", "总则", "细则", "附则", "前述", "兹有", "特此", "协商确定", "另行约定", "双方约定", "待定", "不详", "官微", "官网",
)
PLACE_IN_NAME = r"[一-鿿][（(][一-鿿]{2,4}[）)][一-鿿]"
PERSON_SHAPES = (r"^[一-鿿]{2,6}$", r"^[一-鿿]{1,4}[·・][一-鿿]{1,6}$")
CLAUSE_NUMBER = r"^第[\d一二三四五六七八九十百千零两]+[条章款项节]$"
# What follows a name and is no part of it.
NAME_TAILS = (r"车主.*", r"名称.*", r"证件.*", r"有敬异的.*", r"果尊.*", r"(?:执业|资格|从业|代理|经纪)(?:证|号|资格).*")
COMPANY_TAIL = r"((?:股份有限|有限责任|有限)公司)(?:附加|免责|条款|保险费|损失费|出行).*"
KEPT_BRACKETS = r"[（(](?:个体工商户|个人独资|普通合伙|有限合伙|合伙企业)[）)]"


def is_party(c: Column, deny: tuple[str, ...] = NO_NAMES, organisations: tuple[str, ...] = ORGANISATION_WORDS, no_person: tuple[str, ...] = NO_PERSON_WORDS, longest: int = 30) -> Column:
    """Whether a value is a name of an organisation or a person; word lists are patterns, and arguments.

    Organisations have a word or ending of their kind, or a place in brackets, and are no sentence; persons have two to six characters, or a dot
    between two parts, and no word of documents.  Null is none.
    """
    v = F.trim(c)
    like = lambda words: F.rlike(v, F.lit("|".join(words)))
    ends = F.rlike(F.regexp_replace(v, r"[（(][^）)]*[）)]$", ""), F.lit(f"(?:{'|'.join(ORGANISATION_ENDS)})$"))
    organisation = like(organisations) | ends | F.rlike(v, F.lit(PLACE_IN_NAME))
    firm = ~like(SENTENCE_WORDS) & ~F.rlike(v, F.lit("[，,。.；;！!？?、]")) & (F.length(v) <= longest)
    person = ~F.rlike(v, F.lit(CLAUSE_NUMBER)) & like(PERSON_SHAPES) & ~like(no_person)
    return F.coalesce((F.length(c) >= 2) & ~v.isin(*deny) & F.when(organisation, firm).otherwise(person), F.lit(False))


def clean_party(c: Column) -> Column:
    """A name without blanks between characters, remarks behind it, and brackets that are no part of it."""
    v = F.trim(c)
    for _ in range(2):
        v = F.regexp_replace(v, r"([一-鿿])\s+([一-鿿])", "$1$2")
    whole = F.rlike(v, F.lit(r"[（(][^）)]*[）)][一-鿿]")) | F.rlike(v, F.lit(KEPT_BRACKETS))
    v = F.when(whole, F.regexp_replace(v, "[：:].*", "")).otherwise(F.regexp_replace(v, "[：:（(].*", ""))
    for tail in NAME_TAILS[:3]:
        v = F.regexp_replace(v, tail, "")
    v = F.regexp_replace(v, COMPANY_TAIL, "$1")
    for tail in NAME_TAILS[3:]:
        v = F.regexp_replace(v, tail, "")
    return F.trim(v)


def city(address: Column) -> Column:
    """The city of an address without province; some cities are named without the word for city."""
    rest = F.regexp_replace(address, r"^.*?(?:省|自治区)\s*", "")
    found = F.regexp_extract(rest, r"^(.+?)市", 1)
    out = F.lit("")
    for name in ("儋州", "嘉峪关", "中山", "东莞"):
        out = F.when(F.contains(address, F.lit(name)), name).otherwise(out)
    return F.when(found != "", found).otherwise(F.coalesce(out, F.lit("")))


def insurer_with_city(company: Column, address: Column) -> Column:
    """City and insurer; null without an insurer."""
    return F.when(blank_to_null(company).isNotNull(), F.concat(F.coalesce(city(address), F.lit("")), company))


# Words of clause pages, and patterns of policy headers.
CLAUSE_WORDS = ("总则", "第一条", "第二条", "责任免除", "保险责任", "释义", "理赔申请", "争议处理", "保险金申请", "条款", "注册号")
POLICY_HEADER = r"交通事故责任强制保险|(?:商业保险|综合险).*?(?:保险单|保\s*单)|(?:驾乘|意外伤害).*?(?:保险单|保\s*单)|保[险]?单号[：:\s]*[A-Za-z0-9]{10,}"


def is_clause_page(c: Column, words: tuple[str, ...] = CLAUSE_WORDS, header: str = POLICY_HEADER, least: int = 3) -> Column:
    """Fifty characters or more, no policy header, and at least three of the words."""
    hits = sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.coalesce((F.length(c) >= 50) & ~F.rlike(c, F.lit(header)) & (hits >= least), F.lit(False))


def map_fields(fields: Column, mapping: dict[str, list[str]], override: dict[str, list[str]] | None = None) -> Column:
    """A map under output names: of each name's sources the first non-blank; the override's sources go first.

    Keys that no name has for a source pass through, except those that begin with an underscore.
    """
    both = {k: [*(override or {}).get(k, []), *v] for k, v in mapping.items()} | {k: v for k, v in (override or {}).items() if k not in mapping}
    used = sorted({s for v in both.values() for s in v} | set(both))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(*[blank_to_null(F.element_at(fields, F.lit(s))) for s in v]).alias("value")) for k, v in both.items()])
    named = F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))
    rest = F.map_filter(fields, lambda k, v: ~k.isin(used) & ~F.startswith(k, F.lit("_")))
    return F.map_concat(named, rest)


def flatten(records: DataFrame, names: dict[str, str], column: str = "fields", dates: tuple[str, ...] = ("sign_date", "start_date", "end_date"), plate: str = "plate_no") -> DataFrame:
    """A column of at most 500 characters for each key of a map, plates with simplified province, and typed dates."""
    out = {c: F.substring(F.element_at(F.col(column), F.lit(k)), 1, 500) for k, c in names.items()}
    if plate in out:
        out[plate] = F.translate(out[plate], PLATE_TRADITIONAL, PLATE_SIMPLIFIED)
    typed = {f"{c}_iso": parse_date(out[c]) for c in dates if c in out}
    return records.withColumns(out | typed)


def coverage(records: DataFrame, fields: list[str], key: str) -> DataFrame:
    """By key and in all (null), how often each field is filled: ``field``, ``n``, ``filled``, ``percent``."""
    aggs = [n().alias("n"), F.grouping(key).alias("in_all"), *[n(blank_to_null(F.col(c)).isNotNull()).alias(c) for c in fields]]
    wide = records.rollup(key).agg(*aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in fields]))
    return wide.select(key, "in_all", "n", pairs.alias("x")).select(key, F.col("in_all").cast("int").alias("in_all"), "x.field", "n", "x.filled", F.round(F.col("x.filled") * 100.0 / F.col("n"), 2).alias("percent"))


def suspicious_ids(records: DataFrame, most_plates: int = 5, most_people: int = 5) -> DataFrame:
    """Id numbers that too many plates or people share; distinct pairs are made before they are counted."""
    rows = records.where("id_number != ''")
    return rows.groupBy("id_number").agg(F.count_distinct(blank_to_null(F.col("plate_no"))).alias("plates"), F.count_distinct(blank_to_null(F.col("insured"))).alias("people")).where((F.col("plates") > most_plates) | (F.col("people") > most_people))


def clear_suspicious(records: DataFrame, bad: DataFrame) -> DataFrame:
    """Those id numbers emptied."""
    marked = records.join(bad.select(F.col("id_number").alias("bad_id")), F.col("id_number") == F.col("bad_id"), "left")
    return marked.withColumn("id_number", F.when(F.col("bad_id").isNull(), F.col("id_number")).otherwise("")).drop("bad_id")


def same_party_id(records: DataFrame, applicant_id: str = "applicant_id", insured_id: str = "insured_id") -> DataFrame:
    """Where applicant and insured have one name (without spaces), both have the one id that is known."""
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s", "")
    same = (bare("applicant") != "") & (bare("applicant") == bare("insured"))
    a, b = blank_to_null(F.col(applicant_id)), blank_to_null(F.col(insured_id))
    return records.withColumns({applicant_id: F.when(same, F.coalesce(a, b)).otherwise(a), insured_id: F.when(same, F.coalesce(b, a)).otherwise(b)})


def new_insurers(records: DataFrame, seen: DataFrame) -> DataFrame:
    """Policies without a short name, by insurer's name or else nine characters of the number; keys never seen, with the first record."""
    key = F.coalesce(blank_to_null(F.col("company")), blank_to_null(F.substring("policy_no", 1, 9)))
    rows = records.where((F.coalesce("company_short", F.lit("")) == "") & (F.col("doc_category") == "保单")).withColumn("key", key).where("key is not null")
    return rows.groupBy("key").agg(F.min("id").alias("first_id"), n().alias("n")).join(seen.select("key"), "key", "left_anti")


def plate_fallback(records: DataFrame, tenants_with_vin: list[int]) -> DataFrame:
    """A blank plate from the file's name, else, for some tenants, the frame number of ten characters or more."""
    from_name = blank_to_null(F.regexp_extract("filename", r"([一-鿿][A-Z][A-Z0-9]{5,6})", 1))
    vin = F.when(F.col("enterprise_id").isin(tenants_with_vin) & (F.length("vin") >= 10), F.col("vin"))
    return records.withColumn("plate_no", F.coalesce(blank_to_null(F.col("plate_no")), from_name, vin, F.lit("")))
