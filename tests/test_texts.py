"""Splitting texts into policies, and a dictionary of many names: by hand and against plain Python."""

import random
import re

from pyspark.sql import functions as F

from ledgerspark.operators import text as t
from ledgerspark.plans.text import TITLES
from tests.conftest import SMALL

HEADS, CORE = ["机动车商业保险保险单", "商业保险保险单", "驾乘意外险保单"], ["车牌号", "被保险人", "保险起期"]
A = "车牌号 京A1 被保险人 甲"
FILL = "字" * 60

#: Ten texts, and the parts of each: start, text, pages.
TEXTS = [
    # two titles, the head of the page before the first one belongs to it
    (f"某公司\n机动车商业保险保险单\n{A}\n{FILL}\n甲方 驾乘意外险保单\n{A}2", [(0, f"某公司\n机动车商业保险保险单\n{A}\n{FILL}", ""), (91, f"甲方 驾乘意外险保单\n{A}2", "")]),
    # a title inside another counts once; one title is no split
    (f"机动车商业保险保险单 {A}", [(0, f"机动车商业保险保险单 {A}", "")]),
    # the title of a list of clauses begins no policy
    (f"机动车商业保险保险单\n{A}\n{FILL}\n驾乘意外险保单\n保险条款名称清单\n{A}", [(0, f"机动车商业保险保险单\n{A}\n{FILL}\n驾乘意外险保单\n保险条款名称清单\n{A}", "")]),
    # a part without fields goes, a single good part stays as it is
    (f"机动车商业保险保险单\n封面\n{FILL}\n驾乘意外险保单\n{A}", [(75, f"驾乘意外险保单\n{A}", "")]),
    # no good part at all: the whole text
    (f"机动车商业保险保险单\n封面\n{FILL}\n驾乘意外险保单\n封底", [(0, f"机动车商业保险保险单\n封面\n{FILL}\n驾乘意外险保单\n封底", "")]),
    # two numbers without titles; a repeated and a shortened number are none
    (f"保单号：P1234567890 {A}\n{'字' * 210}\n保单号：P123456789012 重复\n保险单号码 Q1234567890 {A}", [(0, f"保单号：P1234567890 {A}\n{'字' * 210}\n保单号：P123456789012 重复", ""), (263, f"保险单号码 Q1234567890 {A}", "")]),
    # the number of the compulsory policy and numbers of parts are quoted only
    (f"保单号：P1234567890 {A}\n交强险保单号：Q1234567890 {A}\n意外险 分项保单号：R1234567890 {A}", [(0, f"保单号：P1234567890 {A}\n交强险保单号：Q1234567890 {A}\n意外险 分项保单号：R1234567890 {A}", "")]),
    # pages of each part; marks are taken out
    (f"[PAGE:1]\n机动车商业保险保险单\n{A}\n[PAGE:2]\n{FILL}\n[PAGE:3]\n驾乘意外险保单\n{A}", [(0, f"机动车商业保险保险单\n{A}\n{FILL}\n", "1-3"), (114, f"驾乘意外险保单\n{A}", "")]),
    # without line breaks each part but the first begins with the text
    (f"机动车商业保险保险单 {A} {FILL} 驾乘意外险保单 {A}2", [(0, f"机动车商业保险保险单 {A} {FILL}", ""), (0, f"机动车商业保险保险单 {A} {FILL} 驾乘意外险保单 {A}2", "")]),
    ("", [(0, "", "")]),
]


def test_ten_texts(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(TEXTS)] + [(99, None)], "doc_id long, text string")
    got = {}
    for r in t.split_policies(df, HEADS, CORE).orderBy("doc_id", "part").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["text"], r["page_range"]))
    for i, (_, want) in enumerate(TEXTS):
        assert got[i] == want, i
    assert 99 not in got


def by_hand(text, titles, core, number):
    """Parts of a text, step by step."""
    found = []
    for title in titles:
        for m in re.finditer(title, text):
            if all(abs(m.start() - p) >= 50 for p in found):
                found.append(m.start())
    begins = list(found)
    if len(found) < 2:
        seen, more = [], []
        for m in re.finditer(number, text):
            if not any(m[1].startswith(x) or x.startswith(m[1]) for x in seen):
                seen.append(m[1])
                more += [m.start()] if all(abs(m.start() - p) >= 200 for p in found) else []
        begins = found + more if len(found) + len(more) > 1 else found
    begins, out = sorted(begins), []
    for i, p in enumerate(begins if len(begins) > 1 else []):
        start = text.rfind("\n", 0, p) + 1 if i else 0
        end = len(text)
        if i + 1 < len(begins):
            end = text.rfind("\n", 0, begins[i + 1]) + 1 or begins[i + 1]
        part = text[start:end].strip()
        if part and sum(bool(re.search(c, part)) for c in core) >= 2:
            out.append((start, part))
    return out or [(0, text)]


def test_documents_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").dropDuplicates(["doc_id"]).cache()
    titles, core, number = [r"\bthe [a-z]", r"de la", *TITLES], [r"the", r"and", r"of"], r"(?:of|and) ([a-z]{6,9})"
    got = {}
    for r in t.split_policies(docs, titles, core, number=number).orderBy("doc_id", "part").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["text"]))
    want = {r["doc_id"]: by_hand(r["text"], titles, core, number) for r in docs.collect()}
    assert got == want and sum(len(p) > 1 for p in want.values()) > 20


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "Python" not in t.split_policies(df, HEADS, CORE)._jdf.queryExecution().executedPlan().toString()


def test_dictionary_of_ten_thousand_names(spark):
    """The first entry in order whose words a text holds; names begin alike, some are one character, some need several words."""
    random.seed(4)
    ab = "中国人保险平安财产股份有限公司甲乙丙丁戊己"
    names = [(i, ["中国" + "".join(random.choice(ab) for _ in range(random.randrange(1, 6)))], f"s{i}") for i in range(10_000)]
    names += [(10_001, ["龙"], "one"), (10_002, ["平安甲", "众安"], "joint"), (-1, ["人保乙", "丙"], "first"), (10_003, [""], "blank"), (10_004, [], "none"), (10_005, None, "null")]
    texts = [(i, "".join(random.choice(ab + "xyz") for _ in range(random.randrange(0, 40)))) for i in range(400)] + [(900, "龙"), (901, "平安甲 众安"), (902, "平安甲"), (903, None), (904, ""), (905, "人保乙x丙"), (906, names[77][1][0] + names[5][1][0])]
    df, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(names, "order_no int, words array<string>, short string")
    got = {r["doc_id"]: r["company"] for r in t.identify_companies(df, table).collect()}
    for i, text in texts:
        fits = [(o, s) for o, w, s in names if w and all(w) and text and all(x in text for x in w)]
        assert got[i] == (min(fits)[1] if fits else None), (i, text)
    sizes = [len(t.identify_companies(df, x)._jdf.queryExecution().analyzed().toString()) for x in (table, table.where(F.col("order_no") < 10))]
    assert abs(sizes[0] - sizes[1]) < 400


def test_parties(spark):
    from ledgerspark.plans.text import PARTY_CASES

    more = [(None, ""), ("", ""), ("王", ""), ("证件", ""), ("王五 证件类型：身份证", "王五"), ("上海车行驶证", ""), ("红星五金行", "红星五金行"), ("某" * 29 + "公司", ""), ("甲方", ""), ("John", "")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PARTY_CASES + more)], "i int, name string")
    clean = t.clean_party(F.col("name"))
    got = {r["i"]: r["n"] or "" for r in df.select("i", F.when(t.is_party(clean), clean).alias("n")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PARTY_CASES + more)}


def test_dictionary_as_long_as_its_texts(spark):
    """Words of prose, where every pair of letters is common: few entries meet a text, in tasks and in joins behind them; the longest texts are cut in parts."""
    from ledgerspark.operators import dictionary

    random.seed(6)
    prose = ["".join(random.choice(["the ", "ion ", "er", "an", "st", "re"]) for _ in range(random.choice([3, 30, 300]))) for _ in range(600)]
    prose += ["".join(random.choice(["x", "er", "an"]) for _ in range(dictionary.PART)), "", None, *prose[:40]]
    names = [(i, [x[20:34]], f"n{i}") for i, x in enumerate(prose) if x and len(x) > 40]
    names += [(i, [x[-5:], x[3:9]], f"j{i}") for i, x in enumerate(prose, 1000) if x]
    names += [(5000, [prose[600][dictionary.PART - 20 : dictionary.PART + 20]], "seam"), (-2, [prose[1][:1200] + "!" * 1200], "long"), (5001, ["é" * 9], "nowhere")]
    random.shuffle(names)
    texts = [*enumerate(prose), (7000, "an x " + prose[600][dictionary.PART - 25 : dictionary.PART + 25]), (7001, prose[1][:1200] + "!" * 1201)]
    df, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(names, "order_no int, words array<string>, short string")
    fits = [[(o, s) for o, w, s in names if text and all(x in text for x in w)] for _, text in texts]
    want = {i: min(f)[1] if f else None for (i, _), f in zip(texts, fits)}
    assert "long" in want.values() and len(set(want.values())) > 100
    for held in (100, 100_000):
        assert {r["doc_id"]: r["company"] for r in dictionary.identify_companies(df, table, held=held).collect()} == want
    later = table.where("order_no > 0")
    want = {i: min([x for x in f if x[0] > 0], default=(0, None))[1] for (i, _), f in zip(texts, fits)}
    for held in (1, 100, 100_000):
        assert {r["doc_id"]: r["company"] for r in dictionary.identify_companies(df, later, held=held).collect()} == want
    assert {r["company"] for r in dictionary.identify_companies(df, table.where("order_no > 9000")).collect()} == {None}


def test_windows_that_meet_a_dictionary_are_few(spark):
    """A window of an entry is in hardly more texts than the entry is."""
    from ledgerspark.operators import dictionary

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    names = [(d["doc_id"], [d["text"][39:53]], str(d["doc_id"])) for d in docs if len(d["text"]) > 60]
    index, lengths = dictionary.company_index(spark.createDataFrame(names, "order_no long, words array<string>, short string"))
    known = {r["hash"] for r in index.collect()}
    met = sum(len({h for _, _, hashes in dictionary.windows([d["text"]], lengths, lambda h: [True] * len(h)) for h in hashes.view("int64").tolist()} & known) for d in docs)
    true = sum(len({w for _, (w,), _ in names if w in d["text"]}) for d in docs)
    assert lengths == [14] and met == true
