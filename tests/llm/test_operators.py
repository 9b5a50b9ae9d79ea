"""Each operator on small frames: nulls, empty and repeated rows, ties, empty tables, and brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm import chat, common, embeddings, graph, html, license, minhash, mixing, pieces, quality, sharding, toxicity
from ledgerspark.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL, table

ODD = [(1, "One two three four five six seven eight nine ten eleven", "en", "a"), (1, "One two three four five six seven eight nine ten eleven", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "some text here", "en", "b"), (4, " \n\t ", "en", "c"), (5, "x " * 30_000, "en", "c"), (6, "ﬁn 中文 \x00 é", "fr", "c")]
SCHEMA = "doc_id long, text string, lang string, source string"


#: Names that the operators use for columns of their own.
CLASHING = "stats size key shard bands toxicity kept score slot h1 t1 r1 line vec leaf node component class_id order source_no unit n_turns position own1 raw copies links html text_crc32 law target taken rest fold grams features".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with odd rows in every table, with extra columns named like the operators' own; and one with empty tables."""
    odd, none = str(tmp_path_factory.mktemp("odd")), str(tmp_path_factory.mktemp("none"))
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, "<p>a<p>b"), (None, "", "")], "page_id long, url string, html string")
    turns = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, None, None), (None, None, None, None), (2, 1, None, None)], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, None, 1), (None, [1.0, 0.0], 1), (3, [], 1), (4, [0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    items = spark.createDataFrame([(1, "Some text"), (2, None), (None, "x ONE"), (1, "Some text"), (3, "")], "item_id long, text string")
    for name, df in {"documents": docs, "labels": labels, "pages": pages, "conversations": turns, "embeddings": vectors, "benchmark": items}.items():
        for c in CLASHING:
            df = df if c in df.columns else df.withColumn(c, F.lit(1))
        df.write.parquet(f"{odd}/{name}.parquet")
        df.limit(0).write.parquet(f"{none}/{name}.parquet")
    return odd, none


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(spark, folder, name):
    odd, none = folder
    rows = QUERIES[name](spark, odd).collect()
    assert QUERIES[name](spark, none).count() == 0
    expected = {"op2_chat_formatting": 2, "op3_html_extraction": 4, "op7_embedding_dedup": 7, "op10_license_scan": 0, "op11_spelling": 0, "op13_search": 5}
    assert len(rows) == expected.get(name, len(ODD))
    if name in ODD_RESULTS:
        assert sorted((tuple(r[c] for c in ODD_RESULTS[name][0]) for r in rows), key=repr) == sorted(ODD_RESULTS[name][1], key=repr)


#: What the odd tables give, by hand.
ODD_RESULTS = {
    "op1_quality": (["doc_id", "n_words", "base_failed"], [(1, 11, False), (1, 11, False), (2, 0, True), (3, 0, True), (None, 3, True), (4, 0, True), (5, 30_000, True), (6, 4, True)]),
    "op2_chat_formatting": (["conv_id", "n_turns", "chat"], [(2, 2, "<|user|>\na\n<|unknown|>\n"), (None, 1, "<|unknown|>\n")]),
    "op3_html_extraction": (["page_id", "text", "n_chars"], [(1, "", 0), (1, "", 0), (2, "a\nb", 3), (None, "", 0)]),
    "op4_mixing": (["doc_id", "size", "source_size"], [(1, 11, 22), (1, 11, 22), (2, 0, 0), (3, 0, 3), (None, 3, 3), (4, 0, 30_004), (5, 30_000, 30_004), (6, 4, 30_004)]),
    "op5_toxicity": (["doc_id", "held_out"], [(d, zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 0) for d, *_ in ODD]),
    "op7_embedding_dedup": (["vec_id", "n_links", "component_id", "kept"], [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True)]),
    "op8_sharding": (["doc_id", "size"], [(d, len((t or "").encode()) + 8) for d, t, *_ in ODD]),
    "op12_substrings": (["doc_id", "n_words", "n_removed"], [(1, 11, 0), (1, 11, 0), (2, 0, 0), (3, 0, 0), (None, 3, 0), (4, 0, 0), (5, 30_000, 30_000), (6, 4, 0)]),
    "op13_search": (["item_id", "rank", "doc_id"], [(1, 1, None), (1, 1, None), (None, 1, 5), (None, 2, 1), (None, 3, 1)]),
    "op9_minhash": (["doc_id", "class_id", "kept"], [(1, 1, True), (1, 1, True), (2, 2, True), (3, 2, False), (None, None, True), (4, 4, True), (5, 5, True), (6, 6, True)]),
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("benchmark", "conversations", "documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df, q = QUERIES[name](spark, SMALL), c.sql(ORACLE_SQL[name])
    assert table([tuple(r) for r in df.collect()], df.columns) == table(q.fetchall(), q.columns)


def test_chat_prefixes(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 5, "user", "a"), (2, 6, "bot", "b"), (2, 7, "user", "c"), (3, 0, "user", "a"), (4, 0, "user", "z"), (5, 0, "user", "z")]
    rows += [(n, i, "user", str(i)) for n, length in ((6, 200), (7, 150)) for i in range(length)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat.maximal(turns).collect()}
    assert got == {2: (3, 1), 4: (1, 2), 6: (200, 1)}


def test_sharding(spark):
    rows = QUERIES["op8_sharding"](spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    want = {d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in zip(docs["doc_id"], docs["text"])}
    assert {d: (s, c) for d, s, c in zip(rows["doc_id"], rows["size"], rows["text_crc32"])} == want
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard")["slot"]) and rows["shard"].between(0, 23).all()


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_sharding_law(spark, sf):
    """Sizes near equal: a boundary is off by no more than half of what straddles it (a text, or a group of equal texts) and the tolerance."""
    rows = QUERIES["op8_sharding"](spark, sf).toPandas()
    sizes, mean = rows.groupby("shard")["size"].sum(), rows["size"].sum() / 24
    groups = rows.groupby("text_crc32")["size"].sum()
    straddles = max(rows["size"].max(), groups[groups <= 0.05 * mean].max())
    assert len(sizes) == 24 and (abs(sizes - mean) <= straddles + 0.01 * mean).all()
    small = rows.groupby("text_crc32").filter(lambda g: g["size"].sum() <= 0.04 * mean)
    assert (small.groupby("text_crc32")["shard"].nunique() == 1).all()


def test_sharding_group_slack(spark):
    """A group of equal texts below the slack stays whole, one above it is divided; equal keys are told apart by their columns."""
    rows = spark.range(2050).select((F.col("id") % 41).alias("g"), F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("size"))
    keyed = rows.withColumn("key", sharding.sort_key(F.col("g").cast("string"), F.col("doc_id")))
    for slack, most in ((0.2, 1), (0.01, 2)):
        placed = sharding.histogram_sort(keyed, sharding.find_splitters(keyed, 4, group_slack=slack)).toPandas()
        assert placed.groupby("g")["shard"].nunique().max() == most
        assert all(sorted(g) == list(range(len(g))) for _, g in placed.groupby("shard")["slot"])


@pytest.mark.parametrize("doc_id", [None, 7])
def test_sharding_of_equal_rows(spark, tmp_path, doc_id):
    """Rows of one text and a null or repeated id are divided like any other group, and reruns agree."""
    spark.createDataFrame([(doc_id, "same text", "en", "a")] * 2400, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    first, again = (sharding.op8_sharding(spark, str(tmp_path)).cache() for _ in range(2))
    sizes = {r["shard"]: r["count"] for r in first.groupBy("shard").count().collect()}
    assert sorted(sizes) == list(range(24)) and all(97 <= n <= 103 for n in sizes.values())
    assert sorted((r["shard"], r["slot"]) for r in first.collect()) == [(k, i) for k in range(24) for i in range(sizes[k])]
    assert sorted(map(repr, first.collect())) == sorted(map(repr, again.collect()))


def test_numbers_of_equal_rows(spark):
    rows = common.cut(spark.range(1000).select((F.col("id") % 3).alias("a"), F.lit("x").alias("b")).repartition(7))
    got = common.numbered(rows, "a", "b").groupBy("a").agg(F.sort_array(F.collect_list("number")).alias("n")).collect()
    assert sorted(len(r["n"]) for r in got) == [333, 333, 334] and all(list(r["n"]) == list(range(len(r["n"]))) for r in got)


def test_sharding_of_one_large_group(spark):
    keyed = spark.range(3000).select(F.lit(10).cast("long").alias("size"), sharding.sort_key(F.lit("same"), F.col("id")).alias("key"))
    placed = sharding.histogram_sort(keyed, sharding.find_splitters(keyed, 4)).groupBy("shard").count().collect()
    assert len(placed) == 4 and all(abs(r["count"] - 750) < 40 for r in placed)


def test_mixing(spark):
    rows = QUERIES["op4_mixing"](spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    m = rows.merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert (m["size"] == m["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))).all()
    assert (m["taken"] <= 2 * m["size"]).all()
    g = m.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (g["size"] == g["source_size"]).all() and abs(g["target"].sum() - 1.5 * g["size"].sum()) < 1e-6
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(g.index))}
    stopped: set = set()
    while True:  # share out again and again
        left = 1.5 * g["size"].sum() - sum(2 * g.loc[s, "size"] for s in stopped)
        total = sum(w for s, w in weights.items() if s not in stopped)
        target = {s: 2 * g.loc[s, "size"] if s in stopped else left * w / total for s, w in weights.items()}
        over = {s for s in weights if target[s] > 2 * g.loc[s, "size"] + 1e-9}
        if not over - stopped:
            break
        stopped |= over
    assert all(abs(target[s] - g.loc[s, "target"]) < 1e-6 * g.loc[s, "target"] for s in weights)
    assert (abs(g["taken"] - g["target"]) <= 2 * mixing.BLOCK + 0.05 * g["target"]).all()


def test_mixed_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("extra", F.lit(1))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    taken = QUERIES["op4_mixing"](spark, SMALL).where("taken > 0").select("doc_id", F.col("taken").alias("n"))
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, taken.collect()))


def test_mix_of_repeated_and_null_ids(spark):
    """Each row has the pieces of its own words, whatever its id; equal rows each have their own; the same rows give the same mix."""
    texts = [" ".join(f"{k}{i}" for i in range(30)) for k in "abcdefgh"]
    rows = [(None, t, "s") for t in texts[:4]] + [(7, t, "s") for t in texts[4:6]] + [(8, texts[6], "t"), (8, texts[6], "t"), (9, texts[7], None), (9, None, None), (9, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    sized, sources, n = mixing.plan(docs)
    for r in mixing.spans(mixing.pack(sized, n), mixing.draw(sources)).where("shard is not null").collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["word_to"] - r["word_from"]
    runs = [sorted(((r["doc_id"], r["text"]) for r in mixing.mix_documents(docs.repartition(k)).collect()), key=repr) for k in (1, 3)]
    assert runs[0] == runs[1]
    words: dict = {}
    for doc_id, text in runs[0]:
        words[doc_id] = words.get(doc_id, 0) + len(text.split())
        own = {t[0] for d, t, _ in rows if t and d == doc_id}
        assert {w[0] for w in text.split()} <= own and len({w[0] for w in text.split()}) == 1
    assert words == taken and sum(words.values()) <= 2 * 9 * 30


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), [F.lit(3)]).alias("p")).collect()]
        assert sorted(got) == list(range(n))


def test_shard_draws(spark):
    """Counts of sources by shard are drawn: shards are of equal size, and vary as draws without replacement do."""
    sizes = spark.createDataFrame([(f"s{i}", 640 * n) for i, n in enumerate((400, 100, 900))], "source string, source_size long")
    sources = mixing.source_targets(sizes)
    slots = mixing.draw(sources).toPandas()
    table_ = slots.groupby(["shard", "source_no"]).size().unstack(fill_value=0)
    n, k = len(slots), len(table_)
    assert k == mixing.SHARDS and abs(table_.sum(axis=1) - n / k).max() <= 1
    for source, total in table_.sum().items():
        variance = n / k * (total / n) * (1 - total / n) * (n - n / k) / (n - 1)
        assert 0.3 * variance < table_[source].var() < 2.5 * variance
    expected = {r["source_no"]: r["target"] / 64 for r in sources.collect()}
    assert all(abs(total - expected[source]) <= 1 for source, total in table_.sum().items())
    assert not slots.duplicated(["source_no", "block_no", "turn"]).any()


def test_quality_statistics():
    text = "a b c d e x a b c d e # **"
    n, chars, symbols, dup, repeat = quality.statistics(text)[:5]
    assert (n, chars, symbols, dup, repeat) == (13, 14, 3, 0, 10)
    assert quality.statistics("l 1\n\nl 1\n \nl 1")[3] == 2 and quality.statistics(None)[:5] == [0, 0, 0, 0, 0]


def brute_counts(text):
    """The counts by their definitions, one window after another."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(again)


def test_quality_counts_by_hand(spark):
    rng = np.random.default_rng(7)
    texts = [None, "", " \n"] + ["".join(rng.choice(list("ab  \n\t#*"), rng.integers(0, 120))) for _ in range(300)]
    assert [tuple(quality.statistics(t)[:5]) for t in texts] == [brute_counts(t) for t in texts]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r["text"]) < 8000}
    for r in QUERIES["op1_quality"](spark, SMALL).collect():
        if r["doc_id"] in docs:
            want = brute_counts(docs[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])


def test_quality_path_lengths():
    """The forest's scores equal walking each row down each tree, one node after another."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    forest = quality.grow_forest(x[:200], x.min(axis=0), x.max(axis=0))
    got = forest.score(x)
    for i in range(0, 300, 7):
        total = 0.0
        for t in range(len(forest.feature)):
            node = 0
            while forest.feature[t, node] >= 0:
                node = forest.left[t, node] + int(x[i, forest.feature[t, node]] >= forest.cut[t, node])
            total += forest.length[t, node]
        assert abs(got[i] - 2 ** (-total / len(forest.feature) / quality.mean_length(quality.TREE_ROWS))) < 1e-9


def test_quality_measures_labelled_rows_only(spark, monkeypatch):
    """In the fit, statistics come above the join with the labels, once."""
    plans = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    quality.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    (plan,) = [p for p in plans if "ArrowEvalPython" in p]
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Join")


def test_quality_verdicts(spark):
    """Kept documents are those of usual rates; labelled poor ones of another kind go."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    rows = [(i, " ".join(word() + ("!#%" if i % 5 == 0 else "") for _ in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("quality")).where("doc_id < 250")
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert not [i for i in kept if i % 5 == 0] and len(kept) > 300


def test_quality_forest():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 0.05, (400, 3)), rng.normal(1, 0.05, (40, 3))
    x, y = np.concatenate([good, bad]), np.arange(440) < 400
    forest = quality.grow_forest(good, x.min(axis=0), x.max(axis=0))
    cut = quality.calibrate(forest.score(x), y)
    kept = forest.score(x) <= cut
    assert kept[:400].mean() > 0.99 and not kept[400:].any()
    assert quality.calibrate(np.array([0.1, 0.2]), np.array([True, True])) == 1.0


def brute_segments(s):
    """All maximal segments, by the definition: take the best one, then those of both sides."""
    if not len(s) or s.max() <= 0:
        return []
    total = np.concatenate([[0], np.cumsum(s)])
    best = max(((total[j] - total[i], -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))
    _, _, _, i, j = best
    return [*brute_segments(s[:i]), (i, j, total[j] - total[i]), *[(a + j, b + j, v) for a, b, v in brute_segments(s[j:])]]


def test_segments():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.choice([-3.5, -1.25, -0.5, 1.1, 2.3, 4.7], rng.integers(0, 14)) + rng.normal(0, 1e-3, 1)
        got, want = toxicity.segments(s), brute_segments(s)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_extreme_values():
    """Lambda solves its equation; K makes the expectation of chance segments near their share."""
    rng = np.random.default_rng(3)
    values, share = np.array([-3 / 64, 2.0, 4.0]), [0.97, 0.02, 0.01]
    docs = [rng.choice(values, 400, p=np.array(share) * [1, 0.3, 0.3] + [0.021, 0, 0]) for _ in range(400)]
    flat, n = np.unique(np.concatenate(docs), return_counts=True)
    tops = [(max((x[2] for x in toxicity.segments(d)), default=0.0), len(d)) for d in docs]
    lam, k = toxicity.extreme_values(dict(zip(flat.tolist(), n.tolist())), tops)
    assert abs((n * np.exp(lam * flat)).sum() / n.sum() - 1) < 1e-6 and 1e-4 <= k <= 1
    expected = np.array([k * m * np.exp(-lam * s) for s, m in tops])
    assert (expected < 0.05).mean() < 0.15


def test_toxicity_scores_by_hand(spark):
    """Scores equal token scores, brute-force segments, and the formula, one document at a time."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert all(v * toxicity.GRAIN == round(v * toxicity.GRAIN) for v in model.scores.values())
    for r in toxicity.judge(docs.where("length(text) < 1500"), model).collect():
        words = re.findall(r"\w+", (r["text"] or "").lower())
        s = np.array([next((model.scores[f] for f in [w, *(f"{w[:n]}*" for n in (7, 6, 5, 4) if len(w) > n)] if f in model.scores), toxicity.DRIFT) for w in words])
        found = [(v, model.k * max(len(words), 1) * np.exp(-model.lam * v)) for _, _, v in brute_segments(s)]
        found = [f for f in found if f[1] <= toxicity.SIGNIFICANT]
        best = max((-np.log(max(e, 1e-300)) for _, e in found), default=0.0)
        x = np.array([1.0, min(best, 60) / 10, np.log1p(len(found)), np.log1p(sum(v for v, _ in found))])
        assert abs(r["toxicity"]["score"] - 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))) < 1e-9
        assert len(r["toxicity"]["passages"]) == len(found)


def test_toxicity_learns(spark):
    texts = [(i, f"w{i % 7} w{i % 5} w{i % 3} " * 10 + ("nasty thing " if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.judge(docs, model).select("doc_id", "toxicity.score").collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in rows)


def test_held_out_accuracy(spark):
    rows = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    right, n = rows.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.count(F.lit(1))).first()
    assert n > 500 and right > 0.97


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><body><nav><a>Home</a></nav><div class='content'><h1>Title</h1><div><p>Many words of text that go on &amp; on here.</p><p>Short.</p></div></div><div id='comments'><p>Great words in a long comment by a reader</p></div><footer>c</footer></body></html>", "Title\nMany words of text that go on & on here.\nShort."),
        ("<article><h1>T</h1><p>One  two\n three<br>four</p><aside>ad words</aside><form>go now</form><script>x('<p>')</script></article><p>outside words words words</p>", "T\nOne two three\nfour"),
        (None, ""), ("", ""), ("<p></p>", ""),
    ],
)
def test_html(page, want):
    assert html.extract(page, html.Weights()) == want


def test_best_run():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.integers(-3, 4, rng.integers(0, 12)).astype(float)
        a, b = html.best_run(s)
        assert s[a:b].sum() == max([0.0, *(s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>Hello world text here</p><script>if(a<b){x()}</script><p>More text words here</p></article>", "Hello world text here\nMore text words here"),
        ("<p>a<b words</p>", "a<b words"), ("<p>1 < 2 and 3 > 2 words</p>", "1 < 2 and 3 > 2 words"), ('<p title="x>next words', "next words"),
        ('<article><div class="search-results-study side share legal"><p>One two three four</p></div><figure><figcaption>Cap words</figcaption></figure></article>', "One two three four\nCap words"),
        ("<article><header><h1>Title words</h1><p>by someone</p></header><p>Body words here are many</p></article>", "Title words\nBody words here are many"),
        ("<body><div id=main><h1>Head</h1><p>many words of the main text are here and go on</p><p>more words of main</p></div><div class=box><p>an unrelated box</p></div></body>", "Head\nmany words of the main text are here and go on\nmore words of main"),
        ("<article><p>See <i><b><u><s><a href=x>these linked words</a></s></u></b></i> and the plain text that follows them here.</p><ul><li>one item</li></ul></article>", "See these linked words and the plain text that follows them here.\none item"),
        ("<body><p>Text of a page without any element around it goes on and on.</p><div class='cookie-banner'><p>We use cookies on this page all the time and more</p></div><footer>f g h</footer></body>", "Text of a page without any element around it goes on and on."),
    ],
)
def test_html_samples(page, want):
    assert html.extract(page, html.Weights()) == want


def test_html_in_linear_time():
    import time

    def took(k):
        began = time.process_time()
        html.read_page("<div><b>" * k + "</i></p></span>" * k)
        return time.process_time() - began

    assert took(16_000) < 12 * took(4_000) + 0.2


def test_html_needs_its_weights(spark):
    """The learned weights decide: with the article renamed, left out, and the classes renamed, texts are the same; with meaningless weights none is."""
    import html as entities
    from collections import Counter

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    learned = html.fit(pages)
    blank = html.Weights(words=Counter({k: 0.001 for k in learned.words}), tags={k: -1e-9 for k in learned.tags}, marks=dict.fromkeys(learned.marks, 0.0))
    truth = lambda h: entities.unescape(" ".join(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", h, re.S)[1]).split())).split()
    changes = [lambda h: h, lambda h: re.sub(r"(</?)article\b", r"\1div", h), lambda h: re.sub(r"</?article>", "", h), lambda h: re.sub(r"(</?)article\b", r"\1div", h).replace('class="ad"', 'class="qx7"')]
    for h in (r["html"] for r in pages.collect()):
        for change in changes:
            assert html.extract(change(h), learned).split() == truth(h) != html.extract(change(h), blank).split()


def test_html_articles(spark):
    truth = lambda h: [w for w in re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", h, re.S)[1]).split()]
    import html as entities

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in QUERIES["op3_html_extraction"](spark, SMALL).collect():
        assert r["text"].split() == entities.unescape(" ".join(truth(pages[r["page_id"]]))).split() and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){f()}</script>", "<script>a='</p>';b=\"it's\";c='\"'</script>", "<SCRIPT>x<!-- y</Script\n>", "<style>a<b{content:'\"'}<!--</style>",
        "<script>a<b</scripts>c</script >", "<script></script>", "<title>1 <n 2</title>", "<textarea><!--</textarea>", "<svg><style>a<b</style></svg>",
    ],
)
def test_html_raw_content(raw):
    for page in (f"<head>{raw}</head><body><article><p>One two three</p></article></body>", f"<article><p>One two three</p>{raw}</article><footer>c</footer>"):
        assert html.extract(page, html.Weights()) == "One two three"
    assert html.extract("<article><p>One two three</p><script>i<n", html.Weights()) == "One two three"


def test_html_scan_without_marks(spark):
    """The scan alone finds the same texts: marks renamed or left out, and a short marked teaser beside a long plain body."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    learned = html.fit(pages)
    for h in (r["html"] for r in pages.collect()):
        want = html.extract(h, learned)
        assert html.extract(re.sub(r"</?(?:article|main)\b[^>]*>", "", h), learned) == want
        assert html.extract(re.sub(r"(</?)(?:article|main)\b", r"\1div", h), learned) == want
    body = " ".join(["word"] * 80)
    page = f"<body><div><article><p>Short teaser.</p></article></div><nav><a>a b</a></nav><div><div><p>{body}</p><p>{body}</p></div></div></body>"
    for weights in (learned, html.Weights()):
        assert html.extract(page, weights) == f"{body}\n{body}"


def test_pieces_equal_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op6_sentencepiece"](spark, SMALL).collect():
        ids = library.encode(docs[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_long_texts_in_parts(spark):
    """Texts far longer than a part, between short ones: ids and texts equal the library's."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    texts = ["short", "word " * 400_000, None, "", "né " * 300_000, "last"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in pieces.round_trip(docs, pieces.public_model()).collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert list(r["piece_ids"]) == ids and r["piece_text"] == library.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "   a  b ", "a\n\tb", "▁a ▁", "<s>", "é́😀中", "\x00", "a" * 999, "ab" * 500, "=" * 77, "ﬁ　"])
def test_piece_edges(text):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model()), pieces.model(pieces.public_model())
    ids = library.encode(text, add_bos=True, add_eos=True)
    (got,) = own.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == ids and own.decode(got) == library.decode(ids)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 24))
    x = np.repeat(centers, 20, axis=0) + rng.normal(scale=0.25, size=(800, 24))
    x[5] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    assert (got["n_links"].to_numpy() <= link.sum(axis=1)).all() and got["n_links"].sum() >= 0.9 * link.sum()


@pytest.mark.parametrize("n", [600, 3000, 12_000])
def test_vector_recall(spark, n):
    """Planted groups of near copies among strangers, at several sizes: all links are found, and no others."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 48))
    groups = rng.integers(0, n // 8, n // 2)
    x[: n // 2] = rng.normal(size=(n // 8, 48))[groups] + rng.normal(scale=0.28, size=(n // 2, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum((u[a : a + 2000] @ u.T >= 0.9).sum() for a in range(0, n, 2000)) - n
    print(f"{n} vectors: {got.sum()} of {want} links")
    assert want > n / 10 and 0.99 * want <= got.sum() <= want


def test_tiny_and_huge_vectors(spark):
    """Vectors whose squares leave the range of doubles have their links and do not change those of others."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(300, 16)), 3, axis=0) + rng.normal(scale=0.01, size=(900, 16))
    odd = np.concatenate([x, x[:2] * 1e-200, x[3:5] * 1e200, [[1e-200, *[0.0] * 15]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(odd)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    u = odd / np.abs(odd).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert (got == want).all() and want[:900].min() >= 2


def test_vector_balls(spark):
    """A crowd that no tree can cut is linked by the triangle inequality, and its neighbours by comparison: counts equal brute force."""
    rng = np.random.default_rng(6)
    center = rng.normal(size=24)
    crowd = center + rng.normal(scale=0.05, size=(2600, 24))
    near = center + rng.normal(scale=0.30, size=(300, 24))
    x = np.concatenate([crowd, near, rng.normal(size=(900, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    assert (got["n_links"].to_numpy() == link.sum(axis=1) - 1).all()
    assert (got["component_id"].to_numpy()[:2600] == 0).all()
    packed = df.select(F.col("vec_id").alias("vec"), F.lit(1).cast("long").alias("copies"), F.lit(24).alias("n"), F.pandas_udf(lambda s: s.map(lambda v: np.asarray(v).tobytes()), "binary")("embedding").alias("raw"))
    forest = embeddings.fit(packed, "<f8")
    assert len(forest.balls[24][1]) >= 1
    forest.crowds = embeddings.count_leaves(packed, forest, "<f8")
    assert embeddings.placed(packed, forest, "<f8").count() < 40 * len(x)


def test_vector_blocks(spark):
    """A leaf that is compared in blocks counts each pair once."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=16) + rng.normal(scale=0.01, size=(1300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df).toPandas()
    assert (got["n_links"] == 1299).all() and (got["component_id"] == 0).all()


def test_components(spark):
    import random

    path = list(range(1000, 1300))
    random.Random(3).shuffle(path)  # a long path in any order, a star, and a ring
    more = [*zip(path, path[1:]), *((2000, 2000 + i) for i in range(1, 50)), *((3000 + i, 3000 + (i + 1) % 40) for i in range(40))]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(more, "a long, b long")).collect()}
    assert found == {i: 1000 for i in path} | {i: 2000 for i in range(2000, 2050)} | {i: 3000 for i in range(3000, 3040)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 99), (99, 98), (7, 7), (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {98: 98, 99: 98, 100: 98}


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(docs, least=0.8):
    """Connected texts, by comparing all pairs."""
    ids = sorted(docs)
    sets, root = {i: grams(docs[i]) for i in ids}, {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            same = docs[i] == docs[j] or sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9
            if same and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_minhash(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op9_minhash"](spark, SMALL).collect()}
    assert got == classes(docs)


def test_minhash_blocks(spark):
    """Near copies in buckets of several blocks, some of them below the limit."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    docs = {}
    for i in range(420):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 6), replace=False):
            w[k] = f"x{i}_{k}"
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == classes(docs)


def test_minhash_open_blocks(spark):
    """A large bucket whose blocks do not all hang together: components that meet only across blocks are found."""
    rng = np.random.default_rng(8)
    common = [f"w{i}" for i in range(150)]
    docs = {}
    for i in range(700):  # five kinds, a chain of which each is near the next only
        kind = int(rng.integers(0, 5))
        w = list(common)
        for k in range(4 * kind):
            w[7 * k % 150] = f"y{k}"
        for k in rng.choice(150, 2, replace=False):
            w[k] = f"x{i}_{k}"
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == classes(docs)


def test_minhash_of_unlike_counts(spark):
    """Passages repeated in one of two texts change probability Jaccard and not Jaccard: such pairs are candidates too."""
    doc, h, n = minhash.shingles(["a b c d e f " * 3, "a b c d e f"])
    assert minhash.weights(n).max() <= 1 + minhash.REPEATED and minhash.weights(n).min() == 1
    rng = np.random.default_rng(5)
    docs = {}
    for i in range(0, 120, 2):
        w = [f"t{i}_{k}" for k in range(100)]
        other = list(w)
        other[int(rng.integers(8, 20))] = "z"
        docs[i], docs[i + 1] = " ".join(w + (w[40:90] + [f"q{i}"]) * 4 + w[90:]), " ".join(other + w[40:90] + [f"q{i}"] + w[90:])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    want = classes(docs)
    assert got == want and sum(i != c for i, c in want.items()) > 20


def test_keep_one_of_odd_rows(spark):
    """One row of each class stays; rows with null or repeated ids and other texts stay, whatever the partitions."""
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, "a b c"), (None, "d e f"), (None, None), (3, "x y"), (3, "z z z"), (3, "z z z"), (4, long), (5, long + " more"), (None, long), (6, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1))
    for n in (1, 4):
        kept = sorted(((r["doc_id"], r["text"]) for r in minhash.keep_one(docs.repartition(n)).collect()), key=repr)
        assert kept == sorted([(None, "d e f"), (None, None), (3, "x y"), (3, "z z z"), (4, long), (6, "a b c")], key=repr)


def test_probability_jaccard():
    a, b = " ".join(f"w{i}" for i in range(300)), " ".join([*(f"w{i}" for i in range(40, 300)), *(f"z{i}" for i in range(10))])
    doc, h, n = minhash.shingles([a, b])
    s = minhash.signatures(doc, h, minhash.weights(n), 2, 4000)
    x, y = set(h[doc == 0]), set(h[doc == 1])
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.03


def test_licences(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = license.train(docs)
    found = {(r["doc_id"], r["line"]): r for r in license.scan(docs, model).collect()}
    known = {t: f for f, texts in license.TEMPLATES.items() for t in texts}
    want = {(r["doc_id"], line) for r in docs.collect() for line in r["text"].split("\n") if line in known}
    assert want and want <= set(found) and all(found[k]["family"] == known[k[1]] and found[k]["confirmed"] for k in want)
    clean = spark.createDataFrame([(1, "It was permitted to walk.\nMy driver's licence is old."), (2, None), (3, "")], "doc_id long, text string")
    assert license.scan(clean, model).where("confirmed").count() == 0


def test_licences_without_cue(spark):
    """Lines and hard-wrapped paragraphs in several languages; every template has a gate word."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = license.train(docs)
    statements = {1: "Alle Rechte vorbehalten", 2: "Tous droits reserves", 3: "This work is dedicated to the public domain.", 4: "Provided under the terms of the EPL 2.0", 5: "Todos los derechos reservados."}
    wrapped = "Permission is hereby granted, free of charge,\nto any person obtaining\na copy of this software"
    rows = [*statements.items(), (6, f"Prose of a day.\n\n{wrapped}\n \nMore prose."), (7, "One.\n\nTwo.")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["unit"], r["paragraph"]): r for r in license.scan(texts, model).collect()}
    assert all(got[i, "line", 0]["family"] == f and got[i, "line", 0]["confirmed"] for i, f in zip(statements, ("Proprietary", "Proprietary", "CC0-1.0", "EPL-2.0", "Proprietary")))
    assert (got[6, "paragraph", 1]["family"], got[6, "paragraph", 1]["similarity"], got[6, "paragraph", 1]["line"]) == ("MIT", 1.0, wrapped)
    assert [(r["unit"], r["paragraph"]) for r in license.units(texts).where("doc_id = 7").collect()] == [("line", 0), ("line", 2)]
    assert all(set(grams) & set(model.gate) for _, _, grams in license.template_grams(spark))


def test_unknown_licences(spark):
    """Licences that the templates do not have are found and not taken for others; another version or name is not confirmed."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = license.train(docs)
    strangers = ["ISC License", "Licensed under the Zlib License.", "Boost Software License 1.0", "Released under the Artistic License 2.0.", "Released under the Sleepycat License.", "Microsoft Public License"]
    versions = ["Licensed under the Apache License, Version 1.1.", "GNU General Public License, version 2", "Mozilla Public License 1.1", "Licensed under CC BY-ND 4.0."]
    texts = spark.createDataFrame(list(enumerate(strangers + versions)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license.scan(texts, model).where("unit = 'line'").collect()}
    assert not [r for r in got.values() if r["confirmed"]]
    unknown = [i for i in range(len(strangers)) if i in got and got[i]["family"] == license.UNKNOWN]
    assert len(unknown) >= len(strangers) - 1 and len(set(range(len(strangers))) & set(got)) >= len(strangers) - 1
    plain = ["The eclipse was seen by the public in version one of the story.", "He had free time and no warranty for the old car.", "My rights and yours are reserved tables."]
    prose = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    assert license.scan(prose, model).where("confirmed").count() == 0


def test_held_out_family(spark, monkeypatch):
    """A family that the model was not trained on is unknown, or at least never confirmed as another."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    lines = license.TEMPLATES["EPL-2.0"] + license.TEMPLATES["CC0-1.0"]
    monkeypatch.setattr(license, "TEMPLATES", {k: v for k, v in license.TEMPLATES.items() if k not in ("EPL-2.0", "CC0-1.0")})
    found = license.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), license.train(docs)).where("unit = 'line'").collect()
    assert not [r for r in found if r["confirmed"]] and sum(r["family"] == license.UNKNOWN for r in found) >= 0.6 * len(found) > 0


def test_licences_by_hand(spark):
    """Scores of all lines and paragraphs of all documents, without the gate, by a softmax in numpy: the same rows are found."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = license.train(docs)
    got = {(r["doc_id"], r["unit"], r["paragraph"]): (r["family"], r["probability"]) for r in license.scan(docs, model).collect()}
    place = {g: i for i, g in enumerate(model.vocabulary.vocabulary)}
    weights, bias = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    first, offset = model.licences.coefficients.toArray(), model.licences.intercept
    want = {}
    for r in docs.collect():
        each = [("line", i, x) for i, x in enumerate(r["text"].split("\n"))]
        blocks = re.split(r"\n(?:[ \t\r]*\n)+", r["text"])
        each += [("paragraph", i, x) for i, x in enumerate(blocks) if re.search(r"\S[ \t\r]*\n\s*\S", x)]
        for unit, i, line in each:
            w = re.findall(r"[^\W_](?:(?:[^\W_]|[.+-])*(?:[^\W_]|[+-]))?", line.lower())
            grams = {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}
            at = [place[g] for g in grams if g in place and set(g.split(" ")) & set(model.gate)]
            if at:
                z = weights[:, at].sum(axis=1) + bias
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                licence = 1 / (1 + np.exp(-first[at].sum() - offset))
                if licence >= model.licence_cut:
                    want[r["doc_id"], unit, i] = (model.classes[p.argmax()] if p.max() >= model.family_cut else license.UNKNOWN, round(float(licence * p.max()), 6))
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_licence_sample(spark):
    """Families of many distinct lines are cut by hash before they are ranked; small ones are taken whole."""
    many = spark.range(20_000).selectExpr("'MIT' as family", "concat('Copyright ', id, '. MIT License') as line")
    few = spark.range(150).selectExpr("'EPL-2.0' as family", "concat('EPL 2.0 ', id) as line")
    ranked = {r["family"]: r["count"] for r in license.near_bound(many.union(few), 200).groupBy("family").count().collect()}
    assert ranked["EPL-2.0"] == 150 and 200 <= ranked["MIT"] < 600
    sample = license.family_sample(many.union(few), 200)
    assert {r["family"]: r["count"] for r in sample.groupBy("family").count().collect()} == {"MIT": 200, "EPL-2.0": 150}
    assert sorted(sample.collect()) == sorted(license.family_sample(many.union(few).repartition(7), 200).collect())
