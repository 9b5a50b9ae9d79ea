"""Spelling variants, repeated passages and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import search, spelling, substrings
from tests.conftest import SMALL

DOCS = "doc_id long, text string"


# op11


def near_by_deletion(words):
    """Near words by what is left when one code point goes."""
    near, same = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
            same[(i, short)].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = near_by_deletion(words)
    best = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def got_variants(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or -1) for r in spelling.variants(df).collect())


def test_variants_of_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert got_variants(docs) == brute_variants(docs.collect())


def test_variants_of_hard_words(spark):
    """Few letters, repeated letters and long words: many ties of bigrams and chains of forms."""
    random.seed(5)
    words = ["".join(random.choice("aabé") for _ in range(random.randrange(5, 9))) for _ in range(1500)] + ["a" * k for k in range(5, 30)] + ["ab" * k for k in range(3, 15)] + ["x" * 4000 + "y", "x" * 4001 + "y"]
    rows = [(random.choice([None, 1, 2, 300]), " ".join([w] * random.choice([1, 3, 6, 12, 24, 50]))) for w in words]
    rows += [(1, None), (2, ""), (3, "日本語 œuvre 123 ÀÉÎ ÀÉÎxy×÷")] * 3
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    want = brute_variants(rows)
    assert got_variants(docs) == want and sum(bool(x[1]) and x[1] != x[2] for x in want) > 20


def test_pivots_cover_every_edit():
    """Of two near words one has a pivot in the other's prefix, on the side without the edit."""
    random.seed(6)
    words = sorted({"".join(random.choice("abc") for _ in range(random.randrange(5, 8))) for _ in range(900)})
    count = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    rank = {g: i for i, g in enumerate(sorted(count, key=lambda g: (count[g], g)))}
    found = {w: spelling.pivotal(w, rank, count) for w in words}
    for w, (pivots, prefix, _) in found.items():
        assert pivots[1] - pivots[0] >= 2 and set(pivots) <= set(prefix) and len(prefix) <= spelling.PREFIX + spelling.REPEATS - 1
    pairs = 0
    for w, others in near_by_deletion(dict.fromkeys(words, 3)).items():
        for o in others:
            a, b = (w, o) if found[w][2] <= found[o][2] else (o, w)
            left, right = found[a][0]
            assert any(p == left and a[: p + 2] == b[: p + 2] for p in found[b][1]) or any(a[right:] == b[p:] for p in found[b][1])
            pairs += 1
    assert pairs > 1000


def test_disjoint_pairs():
    for slots in ([(0, 5), (1, 1), (2, 4)], [(3, 1), (4, 1), (9, 7)], [(0, 1), (5, 1), (6, 0)], [(0, 9), (1, 0), (2, 9), (3, 0)]):
        pairs = [(ca + cb, a, b) for a, ca in slots for b, cb in slots if b - a >= 2]
        a, b = spelling.disjoint_pair(slots)
        cost = dict(slots)
        assert cost[a] + cost[b] == min(pairs)[0] and b - a >= 2


# op12


def brute_removal(docs, window=35):
    seen, words = Counter(), [(t or "").encode().split() for _, t in docs]
    for w in words:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((repr(doc_id), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages():
    """Copies, shared passages of 34 to 80 words in other surroundings, repeats inside one text, and words said again and again."""
    random.seed(7)
    word = lambda: random.choice(["the", "of", "aé", "b", "日本", "c", "d"]) if random.random() < 0.5 else f"w{random.randrange(10**6)}"
    some = lambda n: [word() for _ in range(n)]
    shared = [some(n) for n in (34, 35, 36, 50, 80)]
    rows = []
    for i in range(60):
        text = some(random.randrange(0, 90))
        for s in random.sample(shared, random.randrange(0, 3)):
            text += s + some(random.randrange(0, 60))
        rows.append((i, random.choice([" ", "\n", "\t \r\n"]).join(text)))
    rows += [(100, " ".join(shared[4] + ["x"] + shared[4])), (101, "na " * 34), (102, "na " * 36), (103, "ha " * 35), (104, "ab cd " * 700), (105, "ab cd ef " * 40), (None, rows[3][1]), (None, rows[3][1]), (106, None), (107, ""), (108, " \x0b\x0c ")]
    rows += [(200 + i, " ".join(some(3) + shared[3] + some(3))) for i in range(40)]
    return rows


@pytest.mark.parametrize("load, longest", [(20_000, 256), (40, 256), (40, 5)])
def test_removal(spark, monkeypatch, load, longest):
    """Small bounds send buckets down the other path and cut super-k-mers; the result is the same."""
    monkeypatch.setattr(substrings, "LOAD", load)
    monkeypatch.setattr(substrings, "LONGEST", longest)
    rows = passages()
    found = substrings.without_repeats(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in found)
    assert got == brute_removal(rows)


def windows_made(plan):
    """Rows of all Generate nodes of a plan that has run, adaptive stages included."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan" or "QueryStage" in name:
        return windows_made(plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if name == "Generate" else 0
    return own + sum(windows_made(plan.children().apply(i)) for i in range(plan.children().size()))


def test_large_buckets_count_few_windows(spark, monkeypatch):
    """Near copies and a frequent passage: only windows of pieces that meet different ones are counted one by one."""
    monkeypatch.setattr(substrings, "LOAD", 300)
    random.seed(9)
    some = lambda n: [f"w{random.randrange(10**6)}" for _ in range(n)]
    base, passage = some(150), some(60)
    rows = [(i, " ".join(some(40) + passage + some(40))) for i in range(150)]
    for i in range(150):
        near = list(base)
        near[random.randrange(150)] = f"x{i}"
        rows.append((1000 + i, " ".join(near)))
    found = substrings.without_repeats(spark.createDataFrame(rows, DOCS).repartition(5))
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in found.collect())
    assert got == brute_removal(rows)
    assert 0 < windows_made(found._jdf.queryExecution().executedPlan()) < 15_000


@pytest.mark.parametrize("size", [4, 28])
def test_pieces_of_any_gram_keep_equal_windows_together(size):
    random.seed(10)
    texts = [" ".join(random.choice("abc") for _ in range(n)).encode() for n in (34, 35, 60, 500)] + [b"a b " * 200]
    word, n = substrings.split_words(texts)
    found = substrings.super_kmers(word, n, size)
    same, places = defaultdict(set), 0
    for t, a, k, bucket in zip(found["text"], found["at"], found["n"], found["bucket"]):
        for i in range(k):
            same[tuple(texts[t].split()[a + i : a + i + 35])].add(bucket)
            places += 1
    assert places == sum(max(0, len(t.split()) - 34) for t in texts) and all(len(b) == 1 for b in same.values())


def test_super_kmers_hold_every_window_once():
    random.seed(8)
    texts = [" ".join(random.choice("abcdefg") * random.randrange(1, 3) for _ in range(n)).encode() for n in (0, 10, 34, 35, 36, 200, 3000)]
    word, n = substrings.split_words(texts)
    found = substrings.super_kmers(word, n)
    places = sorted((t, a + i) for t, a, k in zip(found["text"], found["at"], found["n"]) for i in range(k))
    assert places == [(t, i) for t, w in enumerate(texts) for i in range(max(0, len(w.split()) - 34))]
    assert len(found["n"]) < len(places) / 4
    same = defaultdict(set)
    for t, a, k, bucket in zip(found["text"], found["at"], found["n"], found["bucket"]):
        for i in range(k):
            same[tuple(texts[t].split()[a + i : a + i + 35])].add(bucket)
    assert all(len(buckets) == 1 for buckets in same.values())


def test_hashes_do_not_depend_on_place():
    word = np.arange(1, 100, dtype=np.uint64)
    a = substrings.sequence_hashes(np.concatenate([word, word]), np.array([3, 102]), np.array([50, 149]))
    assert a[0][0] == a[0][1] and a[1][0] == a[1][1] and a[0][0] != a[1][0]


# op13


def brute_search(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    terms = [Counter(split(t)) for _, t in docs]
    n_docs, total = sum(1 for c in terms if c), sum(sum(c.values()) for c in terms)
    df = Counter(t for c in terms for t in c)
    out = []
    for item_id, text in items:
        rows = []
        for (doc_id, _), c in zip(docs, terms):
            score = 0
            for t in split(text):
                if t in c:
                    m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                rows.append((-score, doc_id is not None, doc_id or 0))
        out += [(repr(item_id), rank, repr(d if known else None), -s) for rank, (s, known, d) in enumerate(sorted(rows)[:10], 1)]
    return sorted(out)


def got_search(spark, docs, items):
    rows = search.ranked(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted((repr(r["item_id"]), r["rank"], repr(r["doc_id"]), r["score"]) for r in rows)


def collection(n=500):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "É", "naïve", "日本語"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda k: random.choice([" ", "-", ".\n"]).join(random.choices(vocabulary, weight, k=k))
    docs = [(i, text(random.randrange(1, 120))) for i in range(n)]
    items = [(i, text(random.randrange(1, 30))) for i in range(40)] + [(None, "the OF W3"), (3, docs[5][1]), (3, docs[5][1]), (9, "unknown"), (10, None), (11, "")]
    docs += [(n + i, docs[5][1]) for i in range(15)] + [(None, docs[5][1]), (None, None), (7, docs[5][1]), (8, "--"), (9, items[1][1]), (9, items[1][1])]
    return docs, items


@pytest.mark.parametrize("bounds", [{}, {"BLOCK": 3, "SHARD": 50, "CELLS": 3000}, {"ITEM_BYTES": 500, "RARE_LEAST": 1, "RARE_SHARE": 10**6}])
def test_search(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(search, name, value)
    docs, items = collection()
    assert got_search(spark, docs, items) == brute_search(docs, items)


def test_search_of_few_documents(spark):
    docs = [(1, "a b"), (2, "a"), (2, "a"), (3, None), (4, "?")]
    items = [(1, "a a b"), (2, "b c")]
    assert got_search(spark, docs, items) == brute_search(docs, items)


def test_blocks_are_skipped_by_bounds_that_hold():
    """No document outside of the candidates reaches its item's limit, and most documents are outside."""
    rng = np.random.default_rng(10)
    n_docs, n_terms = 2000, 120
    rows = []
    for d in range(n_docs):
        own = rng.permutation(n_terms)[: rng.integers(1, 8)] if d % 3 else (d // 200 * 10 + rng.permutation(10)[: rng.integers(2, 8)]) % n_terms
        rows.append(np.sort(own))
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    shard = search.Shard(start, np.concatenate(rows).astype(np.int64), rng.integers(1, 1000, start[-1]))
    items = search.Items(list(range(12)), [b""] * n_terms, np.arange(0, 61, 5), np.concatenate([(i * 10 + np.arange(5)) % n_terms for i in range(12)]), rng.integers(1, 3, 60))
    every, held, outside = np.arange(n_docs), 0, 0
    limit = np.ones(12, dtype=np.int64)
    for i in range(12):
        asked = np.zeros(n_terms, dtype=np.int64)
        asked[items.term[i * 5 : i * 5 + 5]] = items.times[i * 5 : i * 5 + 5]
        score = search.scores(shard, every, asked)
        limit[i] = max(1, np.sort(score)[-10])
        held += (score >= limit[i]).sum()
    found = search.candidates(shard, items, limit)
    for i in range(12):
        asked = np.zeros(n_terms, dtype=np.int64)
        asked[items.term[i * 5 : i * 5 + 5]] = items.times[i * 5 : i * 5 + 5]
        score = search.scores(shard, every, asked)
        assert set(np.flatnonzero(score >= limit[i])) <= set(found[i].tolist())
        outside += n_docs - len(found[i])
    assert held >= 120 and outside > 12 * n_docs / 2


def test_only_items_terms_are_exchanged(spark):
    docs, items = collection(50)
    found = search.vectors(spark.createDataFrame(docs, DOCS), search.items_of(items[:3]))
    assert found.select(F.max(F.array_max("terms"))).first()[0] < len(search.items_of(items[:3]).terms)
