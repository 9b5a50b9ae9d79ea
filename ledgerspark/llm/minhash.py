"""Near-duplicates by ProbMinHash, banding and verification.

Shingles of five words have weights by how often they occur.  Each shingle sends arrivals of a Poisson process of
its weight's rate to random registers; a register keeps the earliest arrival's shingle, and a shingle
stops when its next arrival is later than all registers.  Two documents agree in a register with the probability of
their probability Jaccard similarity.  Documents that agree in a band of registers are compared exactly.

Texts are compared once, whatever their number of copies.  Buckets are compared in blocks of bounded size inside tasks;
only one link for each document and block leaves a task, never all pairs.  In a bucket of many blocks, each block is first compared in
itself and with one leader; after that only blocks of different components meet, so a group of near copies costs about its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import WORD, cut, parts, row_hashes, table
from ledgerspark.llm.graph import components

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of registers, and how much more a shingle weighs that is repeated without end.  With weights from 1 to 1 + REPEATED, probability
#: Jaccard is at least Jaccard / (1 + REPEATED), 0.727 for a pair at 0.8; such a pair misses all bands with probability 0.00006 at most.
BANDS, ROWS, REPEATED = 30, 4, 0.1
#: Documents of a bucket that are compared in one block, and code points handled at once.
BLOCK, CHUNK = 192, 1 << 19
#: Rows of groups that a task gets on average at most, and linked documents that it holds before it returns their links.
TASK_ROWS, HELD = 20_000, 100_000
_WORD = re.compile(WORD)
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: number of the text, 64-bit hash, and count in it, ordered by both.

    A text of one to four words has one shingle, all its words; a text without words has none.
    """
    split = [_WORD.findall(t) for t in texts]
    n = np.array([len(w) for w in split], dtype=np.int64)
    flat = [w for words in split for w in words]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, names = pd.factorize(np.array(flat, dtype=object))
    word = pd.util.hash_array(np.asarray(names, dtype=object), categorize=False)[codes]
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    many = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), many)
    at = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    end = np.repeat(start + n, many)
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(SHINGLE):
        inside = at + i < end
        h = np.where(inside, mix(h + _STEP + word[np.minimum(at + i, len(word) - 1)]), h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures (n x registers) of weighted elements of n documents; rows without elements are 0.

    All elements of a batch step through their arrivals together; those whose next arrival is later than every
    register of their document are done.
    """
    times = np.full(n * registers, np.inf)
    values = np.zeros(n * registers, dtype=np.uint64)
    now, state, live = np.zeros(len(h)), h.copy(), np.arange(len(h))
    rate = weight.astype(np.float64)
    while len(live):
        state = state + _STEP
        r = mix(state ^ np.uint64(0x5851F42D4C957F2D))
        now = now - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        slot = doc[live] * registers + (mix(r) % np.uint64(registers)).astype(np.int64)
        better = now < times[slot]
        if better.any():
            s, t = slot[better], now[better]
            np.minimum.at(times, s, t)
            won = times[s] == t
            values[s[won]] = h[live[better][won]]
        latest = times.reshape(n, registers).max(axis=1)
        on = now < latest[doc[live]]
        live, now, state, rate = live[on], now[on], state[on], rate[on]
    return values.reshape(n, registers)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    out = np.zeros((len(signature), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out + _STEP + signature[:, r::ROWS][:, :BANDS])
    return out.astype(np.int64)


def weights(count: np.ndarray) -> np.ndarray:
    """Weight of a shingle by how often its text has it."""
    return 1 + REPEATED * (1 - 1 / count)


def with_bands(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``bands`` (array of long; empty for texts without words)."""

    @F.pandas_udf("array<long>")
    def bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or "" for t in batch]
            for part in parts(texts, CHUNK):
                doc, h, count = shingles(texts[part])
                n = part.stop - part.start
                found = band_hashes(signatures(doc, h, weights(count), n))
                some = np.bincount(doc, minlength=n) > 0
                yield pd.Series([row if ok else row[:0] for row, ok in zip(found, some)])

    return docs.withColumn("bands", bands(F.col(text)))


def with_shingles(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``shingles``: the sorted distinct shingles as 32-bit hashes, as binary.

    Of two texts with n shingles, about n / 2 ** 32 of them meet by chance, far less than one for any text here.
    """

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or "" for t in batch]
            for part in parts(texts, CHUNK):
                doc, h, _ = shingles(texts[part])
                ends = np.searchsorted(doc, np.arange(part.stop - part.start + 1))
                yield pd.Series([np.unique((h[a:b] >> np.uint64(32)).astype("<u4")).tobytes() for a, b in zip(ends[:-1], ends[1:])], dtype="object")

    return docs.withColumn("shingles", packed(F.col(text)))


def linked(sets: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """For each set, the lowest number of a set in its component of pairs with Jaccard similarity ``least`` or more."""
    n, size = len(sets), np.array([len(s) for s in sets], dtype=np.float64)
    values, owners = np.concatenate(sets), np.repeat(np.arange(n), size.astype(np.int64))
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    shared = np.bincount(column)[column] > 1
    column, owners = np.unique(column[shared], return_inverse=True)[1], owners[shared]
    common = np.zeros((n, n), dtype=np.float32)
    step = max(1, (1 << 22) // n)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + step, step))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            width = int(min(step, column[b - 1] - k * step + 1))
            part = np.zeros((n, width), dtype=np.float32)
            part[owners[a:b], column[a:b] - k * step] = 1
            common += part @ part.T
    union = size[:, None] + size[None, :] - common
    link = (common >= least * union - 1e-6) & (common > 0)
    np.fill_diagonal(link, True)
    label = np.arange(n)
    while True:
        low = np.where(link, label[None, :], n).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def links(members: DataFrame, rows: int, least: float = SIMILARITY) -> DataFrame:
    """Links (``a``, ``b``) that connect the similar documents of each group.

    ``members``, of ``rows`` rows, has the group's key ``g1``, ``g2``, ``g3``, ``node`` and ``shingles``; groups are small and whole in a task.
    A task joins the links of its groups and returns one for each of its documents that has any, at the latest when it holds ``HELD``.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def found() -> pd.DataFrame:
            each = [(x, root(x)) for x in parent]
            parent.clear()
            return pd.DataFrame([f for f in each if f[0] != f[1]], columns=["a", "b"]).astype("int64")

        for a, b in compared(batches):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
            if len(parent) >= HELD:
                yield found()
        yield found()

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int]]:
        waiting: list[pd.DataFrame] = []
        for b in batches:
            whole = pd.concat([*waiting, b], ignore_index=True) if waiting else b.reset_index(drop=True)
            key = whole[["g1", "g2", "g3"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.zeros(0, np.int64)
            if len(starts):
                yield from joined(whole.iloc[: starts[-1]], starts)
                waiting = [whole.iloc[starts[-1] :]]
        if waiting:
            yield from joined(waiting[0].reset_index(drop=True), np.array([0, len(waiting[0])]))

    def joined(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        ids, blobs = rows["node"].to_numpy(), rows["shingles"].to_numpy()
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            order = np.argsort(ids[a:b]) + a
            label = linked([np.frombuffer(blobs[i], dtype="<u4") for i in order], least)
            yield from ((int(ids[order[i]]), int(ids[order[r]])) for i, r in enumerate(label.tolist()) if i != r)

    # Groups are dealt by key and follow each other in a task, so that tiny groups cost little.
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    dealt = members.repartition(tasks, "g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3")
    return dealt.select("g1", "g2", "g3", "node", "shingles").mapInPandas(compare, "a long, b long")


def block_of(node: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), F.col(node)), blocks)


def buckets_of(texts: DataFrame) -> DataFrame:
    """Members of the buckets with more than one: ``node``, ``g1`` (the bucket) and ``n`` (its size); of buckets with equal members one stays."""
    each = texts.select("node", F.posexplode("bands").alias("band", "value"))
    found = each.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit("s"), "node"), 20)).alias("s")).where("n > 1")
    kept = found.groupBy("n", "x", "s").agg(F.min(F.struct("band", "value")).alias("k")).select("n", F.col("k.band").alias("band"), F.col("k.value").alias("value"))
    return each.join(kept.hint("merge"), ["band", "value"]).select("node", F.xxhash64("band", "value").alias("g1"), "n")


def first_groups(buckets: DataFrame) -> DataFrame:
    """What is compared first: buckets of up to ``BLOCK`` documents whole; of others each block, with the bucket's smallest node in all of them."""
    blocks = F.ceil(F.col("n") / BLOCK)
    own = buckets.select("node", "g1", F.when(F.col("n") > BLOCK, block_of("node", blocks)).otherwise(F.lit(0)).alias("g2"))
    leaders = buckets.where(F.col("n") > BLOCK).groupBy("g1", blocks.alias("blocks")).agg(F.min("node").alias("node"))
    everywhere = leaders.withColumn("g2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rest = everywhere.where(F.col("g2") != block_of("node", F.col("blocks"))).select("node", "g1", "g2")
    return own.unionByName(rest).withColumn("g3", F.col("g2"))


def open_groups(large: DataFrame, classes: DataFrame) -> DataFrame:
    """What is left of large buckets (``node``, ``g1``): every pair of blocks that hold different components, so far in ``classes``.

    Components of at least ``BLOCK`` documents have blocks of their own, the others share some.  Blocks of one component do not meet.
    """
    named = large.join(classes.hint("merge"), "node", "left").select("node", "g1", F.coalesce("component", "node").alias("c"))
    sizes = named.groupBy("g1", "c").agg(F.count(F.lit(1)).alias("m"))
    several = sizes.groupBy("g1").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g1")
    sizes = cut(sizes.join(several.hint("merge"), "g1", "left_semi").withColumn("own", F.when(F.col("m") >= BLOCK, F.col("c")).otherwise(F.lit(-1).cast("long"))))
    each = sizes.groupBy("g1", "own").agg(F.ceil(F.sum("m") / BLOCK).alias("k"))
    layout = each.groupBy("g1").agg(F.array_sort(F.collect_list(F.struct("own", "k"))).alias("layout"))
    total = lambda entries: F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["k"])
    placed = named.join(sizes.select("g1", "c", "own").hint("merge"), ["g1", "c"]).join(layout.hint("merge"), "g1")
    first, k = total(F.filter("layout", lambda e: e["own"] < F.col("own"))), total(F.filter("layout", lambda e: e["own"] == F.col("own")))
    placed = placed.withColumns({"first": first, "k": k, "all": total(F.col("layout"))}).withColumn("block", F.col("first") + block_of("node", F.col("k")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)))
    met = met.where((F.col("own") < 0) | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("k")))
    return met.select("node", "g1", F.least("block", "other").alias("g2"), F.greatest("block", "other").alias("g3"))


def classes_of(texts: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """``node`` and ``component`` of the texts that are linked; ``texts`` has ``t1``, ``t2``, ``node`` and ``bands``, ``docs`` the texts themselves."""
    buckets = cut(buckets_of(texts))
    wanted = buckets.select("node").distinct().join(texts.select("node", "t1", "t2", *id_key("least_id")).hint("merge"), "node")
    # The row of the smallest id stands for all copies, so copies are spread over the tasks of this join.
    source = docs.select("text", *text_hashes(), *id_key("doc_id")).join(wanted.hint("merge"), ["t1", "t2", "id_null", "id_key"])
    sets = cut(with_shingles(source.select("node", "text")).groupBy("node").agg(F.first("shingles").alias("shingles")))

    def compared(groups: DataFrame) -> DataFrame:
        groups = cut(groups)
        return cut(links(groups.join(sets.hint("merge"), "node"), groups.count(), least))

    found = compared(first_groups(buckets))
    classes = components(found)
    large = buckets.where(F.col("n") > BLOCK)
    if large.limit(1).count():
        rest = compared(open_groups(large, classes))
        if rest.limit(1).count():
            classes = components(found.union(rest))
    return classes


def text_hashes() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("again"), text).alias("t2")]


def id_key(name: str) -> list[Column]:
    """An id as two columns without null."""
    return [F.col(name).isNull().alias("id_null"), F.coalesce(F.col(name), F.lit(0)).alias("id_key")]


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, row: tuple[str, ...] = ()) -> DataFrame:
    """Class of each row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``class_id`` and ``component``, and the columns named in ``row``.

    ``component`` numbers the classes: texts connected by links of similarity ``least`` or more, and all their copies.  ``class_id`` is
    the smallest ``doc_id`` of the class.  Texts without words are linked to their equals only; a null text is an empty one.  Every row
    counts for itself: null ids have the class of their text (null if all ids of it are), rows of a repeated id that have different
    texts can be in different classes.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = cut(with_bands(docs.select("doc_id", *row, *text_hashes(), text)).drop("text"))
    once = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"))
    # The numbers of distinct texts hold as long as the table that is written here.
    texts = cut(once.withColumn("node", F.monotonically_increasing_id()))
    classes = classes_of(texts, docs, least)
    mine = cut(texts.select("t1", "t2", "node", "least_id").join(classes.hint("merge"), "node", "left").select("t1", "t2", "least_id", F.coalesce("component", "node").alias("component")))
    named = mine.join(mine.groupBy("component").agg(F.min("least_id").alias("class_id")).hint("merge"), "component").select("t1", "t2", "component", "class_id")
    return rows.join(named.hint("merge"), ["t1", "t2"]).select("doc_id", "class_id", "component", *row)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: ``doc_id``, ``class_id`` (its smallest id) and ``kept`` (it is that one).

    See ``near_duplicates`` for null and repeated ids and texts.
    """
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the one with the smallest id, null ids last, ties by hash of all columns.

    Rows that are equal in all columns are one document.  Rows with a null or repeated id stay if no other row of their class goes before.
    """
    hashed = row_hashes(docs, ("__r1", "__r2"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__r1", "__r2")).alias("first")
    kept = near_duplicates(hashed, row=("__r1", "__r2")).groupBy("component").agg(first).select("first.__r1", "first.__r2")
    found = hashed.join(kept.hint("merge"), ["__r1", "__r2"], "left_semi")
    return found.dropDuplicates(["__r1", "__r2"]).select(*docs.columns)


#: The same classes by comparing all pairs of texts that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
  UNION SELECT x.doc_id, y.doc_id FROM words x JOIN words y ON x.text = y.text AND x.doc_id < y.doc_id),
ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reached r JOIN ways w ON w.a = r.b)
SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM reached GROUP BY a
"""
