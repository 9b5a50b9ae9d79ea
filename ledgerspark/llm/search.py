"""Ranked lexical search by per-term geometric blocking.

Documents and items are sparse vectors over the items' terms, and a score is their inner product.  Documents are sorted by a
signature of random hyperplanes, so that similar ones stand together, and dealt to shards by ranges of it.  In a shard each
posting list is cut into blocks of similar documents, and each block stores the greatest value of every coordinate as its
summary.  An item walks the lists without which no document can reach its limit, and skips a block only if the summary's
inner product, an upper bound of every score in the block, is below that limit (after Bruch et al., Efficient inverted
indexes for approximate retrieval over learned sparse representations, 2024; here all bounds are exact and nothing is approximated).
The limit of an item is the tenth best score over its rare terms alone, a lower bound of its tenth best score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut, parts, table

#: Results of an item.
TOP = 10
#: Bytes of items' texts that are searched for in one pass over the documents.
ITEM_BYTES = 4 << 20
#: Documents of a shard that are indexed at once, and of a block.
SHARD, BLOCK = 4096, 32
#: A term is rare if one document in so many has it; an item has so many rare terms at least.
RARE_SHARE, RARE_LEAST = 20, 8
#: Hyperplanes of a signature, and cells of summaries that are held at once.
PLANES, CELLS = 24, 1 << 20


def term_table() -> bytes:
    """ASCII digits and letters stay, A to Z as a to z; other ASCII bytes become blanks; all other bytes are parts of letters."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(c if c in keep else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


_TERMS = term_table()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return (text or "").encode().translate(_TERMS).split()


@dataclass
class Items:
    """Items as rows of a sparse matrix: item i asks for ``term[start[i]:start[i + 1]]``, each ``times`` times."""

    ids: list[int | None]
    terms: list[bytes]
    start: np.ndarray
    term: np.ndarray
    times: np.ndarray


def items_of(rows: list[tuple[int | None, str | None]]) -> Items:
    counts = [Counter(terms_of(text)) for _, text in rows]
    terms = sorted(set().union(*counts))
    number = {t: i for i, t in enumerate(terms)}
    start = np.cumsum([0, *[len(c) for c in counts]])
    return Items([i for i, _ in rows], terms, start, np.array([number[t] for c in counts for t in c], dtype=np.int64), np.array([n for c in counts for n in c.values()], dtype=np.int64))


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """``row``, ``doc_id``, ``n`` (all terms of the text) and the items' terms in it: ``terms`` and how often, ``tf``.  The rows are written once."""
    number = {t: i for i, t in enumerate(items.terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in parts([t or "" for t in texts]):
                n, found = [], []
                for text in texts[part]:
                    words = terms_of(text)
                    n.append(len(words))
                    found.append([(number[t], c) for t, c in Counter(words).items() if t in number])
                arrays = [pa.array([[f[k] for f in row] for row in found], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(n, pa.int64()), *arrays], ["doc_id", "n", "terms", "tf"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<int>")
    return cut(found.withColumn("row", F.monotonically_increasing_id()))


@dataclass
class Weights:
    """What scores need beside a document: number of documents and terms, and the weight of each of the items' terms."""

    n_docs: int
    n_terms: int
    df: np.ndarray
    weight: np.ndarray


def weights_of(found: DataFrame, items: Items) -> Weights:
    """The statistics of all documents; the driver gets two numbers and one for each of the items' terms."""
    n, total = found.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.terms), dtype=np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["t"]] = r["df"]
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()]
    return Weights(n, total, df, np.array(weight, dtype=np.int64))


@dataclass
class Shard:
    """Documents as rows of a sparse matrix of what each term adds to a score."""

    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def shard_of(n: np.ndarray, terms: pa.Array, tf: pa.Array, w: Weights) -> Shard:
    sizes = np.diff(terms.offsets.to_numpy())
    start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    term, times = terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)
    length = np.repeat(25 + (75 * n * w.n_docs) // max(w.n_terms, 1), sizes)
    return Shard(start, term, w.weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * length)))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices from each start on, so many each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def rare_terms(items: Items, w: Weights) -> np.ndarray:
    """Which entries of ``items.term`` are rare terms of their item."""
    owner = np.repeat(np.arange(len(items.ids)), np.diff(items.start))
    order = np.lexsort((w.df[items.term], owner))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order)) - items.start[owner[order]]
    return (place < RARE_LEAST) | (w.df[items.term] * RARE_SHARE <= w.n_docs)


def lower_limits(found: DataFrame, items: Items, w: Weights) -> np.ndarray:
    """For each item the tenth best score that rare terms alone give, 1 where fewer documents have any."""
    rare = np.flatnonzero(rare_terms(items, w))
    rare = rare[np.argsort(items.term[rare], kind="stable")]
    owner = np.repeat(np.arange(len(items.ids)), np.diff(items.start))[rare]
    term, times, n_items = items.term[rare], items.times[rare], len(items.ids)
    first = np.searchsorted(term, np.arange(len(items.terms) + 1))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // n_items)
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                s = shard_of(b.column(0).to_numpy(), b.column(1), b.column(2), w)
                many = first[s.term + 1] - first[s.term]
                asked = ranges(first[s.term], many)
                cell = np.repeat(s.doc, many) * n_items + owner[asked]
                # Scores are far below 2 ** 53, so sums of doubles are exact.
                score = np.bincount(cell, weights=np.repeat(s.value, many) * times[asked], minlength=b.num_rows * n_items).reshape(b.num_rows, n_items)
                top = np.sort(score, axis=0)[-TOP:].astype(np.int64)
                rows, columns = np.nonzero(top)
                yield pa.RecordBatch.from_arrays([pa.array(columns), pa.array(top[rows, columns])], ["item", "score"])

    rows = found.where(F.size("terms") > 0).select("n", "terms", "tf").mapInArrow(best, "item long, score long")
    tenth = rows.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("place") <= TOP)
    out = np.ones(n_items, dtype=np.int64)
    for r in tenth.where(F.col("place") == TOP).collect():
        out[r["item"]] = max(1, r["score"])
    return out


def with_signature(found: DataFrame, n_terms: int, w: Weights) -> DataFrame:
    """Add ``signature``: on which side of each of random hyperplanes a document is."""
    planes = np.random.default_rng(13).choice([-1.0, 1.0], size=(n_terms, PLANES))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.select(["n", "terms", "tf"])
            out = np.zeros(batch.num_rows, dtype=np.int64)
            for at in range(0, batch.num_rows, SHARD):
                part = b.slice(at, SHARD)
                s = shard_of(part.column(0).to_numpy(), part.column(1), part.column(2), w)
                sums = np.add.reduceat(planes[s.term] * s.value[:, None], s.start[:-1]) > 0
                out[at : at + SHARD] = sums @ (1 << np.arange(PLANES - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "signature"])

    return found.select("row", "doc_id", "n", "terms", "tf").mapInArrow(sign, "row long, doc_id long, n long, terms array<int>, tf array<int>, signature long")


@dataclass
class Lists:
    """Posting lists of a shard: list t holds ``doc[start[t]:start[t + 1]]`` in order of signature, and no value above ``most[t]``."""

    start: np.ndarray
    doc: np.ndarray
    most: np.ndarray


def lists_of(s: Shard, n_terms: int) -> Lists:
    order = np.argsort(s.term, kind="stable")
    start = np.searchsorted(s.term[order], np.arange(n_terms + 1))
    most = np.zeros(n_terms, dtype=np.int64)
    np.maximum.at(most, s.term, s.value)
    return Lists(start, s.doc[order], most)


def lists_to_walk(items: Items, most: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which entries of ``items.term`` an item has to walk: documents with only the others stay below its limit.

    The others are the terms of the least bounds that together cannot reach the limit.
    """
    owner = np.repeat(np.arange(len(items.ids)), np.diff(items.start))
    bound = items.times * most[items.term]
    order = np.lexsort((bound, owner))
    total = np.cumsum(bound[order])
    before = np.concatenate([[0], total])[items.start[:-1]]
    out = np.zeros(len(order), dtype=bool)
    out[order] = total - before[owner[order]] >= limit[owner[order]]
    return out & (bound > 0)


def summaries(s: Shard, lists: Lists, terms: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of some posting lists: first entry of each list's blocks, members as (start, end) in ``lists.doc``, and a row of coordinatewise maxima each."""
    many = -(-(lists.start[terms + 1] - lists.start[terms]) // BLOCK)
    first = np.concatenate([[0], np.cumsum(many)])
    begin = np.repeat(lists.start[terms], many) + BLOCK * (np.arange(first[-1]) - np.repeat(first[:-1], many))
    end = np.minimum(begin + BLOCK, np.repeat(lists.start[terms + 1], many))
    member = lists.doc[ranges(begin, end - begin)]
    block = np.repeat(np.arange(len(begin)), end - begin)
    size = s.start[member + 1] - s.start[member]
    entry = ranges(s.start[member], size)
    most = np.zeros(len(begin) * n_terms, dtype=np.int64)
    np.maximum.at(most, np.repeat(block, size) * n_terms + s.term[entry], s.value[entry])
    return first, np.stack([begin, end], axis=1), most.reshape(len(begin), n_terms)


def candidates(s: Shard, items: Items, limit: np.ndarray) -> dict[int, np.ndarray]:
    """For each item the documents in blocks that may hold a score of its limit or more."""
    n_terms = len(items.terms)
    lists = lists_of(s, n_terms)
    walk = np.flatnonzero(lists_to_walk(items, lists.most, limit))
    owner = np.repeat(np.arange(len(items.ids)), np.diff(items.start))
    walk = walk[np.argsort(items.term[walk], kind="stable")]
    terms, place = np.unique(items.term[walk], return_inverse=True)
    blocks = -(-(lists.start[terms + 1] - lists.start[terms]) // BLOCK)
    group = (np.cumsum(blocks) - blocks) // max(1, CELLS // max(n_terms, 1))
    found: dict[int, list[np.ndarray]] = {}
    for g in np.unique(group):
        inside = np.flatnonzero(group == g)
        first, members, most = summaries(s, lists, terms[inside], n_terms)
        for k in np.flatnonzero(group[place] == g):
            item, t = int(owner[walk[k]]), int(place[k] - inside[0])
            asked = slice(items.start[item], items.start[item + 1])
            bound = most[first[t] : first[t + 1]][:, items.term[asked]] @ items.times[asked]
            open_ = members[first[t] : first[t + 1]][bound >= limit[item]]
            if len(open_):
                found.setdefault(item, []).append(lists.doc[ranges(open_[:, 0], open_[:, 1] - open_[:, 0])])
    return {item: np.unique(np.concatenate(docs)) for item, docs in found.items()}


def scores(s: Shard, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Scores of documents for an item; ``asked`` says for each term how often the item has it."""
    size = s.start[docs + 1] - s.start[docs]
    entry = ranges(s.start[docs], size)
    ends = np.cumsum(size)
    return np.add.reduceat(s.value[entry] * asked[s.term[entry]], ends - size)


def search(docs: DataFrame, items: Items) -> DataFrame:
    """The ten best documents of each item: ``item`` (its number), ``rank``, ``doc_id`` and ``score``."""
    found = vectors(docs, items)
    w = weights_of(found, items)
    limit = lower_limits(found, items, w)
    held = found.where(F.size("terms") > 0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                b = batch.slice(at, SHARD)
                ids, known = b.column(0).fill_null(0).to_numpy(), b.column(0).is_valid().to_numpy(zero_copy_only=False)
                s = shard_of(b.column(1).to_numpy(), b.column(2), b.column(3), w)
                for item, of in candidates(s, items, limit).items():
                    asked = np.zeros(len(items.terms), dtype=np.int64)
                    own = slice(items.start[item], items.start[item + 1])
                    asked[items.term[own]] = items.times[own]
                    score = scores(s, of, asked)
                    of, score = of[score >= limit[item]], score[score >= limit[item]]
                    top = np.lexsort((ids[of], known[of], -score))[:TOP]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(top), pa.int64()), pa.array(ids[of[top]], mask=~known[of[top]]), pa.array(score[top])], ["item", "doc_id", "score"])

    # Copies have one signature; the row deals them to several ranges.
    dealt = with_signature(held, len(items.terms), w).repartitionByRange("signature", "row").sortWithinPartitions("signature", "row")
    each = dealt.select("doc_id", "n", "terms", "tf").mapInArrow(best, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best of ``docs`` (``doc_id``, ``text``) for each row of ``items`` (``item_id``, ``text``).

    Items are searched in blocks of about ``ITEM_BYTES`` of their texts, so the driver and the tasks hold one block's terms at a time.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // ITEM_BYTES)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select(F.col("item_id").cast("long"), "text")
        block = items_of([(r["item_id"], r["text"]) for r in mine.collect()])
        if block.terms:
            ids = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
            out = out.unionByName(search(docs, block).join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each ``benchmark`` item.

    A null text has no terms; items without terms have no rows.  Repeated documents rank side by side, a null ``doc_id`` before
    others of equal score.  Repeated items and items of a null id are items like others.  Without documents there are no rows.
    """
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same by scoring every document.
ORACLE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
total AS (SELECT count(*) AS n, sum(len(ts)) AS l FROM texts WHERE len(ts) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM texts) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
m AS (SELECT r, doc_id, (25 + (75 * len(ts) * n) // l)::BIGINT AS m FROM texts, total),
asked AS (SELECT i, item_id, unnest(ts) AS t FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark)),
scores AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
