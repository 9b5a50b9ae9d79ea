"""Substring dedup: words under a window of 35 words that occurs twice go, found by super-k-mer partitioning.

Every window has a minimiser, the smallest hash of its grams of four words.  Consecutive windows of a text that share a
minimiser make a super-k-mer, one run of words.  Equal windows have equal minimisers, so they meet in the bucket of that value.
First each super-k-mer sends only its place and two hashes.  One that is alone in its bucket holds no repeated window; a bucket of equal
ones needs no sorting, for all their windows are repeated.  Only where a bucket holds different super-k-mers does one of each
kind travel to it, packed as a string with its number of occurrences, and sorting counts the windows exactly.

The super-k-mers of a bucket with more than ``LOAD`` windows are cut once more, by minimisers of ``LONG`` words, and these pieces meet in the
same way: one alone holds no repeat, equal ones are repeated as a whole.  Where different pieces meet, the 128-bit hashes of their windows
are summed up in each task before they are exchanged, so no bucket, group of copies or frequent passage falls to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut, parts, table
from ledgerspark.llm.minhash import _STEP, mix

#: Words of a window, and of a gram; a window has 32 grams, so that five halvings find the least of them.
WINDOW, GRAM = 35, 4
#: Words of a gram in large buckets; a window has 8 of them, a power of two too.
LONG = 28
#: Windows of one super-k-mer (longer runs, as one word said again and again, are cut), and of a bucket that is sorted in one task.
LONGEST, LOAD = 256, 20_000
#: Bytes of texts whose words are held at once; few enough to stay in a core's cache.
PART = 1 << 18
#: Odd factors of the two polynomial hashes of word sequences.
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, one after the other, and the number of words of each text.

    ``bytes.split`` cuts at ASCII white space, x09 to x0D and x20, and nothing else.
    """
    split = [t.split() for t in texts]
    n = np.array([len(w) for w in split], dtype=np.int64)
    flat = np.empty(int(n.sum()), dtype=object)
    flat[:] = [w for words in split for w in words]
    return pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64), n


def sequence_hashes(word: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the words from ``start`` up to ``end``, wherever the sequence stands."""
    out = []
    for k, (base, inverse) in enumerate(zip(_BASES, _INVERSES)):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(word), base)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(word), inverse)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(word + np.uint64(k)) * power[:-1], dtype=np.uint64)])
        out.append(mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _STEP))
    return out


def super_kmers(word: np.ndarray, n: np.ndarray, size: int = GRAM) -> dict[str, np.ndarray]:
    """Super-k-mers of texts with ``n`` words each, by grams of ``size`` words: ``text``, ``at`` (their first word), ``n`` (windows), ``bucket``, ``h1``, ``h2``, ``again``.

    ``again`` says that the minimiser occurs more than once, without which no window of a super-k-mer can be repeated inside it.
    """
    first, grams = np.cumsum(n) - n, WINDOW - size + 1
    windows = np.maximum(n - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(n)), windows)
    if not len(text):
        return {c: np.zeros(0, np.int64) for c in ("text", "at", "n", "bucket", "h1", "h2")} | {"again": np.zeros(0, bool)}
    gram = np.zeros(len(word) - size + 1, dtype=np.uint64)
    for j in range(size):
        gram = mix(gram + _STEP + word[j : len(gram) + j])
    least, step = gram, 1
    while step < grams:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    at = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(len(text))
    value = least[at]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
    began = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    new |= (np.arange(len(new)) - began) % LONGEST == 0
    starts = np.flatnonzero(new)
    many = np.diff(np.append(starts, len(new)))
    place, key = at[starts], value[starts]
    spans = many + grams - 1
    ends = np.cumsum(spans)
    inside = np.repeat(place - (ends - spans), spans) + np.arange(ends[-1])
    times = np.add.reduceat((gram[inside] == np.repeat(key, spans)).astype(np.int64), ends - spans)
    h1, h2 = sequence_hashes(word, place, place + many + WINDOW - 1)
    owner = text[starts]
    return {"text": owner, "at": place - first[owner], "n": many, "bucket": key.astype(np.int64), "h1": h1.astype(np.int64), "h2": h2.astype(np.int64), "again": times > 1}


def sized(texts: list[bytes]) -> Iterator[slice]:
    return parts(texts, PART)  # type: ignore[arg-type]


def places(texts: DataFrame) -> DataFrame:
    """Super-k-mers of all texts (``t1``, ``t2``, ``raw``): where they are, their bucket and hashes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, t1, t2 = batch.column(2).to_pylist(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in sized(raw):
                f = super_kmers(*split_words(raw[part]))
                owner = f["text"] + part.start
                columns = [t1[owner], t2[owner], f["at"].astype(np.int32), f["n"].astype(np.int32), f["bucket"], f["h1"], f["h2"], f["again"]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t1", "t2", "at", "n", "bucket", "h1", "h2", "again"])

    return texts.select("t1", "t2", "raw").mapInArrow(find, "t1 long, t2 long, at int, n int, bucket long, h1 long, h2 long, again boolean")


def packed(wanted: DataFrame) -> DataFrame:
    """The words of each super-k-mer in ``kmers`` of a text (``raw``), as one string."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, kmers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = raw.split()
                rows = [(k["bucket"], k["h1"], k["h2"], k["w"], b" ".join(words[k["at"] : k["at"] + k["n"] + WINDOW - 1])) for k in kmers]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 4, pa.binary()])], ["bucket", "h1", "h2", "w", "words"])

    # With the id, these texts are exchanged as those from which words are removed, and so once for both.
    return wanted.select("raw", "kmers", "doc_id").mapInArrow(pack, "bucket long, h1 long, h2 long, w long, words binary")


def pieces(wanted: DataFrame) -> DataFrame:
    """The super-k-mers in ``kmers`` of a text (``raw``), cut by minimisers of ``LONG`` words: ``first`` (window of the super-k-mer that begins the
    piece), ``sub`` (the minimiser), ``s`` (a hash of the piece's words), ``again`` and two hashes of each window, ``k1`` and ``k2``.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, kmers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                column = {c: np.array([k[c] for k in kmers], dtype=np.int64) for c in ("bucket", "h1", "h2", "w", "at", "n")}
                n = column["n"] + WINDOW - 1
                begin = np.cumsum(n) - n
                word = split_words([raw])[0][np.repeat(column["at"] - begin, n) + np.arange(n.sum())]
                f = super_kmers(word, n, LONG)
                ends = np.cumsum(f["n"])
                start = np.repeat(begin[f["text"]] + f["at"] - (ends - f["n"]), f["n"]) + np.arange(ends[-1])
                edges = np.concatenate([[0], ends]).astype(np.int32)
                keys = [pa.ListArray.from_arrays(edges, h.astype(np.int64)) for h in sequence_hashes(word, start, start + WINDOW)]
                own = [column[c][f["text"]] for c in ("bucket", "h1", "h2", "w")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, [*own, f["at"].astype(np.int32), f["bucket"], f["h1"], f["again"]]), *keys], ["bucket", "h1", "h2", "w", "first", "sub", "s", "again", "k1", "k2"])

    return wanted.select("raw", "kmers", "doc_id").mapInArrow(split, "bucket long, h1 long, h2 long, w long, first int, sub long, s long, again boolean, k1 array<long>, k2 array<long>")


def repeated(strings: list[bytes], weights: list[int]) -> list[list[int]]:
    """For each packed string the offsets of its windows that occur more than once; a string counts as often as its weight says."""
    windows = []
    for s, string in enumerate(strings):
        words = string.split()
        windows += [(b" ".join(words[i : i + WINDOW]), s, i) for i in range(len(words) - WINDOW + 1)]
    windows.sort()
    out: list[list[int]] = [[] for _ in strings]
    for _, same in groupby(windows, key=lambda w: w[0]):
        found = list(same)
        if sum(weights[s] for _, s, _ in found) > 1:
            for _, s, i in found:
                out[s].append(i)
    return out


def sorted_buckets(strings: DataFrame) -> DataFrame:
    """Repeated windows of each packed string: ``bucket``, ``h1``, ``h2`` and ``offsets``.  A bucket is whole in a task, at most ``LOAD`` windows."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for bucket, group in groupby(rows, key=lambda r: r["bucket"]):
            members = list(group)
            found = [(r["h1"], r["h2"], o) for r, o in zip(members, repeated([r["words"] for r in members], [r["w"] for r in members])) if o]
            if found:
                h1, h2, offsets = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(h1), pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(offsets, pa.list_(pa.int32()))], ["bucket", "h1", "h2", "offsets"])

    return strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort, "bucket long, h1 long, h2 long, offsets array<int>")


def meeting(cuts: DataFrame) -> DataFrame:
    """Those of the :func:`pieces` that can hold a repeated window, as ``p``; ``whole`` if all windows of a piece are repeated."""
    # One column of all that branches take from a piece, so that pieces are made and exchanged once.
    once = cuts.groupBy("bucket", "h1", "h2", "first").agg(F.first(F.struct("w", "sub", "s", "again", "k1", "k2")).alias("p")).withColumn("sub", F.col("p.sub"))
    shared = once.groupBy("bucket", "sub").agg(F.sum("p.w").alias("all"), F.min("p.s").alias("low"), F.max("p.s").alias("high"), F.max("p.again").alias("again_any")).where("all > 1 or again_any")
    return once.join(shared.hint("merge"), ["bucket", "sub"]).select("bucket", "h1", "h2", "first", "p", F.expr("all > 1 and low = high").alias("whole"))


def counted_windows(cuts: DataFrame) -> DataFrame:
    """As :func:`sorted_buckets`, from the :func:`pieces` of buckets of any size: by the hashes of windows where different ones meet."""
    met = meeting(cuts)
    each = met.where("not whole").select("bucket", "h1", "h2", "first", "p.w", F.posexplode(F.arrays_zip("p.k1", "p.k2")).alias("i", "k")).select("bucket", "h1", "h2", "w", (F.col("first") + F.col("i")).alias("i"), "k.k1", "k.k2")
    twice = each.groupBy("k1", "k2").agg(F.sum("w").alias("all")).where(F.col("all") > 1).select("k1", "k2")
    some = each.join(twice.hint("merge"), ["k1", "k2"]).select("bucket", "h1", "h2", F.array("i").alias("offsets"))
    whole = met.where("whole").select("bucket", "h1", "h2", F.sequence("first", F.col("first") + F.size("p.k1") - 1).alias("offsets"))
    return some.unionByName(whole).groupBy("bucket", "h1", "h2").agg(F.flatten(F.collect_list("offsets")).alias("offsets"))


def repeated_windows(texts: DataFrame) -> DataFrame:
    """For each text with a repeated window ``marks``, its super-k-mers and the offsets of such windows in them (null: all): ``t1``, ``t2``, ``marks``.

    ``texts`` has ``doc_id``, ``t1``, ``t2`` and ``raw``, one row for each document; copies count as often as they are there.
    """
    every = places(texts)
    # A bucket of one super-k-mer, in whose words the minimiser is not repeated, has no window twice.
    buckets = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("again").alias("again_any")).where("m > 1 or again_any")
    mixed = (F.col("low") != F.col("high")) | (F.col("m") == 1)
    found = cut(every.join(buckets.hint("merge"), "bucket").select("bucket", "h1", "h2", "t1", "t2", "at", "n", mixed.alias("mixed")))
    kinds = found.where("mixed").groupBy("bucket", "h1", "h2").agg(F.count(F.lit(1)).alias("w"), F.min(F.struct("t1", "t2", "at", "n")).alias("place"))
    loads = kinds.groupBy("bucket").agg((F.sum("place.n") > LOAD).alias("large"))

    def wanted(which: str) -> DataFrame:
        own = kinds.join(loads.where(which).hint("merge"), "bucket").select("place.t1", "place.t2", F.struct("place.at", "place.n", "bucket", "h1", "h2", "w").alias("k"))
        return texts.join(own.groupBy("t1", "t2").agg(F.collect_list("k").alias("kmers")).hint("merge"), ["t1", "t2"])

    # Every copy of a text packs its strings and cuts its pieces; equal ones are one again before they travel.
    offsets = sorted_buckets(packed(wanted("not large")).dropDuplicates(["bucket", "h1", "h2"])).unionByName(counted_windows(pieces(wanted("large"))))
    whole = found.where("not mixed").select("t1", "t2", "at", "n", F.lit(None).cast("array<int>").alias("offsets"))
    some = found.where("mixed").join(offsets.hint("merge"), ["bucket", "h1", "h2"]).select("t1", "t2", "at", "n", F.array_sort("offsets").alias("offsets"))
    return whole.unionByName(some).groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "n", "offsets")).alias("marks"))


def kept_words(raw: bytes, marks: list[dict] | None) -> tuple[int, int, bytes]:
    """Number of words of a text, how many are under a marked window, and the others joined by one space."""
    words = raw.split()
    if not marks:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for m in marks:
        if m["offsets"] is None:
            edge[m["at"]] += 1
            edge[m["at"] + m["n"] - 1 + WINDOW] -= 1
        else:
            start = m["at"] + np.array(m["offsets"])
            edge[start] += 1
            edge[start + WINDOW] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def text_keys() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("again"), text).alias("t2")]


def without_repeats(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text``) with ``n_words``, ``n_removed`` and ``kept``, the words that stay joined by one space."""
    texts = docs.select("doc_id", *text_keys(), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    marked = texts.join(repeated_windows(texts).hint("merge"), ["t1", "t2"], "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1)
            sizes = raw.to_pylist()
            for part in sized(sizes):
                rows = [kept_words(r, m) for r, m in zip(sizes[part], batch.column(2)[part.start : part.stop].to_pylist())]
                n, gone, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return marked.select("doc_id", "raw", "marks").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words under windows of 35 words that occur twice anywhere, the same document included.

    A null text has no words; repeated rows and rows of a null id are documents like others, so equal texts of 35 words and more lose
    all of them.  Without documents there are no rows.
    """
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: The same with every window as a string.
ORACLE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM texts WHERE len(ws) >= 35),
twice AS (SELECT r, i FROM (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k FROM starts) QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM twice)),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM texts),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)
"""
