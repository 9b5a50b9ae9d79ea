"""Spelling variant grouping: near words by pivotal grams, and the form and root of each word.

Two words are near if one code point inserted, deleted or replaced makes one the other.  Bigrams of all words stand in one
order, rarest first.  A word's prefix is its first three bigrams in that order; its pivots are two disjoint ones of these.  One
edit touches one pivot at most, so of two near words the one whose prefix ends first shares a pivot with the other one's
prefix (Deng, Li and Feng, A pivotal prefix based filtering algorithm for string similarity search, 2014).  Positions
say more: if the edit is behind the left pivot, all before it is equal; if not, all behind the right pivot is.  Index keys
are therefore the text up to the left pivot, or from the right one on, with the length of the other word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut, parts, table

LEAST_CHARS, LEAST_COUNT = 5, 3
#: One occurrence in so many loses a letter, by its checksum.
DAMAGED = 97
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
#: Bigrams in a prefix: one more than a single edit can destroy.
PREFIX = 3
#: How often a bigram of the prefix can stand before its copy in a near word, and in all: an edit adds two at most.
REPEATS = PREFIX + 2


def letter_table() -> bytes:
    """Latin-1 bytes to letters, A to Z as a to z, and anything else to blanks."""
    out = bytearray(b" " * 256)
    for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]:
        out[c] = c + 32 if c < 0x5B else c
    return bytes(out)


LETTERS = letter_table()


def damaged_counts(doc_id: str, text: str) -> Counter[str]:
    """The runs of letters of a text, with the damage that checksums of id and run decide, and how often each occurs."""
    out: Counter[str] = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    # every letter is one byte of Latin-1; other code points become a byte that is no letter
    for run, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split(b" ")).items():
        if not run:
            continue
        word = run.decode("latin-1")
        h = zlib.crc32(word.encode(), start)
        if h % DAMAGED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_CHARS:
            out[word] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """Words of at least five code points that occur at least three times: ``word``, ``n``.

    Counts are added up in each task before rows are exchanged, so frequent words are no hot keys.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in parts(texts):
                for doc_id, text in zip(ids[part], texts[part]):
                    held.update(damaged_counts(doc_id, text))
                if len(held) >= HELD:
                    yield out()
        yield out()

    found = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How many times each bigram occurs in distinct words; the alphabet has 90 letters, so there are at most 8,100."""
    letters = F.split("word", "")
    grams = F.zip_with(F.slice(letters, 1, F.length("word") - 1), F.slice(letters, 2, F.length("word") - 1), lambda a, b: F.concat(a, b))
    return {r["gram"]: r["n"] for r in words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}


def disjoint_pair(slots: list[tuple[int, int]]) -> tuple[int, int]:
    """Positions of two disjoint bigrams with the least total count, from slots (position, count) in order of position.

    Dynamic programming from left to right: ``one`` is the best single slot that ends before the present one begins, ``two`` the
    best pair so far.  Three bigrams at different places always have a disjoint pair.
    """
    one = two = held = None
    for at, cost in slots:
        far = held is not None and held[1] <= at - 2
        free = min((x for x in (one, held if far else None) if x), default=None)
        if free:
            two = min((x for x in (two, (free[0] + cost, free[1], at)) if x))
        one = min((x for x in (one, held) if x), default=None)
        held = (cost, at)
    assert two is not None
    return two[1], two[2]


def pivotal(word: str, rank: dict[str, int], count: dict[str, int]) -> tuple[list[int], list[int], int]:
    """The two pivots of a word, the positions of its prefix, and the rank of the last bigram in the prefix."""
    slots = sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))
    last = slots[PREFIX - 1][0]
    first = sorted((i, count[word[i : i + 2]]) for _, i in slots[:PREFIX])
    return list(disjoint_pair(first)), [i for r, i in slots[: PREFIX - 1 + REPEATS] if r <= last], last


def with_pivots(words: DataFrame) -> DataFrame:
    """Add ``pivots`` and ``prefix`` (positions from 0) and ``last`` to ``word``, ``n``."""
    count = gram_counts(words)
    rank = {g: i for i, g in enumerate(sorted(count, key=lambda g: (count[g], g)))}

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [pivotal(w, rank, count) for w in batch["word"]]
            yield batch.assign(pivots=[f[0] for f in found], prefix=[f[1] for f in found], last=[f[2] for f in found])

    return words.mapInPandas(choose, "word string, n long, pivots array<int>, prefix array<int>, last int")


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of near words once: ``a``, ``a_n``, ``b``, ``b_n``.  ``words`` is the result of :func:`with_pivots`."""
    size = F.length("word")

    def before(at: Column, length: Column) -> Column:
        return F.xxhash64(F.lit("<"), length, F.substring(F.col("word"), F.lit(1), at + 2))

    def behind(at: Column, length: Column) -> Column:
        return F.xxhash64(F.lit(">"), length, F.substring(F.col("word"), at + 1, size))

    lengths = F.array(size - 1, size, size + 1)
    asked = F.concat(F.transform(lengths, lambda n: before(F.col("pivots")[0], n)), F.transform(lengths, lambda n: behind(F.col("pivots")[1], n)))
    held = F.concat(F.transform("prefix", lambda p: before(p, size)), F.transform("prefix", lambda p: behind(p, size)))
    left = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"), F.explode(asked).alias("key"))
    right = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"), F.explode(held).alias("key"))
    met = left.join(right.hint("merge"), "key").where((F.col("a_last") <= F.col("b_last")) & (F.levenshtein("a", "b", 1) == 1))
    first = F.col("a") < F.col("b")
    one, other = F.struct("a", "a_n"), F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"))
    sides = met.select(F.when(first, one).otherwise(other).alias("x"), F.when(first, other).otherwise(one).alias("y"))
    return sides.distinct().select(F.col("x.a").alias("a"), F.col("x.a_n").alias("a_n"), F.col("y.a").alias("b"), F.col("y.a_n").alias("b_n"))


def roots(links: DataFrame) -> DataFrame:
    """The end of the chain of forms behind each word: ``word``, ``root`` for the rows of ``links`` (``word``, ``form``).

    Counts at least double at each link, so chains are short; each round halves what is left of them.
    """
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """Words of ``docs`` (``doc_id``, ``text``) with their near words counted, their form and their root."""
    words = cut(vocabulary(docs))
    pairs = near_pairs(cut(with_pivots(words)))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    strong = -F.col("best.less") >= 2 * F.col("n")
    found = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all whole documents, grouped by spelling.

    A null text has no words; a null ``doc_id`` counts as an empty one in checksums.  Repeated rows count each time.  Of near words
    that are equally frequent, the first in code-point order is the form.  Without documents there are no rows.
    """
    return variants(table(spark, sf_dir, "documents"))
