"""Mixing sources to target weights: fixed-length blocks of words, drawn by index.

The words of a source's documents, one after another in hash order, are packed into blocks of
``block`` words.  The slots of the whole mix are dealt to output shards of equal size by a pseudorandom permutation of all
slots, so how many slots of each source a shard gets is drawn from the multinomial over the targets, given the sources'
totals (the multivariate hypergeometric law); the totals stay within one slot of their expectation.  The
slots of a source are numbered and mapped through a pseudorandom permutation of its block indices, a new
one for each pass over the source; slots and blocks are joined by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import WORD, cut, row_hashes, table, word_count

BLOCK, SHARDS, ROUNDS, CHUNK = 64, 16, 12, 1 << 13
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words of each source, from one row a source (``source``, ``source_size``).

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` times all words.
    Where a target would exceed ``most`` times its source, the source stops there and the rest is shared
    again: with sources ordered by size over weight, the first k stop, for the least k at which the next one
    does not.  Adds ``source_no``, ``weight`` and ``target``.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    upto = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    before, all_rows = upto.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    numbered = sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1)).cast("double"))
    level = weighed.withColumns({
        "stopped": F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "all_words": F.sum("source_size").over(all_rows) * share,
    }).withColumn("level", (F.col("all_words") - F.col("stopped")) / F.col("open_weight"))
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * most
    final = level.withColumn("final_level", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "source_no", "level"))).over(all_rows)["level"])
    target = F.least(F.col("source_size") * most, F.coalesce(F.col("final_level"), F.lit(float("inf"))) * F.col("weight"))
    return final.select("source", "source_no", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def permuted(index: Column, n: Column, seed: list[Column]) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, by swap-or-not rounds; the same seed gives the same one."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, *seed), n) - x, n)
        swap = F.xxhash64(r, F.greatest(x, partner), *seed, F.lit("bit")).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, turn)


def pack(sized: DataFrame, rows: int) -> DataFrame:
    """Give each row its word offset ``off`` in its source's stream.

    Rows (``order``, ``r1``, ``r2``, ``source_no``, ``size`` and others) stand in the order of these hashes.  A source's rows are dealt to
    buckets by hash; offsets within buckets and the running totals of buckets are added, so a source of any
    share of the rows is spread over many tasks.  ``rows`` is the number of rows.  Only rows of equal id, source and
    text share a bucket whatever their number.
    """
    placed = sized.withColumn("bucket", F.pmod("order", F.lit(max(16, rows // 2048))))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")).select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("order", "r1", "r2").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(start, ["source_no", "bucket"]).withColumn("off", F.col("start") + F.col("inside")).drop("order", "bucket", "inside", "start")


def draw(sources: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """Slots of the output: ``shard``, ``source_no``, ``block_no`` and the pass ``turn`` over the source.

    A source's expected slots are its target over its mean words a block.  Slot t takes the source whose
    stretch of the running expectations holds t plus a pseudorandom fraction, so totals are within one of what is expected.
    A permutation of all slots deals them to shards of equal size, within one slot: each shard's counts by source are drawn
    without replacement from all slots.  A source gets at most two slots for each of its blocks.
    """
    running = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.ceil(F.col("source_size") / block)
    expected = sources.where("source_size > 0").withColumn("n", n).withColumn("slots", F.col("target") * F.col("n") / F.col("source_size"))
    edges = expected.withColumn("upper", F.sum("slots").over(running)).withColumn("lower", F.col("upper") - F.col("slots"))

    def first(edge: str) -> Column:  # the first slot t with t + fraction(t) at or above the edge
        t = F.floor(edge)
        return t + (F.pmod(F.xxhash64(t, F.lit("draw")), F.lit(1 << 30)) / (1 << 30) < F.col(edge) - t).cast("long")

    spans = cut(edges.select("source_no", "n", first("lower").alias("from"), first("upper").alias("to")).withColumn("m", F.least(F.col("to") - F.col("from"), 2 * F.col("n"))).where("m > 0"))
    everything = spans.agg(F.coalesce(F.max("to"), F.lit(0))).first()[0]
    # The rows here are few, but each becomes up to CHUNK slots: the number of tasks follows from the number of slots.
    tasks = max(spans.sparkSession.sparkContext.defaultParallelism, -(-everything // CHUNK))
    chunks = spans.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CHUNK)))).repartition(tasks, "source_no", "chunk")
    last = F.least((F.col("chunk") + 1) * CHUNK, F.col("m")) - 1
    slots = chunks.withColumn("slot", F.explode(F.sequence(F.col("chunk") * CHUNK, last)))
    turn, total = F.floor(F.col("slot") / F.col("n")), F.lit(max(1, everything)).cast("long")
    shard = F.floor(permuted(F.col("from") + F.col("slot"), total, [F.lit("shards")]) * shards / total).cast("int")
    return slots.select(shard.alias("shard"), "source_no", permuted(F.col("slot") % F.col("n"), F.col("n"), [F.col("source_no"), turn]).alias("block_no"), turn.cast("int").alias("turn"))


def spans(packed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Join documents and drawn slots by block: a row for each piece of a document that a slot takes.

    Adds ``shard``, ``turn`` and the words [``word_from``, ``word_to``) of the document to the columns of
    ``packed``; pieces that no slot takes have null there.  Documents without words have no pieces.
    """
    blocks = F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block))
    pieces = packed.where("size > 0").withColumn("block_no", F.explode(blocks))
    start, end = F.col("block_no") * block, F.col("off") + F.col("size")
    taken = F.col("shard").isNotNull()
    # Slots come from few rows by explode, so the planner thinks them small; there are as many as pieces.
    return pieces.join(slots.hint("merge"), ["source_no", "block_no"], "left").withColumns({
        "word_from": F.when(taken, F.greatest(start, F.col("off")) - F.col("off")),
        "word_to": F.when(taken, F.least(start + block, end) - F.col("off")),
    })


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Sizes of all documents with their source's numbers, the sources, and the number of documents.

    ``docs`` has ``doc_id``, ``source`` and ``text``; its rows are known by two hashes of all columns (``r1``, ``r2``), and stand by one of
    these three (``order``), so that other columns do not change the mix.  Both tables are small against the texts and
    are kept in the shared folder.  The sources are broadcast where there are at most 100,000, else joined by key.
    """
    sized = cut(row_hashes(docs).select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("order"), "r1", "r2", word_count(F.col("text")).alias("size")))
    sources = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    known = sources.select(F.col("source").alias("named"), "source_no", "source_size", "target")
    known = F.broadcast(known) if sources.count() <= 100_000 else known
    return sized.join(known, F.col("source").eqNullSafe(F.col("named"))).drop("source", "named"), sources, sized.count()


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document.

    Null texts and texts without words have size 0 and are taken 0 times; null sources are one source, the
    last.  Repeated rows are all kept and stand side by side in their source's stream.  With no words at
    all, every target and every count is 0; an empty table gives no rows.  The same rows give the same mix.
    """
    sized, sources, rows = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    packed = pack(sized, rows)
    one = ["doc_id", "size", "source_size", "target"]
    taken = spans(packed, draw(sources)).groupBy("source_no", "off", *one).agg(F.sum(F.coalesce(F.col("word_to") - F.col("word_from"), F.lit(0))).cast("long").alias("taken"))
    return taken.select(*one, "taken").unionByName(sized.where("size = 0").select(*one, F.lit(0).cast("long").alias("taken")))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass over a source, the words taken of each row, as one text.

    ``docs`` has ``doc_id``, ``source``, ``text`` and any other columns; the result has the same.  A row that
    one pass takes whole keeps its text as it is.  Of others, the taken words keep the white space behind
    them.  Rows are told apart by all their columns, whatever their ids; each of several equal rows has pieces of its own.
    Rows without words are never taken.
    """
    sized, sources, rows = plan(docs)
    taken = spans(pack(sized, rows), draw(sources)).where("shard is not null")
    pieces = taken.groupBy("r1", "r2", "off", "size", "turn").agg(F.array_sort(F.collect_list(F.struct("word_from", "word_to"))).alias("mix_pieces"), F.sum(F.col("word_to") - F.col("word_from")).alias("mix_words"))
    keyed = pieces.select(F.col("r1").alias("mix_r1"), F.col("r2").alias("mix_r2"), F.col("size").alias("mix_size"), "mix_pieces", "mix_words")
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cuts = F.transform("mix_pieces", lambda p: F.array_join(F.slice("mix_all", p["word_from"].cast("int") + 1, (p["word_to"] - p["word_from"]).cast("int")), ""))
    # The words are named twice here, so that the optimizer does not move their making into each cut.
    text = F.when(F.col("mix_all").isNull(), F.col("text")).otherwise(F.array_join(cuts, ""))
    once = row_hashes(docs, ("mix_d1", "mix_d2"))
    if sized.groupBy("r1", "r2").count().where("count > 1").limit(1).count():  # equal rows: their pieces differ by offset, one of the rows is enough
        once = once.dropDuplicates(["mix_d1", "mix_d2"])
    same = (F.col("mix_d1") == F.col("mix_r1")) & (F.col("mix_d2") == F.col("mix_r2"))
    joined = once.join(keyed.hint("merge"), same).withColumn("mix_all", F.when(F.col("mix_words") < F.col("mix_size"), words))
    return joined.withColumn("text", text).select(*docs.columns)
