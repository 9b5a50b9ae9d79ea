"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined, then one exchange.

Rows get a 63-bit sort key: the upper 40 bits come from a hash of the text, the lower 23 bits from a
hash of the row's id and of its number among rows that are equal in both.  Equal texts are therefore neighbours, yet a
very large group of copies still has boundaries inside it, even one of equal ids or none.  The driver keeps only histograms, whose size does not depend on the input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut, numbered, table

KEY_BITS, ID_BITS, STEP_BITS = 63, 23, 10


@dataclass
class Splitters:
    """Boundaries between shards, and the cells of the key space that were refined to find them.

    ``bounds[i]`` is the first key of shard i + 1.  ``refined[bits]`` holds the cells, as key prefixes
    that drop ``bits`` low bits, which were counted again in smaller cells.
    """

    bounds: list[int]
    refined: dict[int, list[int]] = field(default_factory=dict)


def key_of(text_hash: Column, *row: Column) -> Column:
    """Copies of one text are neighbours; within them rows follow a hash of what tells them apart."""
    of_text = F.shiftrightunsigned(text_hash, 1 + ID_BITS)
    of_row = F.shiftrightunsigned(F.xxhash64(*row, F.lit("row")), 1 + KEY_BITS - ID_BITS)
    return F.shiftleft(of_text, ID_BITS).bitwiseOR(of_row)


def sort_key(text: Column, *row: Column) -> Column:
    return key_of(F.xxhash64(F.coalesce(text, F.lit(""))), *row)


def find_splitters(keyed: DataFrame, shards: int, tolerance: float = 0.002, group_slack: float = 0.05, cell_share: float = 4 / 1024) -> Splitters:
    """Find shard boundaries over ``keyed`` (columns ``key`` and ``size``) by counting exact bytes.

    Each pass counts bytes and rows in the cells around every boundary that is still open, and in
    cells with more than ``cell_share`` of all rows, by cells 1024 times smaller.  A boundary is settled
    at the nearer edge of its cell once that cell holds at most ``tolerance`` of a shard's bytes, one row
    only, or one group of equal texts of at most ``group_slack`` of a shard's bytes; larger groups are
    divided.  At most ``shards + 1/cell_share`` cells are refined in a pass, so what the driver sees is bounded.
    """
    bits = KEY_BITS - STEP_BITS
    found = keyed.groupBy(F.shiftright("key", bits).alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    cells = sorted((r["cell"], r["bytes"], r["n"]) for r in found)
    total, rows = sum(c[1] for c in cells), sum(c[2] for c in cells)
    goals = {i: total * i / shards for i in range(1, shards)}
    out, bounds, below = Splitters([]), {}, {None: 0}
    while True:
        parents: dict[int | None, list[tuple[int, int, int]]] = {}
        for c in cells:
            parents.setdefault(None if not out.refined else c[0] >> (prior - bits), []).append(c)
        start, refine = {}, set()
        for parent, inside in parents.items():
            at = below[parent]
            for cell, size, n in inside:
                start[cell] = at
                if n > max(1, cell_share * rows):
                    refine.add(cell)
                for i, goal in goals.items():
                    if i not in bounds and at <= goal < at + size:
                        group = bits <= ID_BITS + STEP_BITS // 2 and size <= group_slack * total / shards
                        if size <= tolerance * total / shards or n == 1 or group or not bits:
                            bounds[i] = (cell if goal - at <= at + size - goal else cell + 1) << bits
                        else:
                            refine.add(cell)
                at += size
        if not refine or not bits:
            break
        out.refined[bits] = sorted(refine)
        below = {c: start[c] for c in refine}
        prior, bits = bits, max(0, bits - STEP_BITS)
        part = keyed.where(F.shiftright("key", prior).isin(out.refined[prior]))
        found = part.groupBy(F.shiftright("key", bits).alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        cells = sorted((r["cell"], r["bytes"], r["n"]) for r in found)
    last = 0
    for i in range(1, shards):
        last = max(last, bounds.get(i, 1 << KEY_BITS))
        out.bounds.append(min(last, (1 << KEY_BITS) - 1))
    return out


def shard_of(key: Column, splitters: Splitters) -> Column:
    """Number of boundaries at or below the key."""
    shard = F.lit(0)
    for bound in splitters.bounds:
        shard = shard + (key >= F.lit(bound)).cast("int")
    return shard


def cell_of(key: Column, splitters: Splitters) -> Column:
    """First key of the smallest counted cell that holds the key; every cell lies in one shard."""
    levels = sorted(splitters.refined)
    finest = max(0, (levels[0] if levels else KEY_BITS) - STEP_BITS)
    cell = F.shiftleft(F.shiftright(key, finest), finest)
    for bits in levels:
        coarse = F.shiftleft(F.shiftright(key, bits), bits)
        cell = F.when(F.shiftright(key, bits).isin(splitters.refined[bits]), cell).otherwise(coarse)
    return cell


def histogram_sort(rows: DataFrame, splitters: Splitters) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard, in key order) to rows with a ``key``.

    The rows are exchanged once, by cell: cells are small, so neither a hot group nor the number of
    shards limits how many tasks take part.  A cell's first slot comes from the counts of its shard's
    cells.  Ties of the key are ordered by all other columns.
    """
    placed = rows.withColumns({"shard": shard_of(F.col("key"), splitters), "cell": cell_of(F.col("key"), splitters)})
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    others = [F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in rows.columns])))]
    within = Window.partitionBy("shard", "cell").orderBy("key", *others)
    numbered = placed.withColumn("in_cell", F.row_number().over(within) - 1)
    return numbered.join(first, ["shard", "cell"]).withColumn("slot", (F.col("first_slot") + F.col("in_cell")).cast("long")).drop("cell", "first_slot", "in_cell")


def write_shards(rows: DataFrame, path: str) -> None:
    """Write sharded rows as one folder for each shard, ordered by slot."""
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents in shards 0 to 23 of near equal bytes (law ``bytes``).

    A null text counts as empty (size 8, crc32 0).  Repeated rows are all kept.  Groups of equal texts of up to a twentieth of a shard stay
    in one shard; larger ones are divided, whether their ids differ, repeat or are null.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = cut(
        table(spark, sf_dir, "documents").select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit("again"), text, F.col("doc_id").isNull(), "doc_id").alias("h2"),
        )
    )
    rows = cut(numbered(sized, "h1", "h2").select("doc_id", "size", "text_crc32", key_of(F.col("h1"), F.col("h2"), F.col("number")).alias("key")))
    placed = histogram_sort(rows, find_splitters(rows, shards))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
