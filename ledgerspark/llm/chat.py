"""Chat formatting: collapse cumulative snapshots, then render the conversations that remain.

Logs often hold a conversation several times, each time a few turns longer.  Every turn gets the hash of
all turns up to it; a conversation whose last hash is the hash of an inner turn of another one is a prefix
of it and goes.  Hashes are exclusive ors of 64-bit hashes of (position, role, text), two of them with
different salts, so that prefixes of any length are running totals and can be added up in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut, table

#: Turns of one conversation that are numbered in one task.
PART = 64


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the result has the left side's keys."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(F.col(f"__{k}"))
    return left.join(other, same, how).drop(*[f"__{k}" for k in keys])


def clean_turns(turns: DataFrame) -> DataFrame:
    """Turns with nulls filled in, and the two hashes of role and text."""
    named = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return named.withColumns({"own1": F.xxhash64("role", "text"), "own2": F.xxhash64(F.lit("second"), "text", "role")})


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """The hash of every prefix of every conversation: ``conv_id``, ``n_turns``, ``position`` (from 1), ``h1``, ``h2``.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``.  Turns stand by ``turn`` (null first), ties by hash; rows that
    repeat conversation, turn, role and text count once.  A null text is an empty one, a null role ``unknown``;
    rows with a null ``conv_id`` form one conversation.  Conversations are numbered in parts of ``PART`` turns,
    and the parts' counts and hashes are added, so one very long conversation does not bind one task.
    """
    parted = clean_turns(turns).select("conv_id", "turn", "own1", "own2", F.floor(F.coalesce("turn", F.lit(-1)) / PART).alias("part"))
    order = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "own1", "own2")
    row = F.struct("turn", "own1", "own2")
    unique = parted.withColumn("before", F.lag(row).over(order)).where(~F.col("before").eqNullSafe(row)).drop("before")
    local = cut(unique.withColumn("local", F.row_number().over(order)))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    placed = null_safe_join(local, base, ["conv_id", "part"]).withColumn("position", F.col("base") + F.col("local"))
    hashed = placed.select("conv_id", "part", "n_turns", "position", F.xxhash64("position", "own1").alias("a1"), F.xxhash64("own2", "position").alias("a2"))
    totals = hashed.groupBy("conv_id", "part").agg(F.bit_xor("a1").alias("t1"), F.bit_xor("a2").alias("t2"))
    carried = totals.select("conv_id", "part", *[F.coalesce(F.bit_xor(t).over(earlier), F.lit(0)).alias(c) for t, c in (("t1", "c1"), ("t2", "c2"))])
    upto = Window.partitionBy("conv_id", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = null_safe_join(hashed, carried, ["conv_id", "part"])
    return summed.select("conv_id", "n_turns", "position", *[F.col(c).bitwiseXOR(F.bit_xor(a).over(upto)).alias(h) for a, c, h in (("a1", "c1", "h1"), ("a2", "c2", "h2"))])


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that are no proper prefix of another: ``conv_id``, ``n_turns``, ``n_copies``.

    Of equal conversations the one with the smallest ``conv_id`` stands for all ``n_copies`` of them.
    """
    hashes = cut(prefix_hashes(turns))
    whole = hashes.where("position = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = hashes.where("position < n_turns").select(F.col("position").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """Add the text of each kept conversation: for each turn a line ``<|role|>`` and its text."""
    rows = null_safe_join(clean_turns(turns), kept.select("conv_id"), ["conv_id"], "left_semi")
    parts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "own1", "own2", "role", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("<|"), p["role"], F.lit("|>\n"), p["text"])), "\n")
    return null_safe_join(kept, parts.select("conv_id", text.alias("chat")), ["conv_id"])


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered maximal conversations: ``conv_id``, ``n_turns``, ``n_copies``, ``chat``.  An empty table gives no rows."""
    turns = table(spark, sf_dir, "conversations")
    return render(turns, cut(maximal(turns)))


ORACLE_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
whole AS (SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST) AS t,
    string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn NULLS FIRST) AS chat FROM turns GROUP BY conv_id),
inner_prefix AS (SELECT DISTINCT t[1:k] AS p FROM (SELECT t, unnest(range(1, n_turns)) AS k FROM whole)),
same AS (SELECT t, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies, min(chat) AS chat FROM whole GROUP BY t, n_turns)
SELECT conv_id, n_turns, n_copies, chat
FROM same WHERE NOT EXISTS (SELECT 1 FROM inner_prefix WHERE p = t)
"""
