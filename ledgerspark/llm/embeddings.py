"""Embedding near-duplicates: a forest of random-projection trees with spill.

Each tree splits the vectors by random directions at about the median, over and over, until leaves are small or tight;
vectors near a cut go to both sides.  Vectors that share a leaf of any tree are compared exactly, in
double precision.  A pair counts in the first leaf that it shares, so no pair is counted twice, and tasks return sums
and one link for each vector and leaf, never all pairs.

A crowd of vectors within half the limit's angle of one direction is a ball: any two of them are linked, by the triangle
inequality, so its links are counted and not compared, and only its other neighbours are looked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut, hash_sample, table
from ledgerspark.llm.graph import components

COSINE = 0.9
#: Trees at least; deep trees need more of them, see ``trees_for``.
TREES, SEED = 6, 5
#: Vectors that the trees are grown on at most, and that a leaf shall hold; all vectors are put in leaves.
SAMPLE, LEAF = 20_000, 1000
#: Half the width of the band around a cut that goes to both sides, as a share of the typical projected distance of a pair at the limit.
SPILL = 0.25
#: Share of the pairs at the limit that one cut with this band parts, and the share that all trees together may part.
PARTED, MISSED = 0.07, 0.002
#: Vectors of a leaf that are compared in one block.
BLOCK = 1024


@dataclass
class Tree:
    """Directions, cuts and children by node; leaves have a negative first child, minus their number less one."""

    directions: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    spill: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` and the numbers of their leaves, one pair for each leaf that a row is in."""
        rows, found, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            left, right = self.children[node]
            if left < 0:
                rows.append(at)
                found.append(np.full(len(at), -left - 1))
                continue
            p = x[at] @ self.directions[node] - self.cuts[node]
            todo += [(left, at[p <= self.spill]), (right, at[p > -self.spill])]
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def trees_for(n: int) -> int:
    """Trees that keep the expected share of missed pairs at the limit below ``MISSED``, however deep ``n`` vectors make them."""
    depth = max(0.0, np.log2(max(n, 1) / LEAF))
    return max(TREES, int(np.ceil(np.log(MISSED) / np.log1p(-min((1 - PARTED) ** depth, 1 - 1e-9)))))


def grow(x: np.ndarray, scale: float, least: float, rng: np.random.Generator, first_leaf: int) -> tuple[Tree, int, list[np.ndarray]]:
    """Grow a tree on unit vectors ``x``, each of which stands for ``scale`` vectors; also the next leaf number.

    Leaves that cannot be cut though they stand for more than ``LEAF`` vectors are returned too, as rows of ``x``.
    """
    d = x.shape[1]
    spill = SPILL * np.sqrt(2 - 2 * least) / np.sqrt(d)
    directions, cuts, children, leaf, crowded = [np.zeros(d)], [0.0], [[0, 0]], first_leaf, []
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        part = x[at]
        center = part.sum(axis=0)
        norm = np.linalg.norm(center)
        tight = norm > 0 and (part @ (center / norm)).min() >= np.sqrt((1 + least) / 2)
        direction = rng.normal(size=d)
        direction /= np.linalg.norm(direction)
        p = part @ direction
        cut_at = np.quantile(p, rng.uniform(0.45, 0.55)) if len(at) else 0.0
        left, right = at[p <= cut_at + spill], at[p > cut_at - spill]
        if len(at) * scale <= LEAF or len(at) < 8 or tight or max(len(left), len(right)) > 0.9 * len(at):
            children[node] = [-leaf - 1, -leaf - 1]
            leaf += 1
            if len(at) * scale > LEAF:
                crowded.append(at)
            continue
        directions[node], cuts[node], children[node] = direction, cut_at, [len(cuts), len(cuts) + 1]
        todo += [(len(cuts), left), (len(cuts) + 1, right)]
        directions += [np.zeros(d)] * 2
        cuts += [0.0] * 2
        children += [[0, 0], [0, 0]]
    return Tree(np.array(directions), np.array(cuts), np.array(children), spill), leaf, crowded


def balls_of(x: np.ndarray, crowded: list[np.ndarray], scale: float, least: float) -> np.ndarray:
    """Centers of balls, one a row: directions with more than ``LEAF`` vectors within half the angle of the limit, each from one crowded leaf."""
    half, centers = np.sqrt((1 + least) / 2), []
    for at in crowded:
        center = np.median(x[at], axis=0)
        for _ in range(3):
            near = x[at] @ center >= half * np.linalg.norm(center)
            if near.any():
                center = x[at][near].mean(axis=0)
        norm = np.linalg.norm(center)
        if norm > 0 and (x @ (center / norm) >= half).sum() * scale > LEAF and all(c @ (center / norm) < half for c in centers):
            centers.append(center / norm)
    return np.array(centers).reshape(-1, x.shape[1])


@dataclass
class Forest:
    """Trees and ball centers by number of dimensions, and for each large leaf the vectors of each ball in it (-1: of none)."""

    trees: dict[int, list[Tree]]
    balls: dict[int, tuple[int, np.ndarray]]
    least: float
    crowds: dict[int, dict[int, int]]

    def ball(self, x: np.ndarray) -> np.ndarray:
        """Number of each vector's ball, the nearest that it is within; -1 for none."""
        first, centers = self.balls.get(x.shape[1], (0, np.zeros((0, x.shape[1]))))
        if not len(centers):
            return np.full(len(x), -1)
        cosine = x @ centers.T
        best = cosine.argmax(axis=1)
        return np.where(cosine[np.arange(len(x)), best] >= np.sqrt((1 + self.least) / 2) + 1e-9, first + best, -1)

    def meetings(self, leaf: int, ball: int) -> tuple[int, int, list[int]]:
        """In a large leaf, the first block and the number of blocks of a ball's vectors, and the blocks that these meet: all but their own ball's."""
        sizes, at, meets, own = self.crowds[leaf], 0, [], (0, 1)
        for b in sorted(sizes):
            k = -(-sizes[b] // BLOCK)
            if b == ball:
                own = (at, k)
            if b != ball or b < 0:
                meets += range(at, at + k)
            at += k
        return *own, meets

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves of vectors of one length, ordered by row and leaf; without trees one leaf holds them all."""
        trees = self.trees.get(x.shape[1])
        if not trees:
            return np.arange(len(x)), np.full(len(x), (1 << 30) + x.shape[1])
        rows, found = (np.concatenate(a) for a in zip(*(t.leaves(x) for t in trees)))
        order = np.lexsort((found, rows))
        return rows[order], found[order]


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else the squares of tiny or huge components have no place in a double
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Not null nor empty, all components finite, one of them not zero."""
    x = F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return fine & F.exists(x, lambda v: v != 0)


def fit(vectors: DataFrame, kind: str, least: float = COSINE, sample: int = SAMPLE) -> Forest:
    """Grow the trees on at most ``sample`` vectors, first in hash order of their ids.

    ``vectors`` has ``vec``, ``raw`` (bytes of type ``kind``) and ``n`` dimensions.  The driver holds the sample and the
    trees, both bounded.
    """
    total = {r["n"]: r["count"] for r in vectors.groupBy("n").count().orderBy(F.desc("count")).limit(16).collect()}
    rows = hash_sample(vectors.select("n", "raw", "vec"), sample, "vec").collect()
    rng, trees, balls, leaf, ball = np.random.default_rng(SEED), {}, {}, 0, 0
    for n in sorted(total):
        part = [bytes(r["raw"]) for r in rows if r["n"] == n]
        if len(part) >= 64:
            x, scale, crowded = unit(part, kind), total[n] / len(part), []
            trees[n] = []
            for _ in range(trees_for(total[n])):
                tree, leaf, full = grow(x, scale, least, rng, leaf)
                trees[n].append(tree)
                crowded += full
            balls[n] = (ball, balls_of(x, crowded, scale, least))
            ball += len(balls[n][1])
    return Forest(trees, balls, least, {})


def by_length(raw: pd.Series, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of each number of dimensions in a batch."""
    sizes = raw.map(len).to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, unit(raw.iloc[at].tolist(), kind)


def count_leaves(vectors: DataFrame, forest: Forest, kind: str) -> dict[int, dict[int, int]]:
    """Vectors by ball of the leaves that hold more than ``BLOCK``; leaves and balls are bounded by the trees."""
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, x in by_length(b["raw"], kind):
                rows, leaf = shared.value.leaves(x)
                ball = shared.value.ball(x)[rows]
                pair, n = np.unique(np.stack([leaf, ball]), axis=1, return_counts=True)
                yield pd.DataFrame({"leaf": pair[0].astype("int64"), "ball": pair[1].astype("int64"), "size": n.astype("int64")})

    sizes = vectors.select("raw").mapInPandas(count, "leaf long, ball long, size long").groupBy("leaf", "ball").agg(F.sum("size").alias("size"))
    whole = sizes.groupBy("leaf").agg(F.sum("size").alias("all"), F.collect_list(F.struct("ball", "size")).alias("each")).where(F.col("all") > BLOCK)
    return {r["leaf"]: {e["ball"]: e["size"] for e in r["each"]} for r in whole.collect()}


def placed(vectors: DataFrame, forest: Forest, kind: str) -> DataFrame:
    """A row for each vector and leaf, with its block, the block it meets (``g2`` <= ``g3``), its ball, and all its leaves.

    In a large leaf a vector gets a row for each block that its own meets; a ball's blocks do not meet each other.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, known = shared.value, {}
        for b in batches:
            for at, x in by_length(b["raw"], kind):
                rows, leaf = forest.leaves(x)
                ball = forest.ball(x)
                ends = np.searchsorted(rows, np.arange(len(at) + 1))
                lists = [leaf[s:e].astype("<i4").tobytes() for s, e in zip(ends[:-1], ends[1:])]
                vec = b["vec"].to_numpy()[at][rows]
                block, times, other = np.zeros(len(rows), dtype=np.int64), np.ones(len(rows), dtype=np.int64), [np.zeros(1, dtype=np.int64)] * len(rows)
                hashed = pd.util.hash_array(vec)
                for i in np.flatnonzero(np.isin(leaf, list(forest.crowds))).tolist():
                    key = (int(leaf[i]), int(ball[rows[i]]))
                    if key not in known:
                        first, k, meets = forest.meetings(*key)
                        known[key] = first, k, np.array(meets, dtype=np.int64)
                    first, k, other[i] = known[key]
                    block[i], times[i] = first + int(hashed[i] % np.uint64(k)), len(other[i])
                again = np.repeat(np.arange(len(rows)), times)
                met = np.concatenate(other) if other else np.zeros(0, dtype=np.int64)
                out = b.iloc[at[rows[again]]][["vec", "copies", "raw"]].reset_index(drop=True)
                out["leaf"], out["block"], out["ball"] = leaf[again].astype("int64"), block[again], ball[rows[again]].astype("int64")
                out["g2"], out["g3"] = np.minimum(block[again], met), np.maximum(block[again], met)
                out["leaves"] = [lists[r] for r in rows[again].tolist()]
                yield out[["leaf", "g2", "g3", "block", "ball", "vec", "copies", "raw", "leaves"]]

    return vectors.select("vec", "copies", "raw").mapInPandas(place, "leaf long, g2 long, g3 long, block long, ball long, vec long, copies long, raw binary, leaves binary")


def compare(group: pd.DataFrame, kind: str, least: float) -> pd.DataFrame:
    """Of one group, each vector's number of linked copies and the smallest vector of its component in the group; without links inside balls."""
    group = group.sort_values("vec", kind="stable")
    x, vec, ball = unit(group["raw"].tolist(), kind), group["vec"].to_numpy(), group["ball"].to_numpy()
    link = x @ x.T >= least
    np.fill_diagonal(link, False)
    if (ball >= 0).any():
        link &= (ball[:, None] != ball[None, :]) | (ball[:, None] < 0)
    if group["g2"].iloc[0] != group["g3"].iloc[0]:  # two blocks: pairs of one block are compared on their own
        block = group["block"].to_numpy()
        link &= block[:, None] != block[None, :]
    some = np.flatnonzero(link.any(axis=1))
    if not len(some):
        return pd.DataFrame({"vec": vec[:0], "links": vec[:0], "root": vec[:0]})
    link, vec, group = link[np.ix_(some, some)], vec[some], group.iloc[some]
    lists = [np.frombuffer(b, dtype="<i4") for b in group["leaves"]]
    owner, leaf = np.repeat(np.arange(len(lists)), [len(s) for s in lists]), np.concatenate(lists)
    before = leaf < group["leaf"].iloc[0]
    if before.any():
        column = np.unique(leaf[before], return_inverse=True)[1]
        earlier = np.zeros((len(lists), column.max() + 1), dtype=np.float32)
        earlier[owner[before], column] = 1
        link &= earlier @ earlier.T == 0
    label, n = np.arange(len(vec)), len(vec)
    while link.any():
        low = np.minimum(label, np.where(link, label[None, :], n).min(axis=1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    out = pd.DataFrame({"vec": vec, "links": link @ group["copies"].to_numpy(), "root": vec[label]})
    return out[out["links"] > 0]


def ball_links(vectors: DataFrame, forest: Forest, kind: str) -> DataFrame:
    """``vec``, ``links`` and ``root`` of the vectors in balls: all others of the ball, whose sums come from one row a task and ball."""
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("long")
    def ball(raw: pd.Series) -> pd.Series:
        out = np.full(len(raw), -1, dtype=np.int64)
        for at, x in by_length(raw, kind):
            out[at] = shared.value.ball(x)
        return pd.Series(out)

    inside = vectors.select("vec", "copies", ball("raw").alias("ball")).where("ball >= 0")
    whole = inside.groupBy("ball").agg(F.sum("copies").alias("all"), F.min("vec").alias("root"))
    return inside.join(F.broadcast(whole), "ball").select("vec", (F.col("all") - F.col("copies")).alias("links"), "root")


def links(rows: DataFrame, kind: str, least: float = COSINE) -> DataFrame:
    """``vec``, ``links`` and ``root`` from each group of ``placed`` rows; a task takes one group after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for b in batches:
            b = b if waiting is None else pd.concat([waiting, b], ignore_index=True)
            key = b[["leaf", "g2", "g3"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(b) else [0]
            for s, e in zip(starts[:-1], starts[1:]):
                yield compare(b.iloc[s:e], kind, least)
            waiting = b.iloc[starts[-1] :]
        if waiting is not None and len(waiting):
            yield compare(waiting, kind, least)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "leaf", "g2", "g3").sortWithinPartitions("leaf", "g2", "g3")
    return dealt.mapInPandas(run, "vec long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """Links and component of each row of ``vectors`` (``vec_id``, ``embedding``): ``vec_id``, ``n_links``, ``component_id``.

    Unusable vectors (null, empty, zero, or with a null or non-finite component) link with nothing and are their own component.
    Vectors of different lengths are never linked.  Equal vectors are put in leaves once and counted as often as they occur.
    Rows of a repeated id are nodes of their own; a null id is a node too, and a component of null ids only has the
    component null.  An empty table gives no rows; other columns are not looked at.
    """
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    array = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")

    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype=kind).tobytes() for v in x], dtype="object")

    fine = usable(F.col("embedding"))
    same = [F.when(fine, F.xxhash64(array)).alias("h1"), F.when(fine, F.xxhash64(F.lit("again"), array)).alias("h2")]
    rows = cut(vectors.select("vec_id", *same))
    each = vectors.where(fine).select("vec_id", array.alias("array"), *same)
    once = each.groupBy("h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("array").alias("array"))
    # The numbers of distinct vectors hold as long as the table that is written here.
    reps = cut(once.select("h1", "h2", "least_id", "copies", F.monotonically_increasing_id().alias("vec"), F.size("array").alias("n"), packed("array").alias("raw")))
    forest = fit(reps, kind, least)
    forest.crowds = count_leaves(reps, forest, kind)
    found = links(placed(reps, forest, kind), kind, least)
    if any(len(c) for _, c in forest.balls.values()):
        found = found.unionByName(ball_links(reps, forest, kind))
    found = cut(found)
    counted = found.groupBy("vec").agg(F.sum("links").alias("links"))
    classes = components(found.where("vec != root").select(F.col("vec").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "vec")
    mine = reps.select("h1", "h2", "vec", "copies", "least_id").join(counted.hint("merge"), "vec", "left").join(classes.hint("merge"), "vec", "left")
    mine = cut(mine.withColumn("component", F.coalesce("component", "vec")))
    least_ids = mine.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = mine.join(least_ids.hint("merge"), "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return rows.join(named.hint("merge"), ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every row of ``embeddings``, whatever its label; see ``near_duplicates``."""
    found = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same links by comparing all pairs of vectors.
ORACLE_SQL = """
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (SELECT * FROM vectors WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
links AS (SELECT a, count(*) AS n FROM ways GROUP BY 1),
reached AS (SELECT vec_id AS a, vec_id AS b FROM vectors UNION SELECT r.a, w.b FROM reached r JOIN ways w ON w.a = r.b)
SELECT r.a AS vec_id, coalesce(any_value(n), 0) AS n_links, min(b) AS component_id, r.a = min(b) AS kept FROM reached r LEFT JOIN links l ON l.a = r.a GROUP BY r.a
"""
