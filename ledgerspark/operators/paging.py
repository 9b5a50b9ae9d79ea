"""Deep pages (L6, M4, A22, A23): find the range of keys that holds a page by counting, and sort only that.

A page far behind would have each task sort and send all rows before it.  Here rows are counted by ranges of the full sort key, between
keys that a hash picks; the ranges that hold the page are cut again until few rows are left, and only these are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that are counted at once, and rows that are few enough to sort in one task, beside the page.
RANGES, FEW = 256, 20_000


def narrowed(rows: DataFrame, order: list[str], offset: int, size: int, few: int = FEW) -> tuple[DataFrame, int]:
    """The rows of a range of keys (``order``, ascending, null first) that holds the page, and the offset of the page in it.

    ``order`` must tell rows apart, or rows that it does not tell apart must be equal.  The driver gets 256 counts and keys a round.
    """
    key, kinds = F.struct(*order), dict(rows.dtypes)
    scope, left = rows, None
    while left is None or left > max(few, 4 * size):
        picked = scope.select(*order).orderBy(F.xxhash64(*order), *order).limit(RANGES - 1).distinct().orderBy(*order).collect()
        bounds = [F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in order]) for r in picked]
        if not bounds:
            break
        place = F.size(F.filter(F.array(*bounds), lambda b: b <= key))
        counts = {r["place"]: r["count"] for r in scope.groupBy(place.alias("place")).count().collect()}
        before, first, last, seen = 0, None, 0, 0
        for p in sorted(counts):
            if first is None and seen + counts[p] > offset:
                first, before = p, seen
            seen += counts[p]
            if first is not None:
                last = p
                if seen >= offset + size:
                    break
        if first is None:  # behind the last row
            return scope.limit(0), 0
        chosen = seen - before
        if left is not None and chosen >= left:
            break
        inside = F.lit(True)
        # the first column on its own reaches the scan; null goes before all
        if first > 0:
            low = picked[first - 1][order[0]]
            inside = inside & (key >= bounds[first - 1]) & (F.lit(True) if low is None else F.col(order[0]) >= low)
        if last < len(bounds):
            high = picked[last][order[0]]
            inside = inside & (key < bounds[last]) & (F.col(order[0]).isNull() if high is None else F.col(order[0]).isNull() | (F.col(order[0]) <= high))
        scope, offset, left = scope.where(inside), offset - before, chosen
    return scope, offset


def deep_page(rows: DataFrame, order: list[str], number: int, size: int, descending: bool = True, few: int = FEW) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in the order of all columns of ``order``, one way."""
    offset = (number - 1) * size
    if descending:
        total = rows.count()
        start = max(total - offset - size, 0)
        size = min(size, max(total - offset, 0))
        offset = start
    if size <= 0:
        return rows.limit(0)
    scope, rest = narrowed(rows, order, offset, size, few)
    page = scope.orderBy(*order).offset(rest).limit(size)
    return page.orderBy(*[F.desc(c) for c in order]) if descending else page


def newest_page(rows: DataFrame, order: list[str], number: int, size: int, deep: int = 100_000) -> DataFrame:
    """A page in descending order of all columns of ``order``: near ones by each task's first rows, from row ``deep`` on by ranges.  Both give the same rows."""
    if (number - 1) * size >= deep:
        return deep_page(rows, order, number, size)
    return rows.orderBy(*[F.desc(c) for c in order]).offset((number - 1) * size).limit(size)
