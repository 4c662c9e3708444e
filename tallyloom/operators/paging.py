"""Any page of a sorted list from one narrow range of it.

An index of a list of reviews counts them by ranges of the sort key. Ranges end at quantiles of the
key; reviews that share a key at such a point, of which there may be very many, are divided further
by quantiles of ``row_id``, and those without a key likewise. So no range holds much more than an
even share, however the keys are spread. Running counts tell which ranges a page lies in, and only
reviews of these are read and sorted: the work does not grow with the depth of the page.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.names import ROW_ID
from tallyloom.operators.browse import DEFAULT_SORT, SORTS, display_reviews, sort_key

# Ranges of the key, and of the ids of reviews that share one.
PARTS = 128


@dataclass(frozen=True)
class PageIndex:
    """Points of the key and of the ids, and the ranges in browsing order: (place, part, reviews).

    Place 2 i is the gap before point i, 2 i + 1 the point itself, -1 a missing key. Part counts
    ranges of ids, or is 0 for a gap.
    """

    sort: str
    points: tuple
    ids: tuple[int, ...]
    ranges: tuple[tuple[int, int, int], ...]

    @property
    def matches(self) -> int:
        return sum(n for _, _, n in self.ranges)

    def condition(self, place: int, part: int) -> Column:
        """The reviews of one range, in terms Spark can push to the files."""
        key, row = F.col(SORTS[self.sort][0]), F.col(ROW_ID)
        if place >= 0 and place % 2 == 0:
            i = place // 2
            low = key > self.points[i - 1] if i > 0 else key.isNotNull()
            return low & (key < self.points[i]) if i < len(self.points) else low
        own = key.isNull() if place < 0 else key == self.points[place // 2]
        if part > 0:
            own = own & (row > self.ids[part - 1])
        return own & (row <= self.ids[part]) if part < len(self.ids) else own

    def page(self, matches: DataFrame, page: int, size: int = 25) -> DataFrame:
        """Rows of one page of the list the index was made of, with their position."""
        start = (page - 1) * size
        ends = list(accumulate(n for _, _, n in self.ranges))
        first = bisect_right(ends, start)
        last = min(bisect_right(ends, start + size - 1), len(ends) - 1)
        chosen = self.ranges[first : last + 1]
        rows = matches.filter(F.lit(False))
        if chosen:
            wanted = self.condition(*chosen[0][:2])
            for place, part, _ in chosen[1:]:
                wanted = wanted | self.condition(place, part)
            rows = matches.filter(wanted)
        before = ends[first - 1] if first else 0
        order = sort_key(self.sort)[1]
        rows = rows.orderBy(*order).offset(start - before).limit(size)
        placed = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) + start)
        return display_reviews(placed, "position", ROW_ID).orderBy("position")


def store_list(matches: DataFrame, path: str) -> DataFrame:
    """Ids and sort keys of a list, stored once, so that indexes and pages in several orders don't make the list anew.

    A page of it has ids and keys; its texts are those of the reviews with these ids.
    """
    keys = dict.fromkeys(column for column, _ in SORTS.values())
    matches.select(ROW_ID, *keys).write.parquet(path)
    return matches.sparkSession.read.parquet(path)


def build_page_index(matches: DataFrame, sort: str = DEFAULT_SORT, parts: int = PARTS) -> PageIndex:
    """Two passes over the key and the ids; points and at most about parts squared counts come to the driver."""
    column, ascending = SORTS[sort]
    shares = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    cuts = matches.agg(
        F.expr(f"percentile_approx({column}, array({shares}), {100 * parts})").alias("points"),
        F.expr(f"percentile_approx({ROW_ID}, array({shares}), {100 * parts})").alias("ids"),
    ).first()
    points, ids = (tuple(sorted(set(cuts[c] or []))) for c in ("points", "ids"))
    key, row = F.col(column), F.col(ROW_ID)
    listed = F.array(*map(F.lit, points)) if points else F.array().cast("array<double>")
    at_most = F.size(F.filter(listed, lambda p: p < key))
    point = F.coalesce(F.array_contains(listed, key), F.lit(False))
    place = F.when(key.isNull(), -1).otherwise(at_most * 2 + point.cast("int"))
    own = F.array(*map(F.lit, ids)) if ids else F.array().cast("array<bigint>")
    part = F.when(key.isNull() | point, F.size(F.filter(own, lambda p: p < row))).otherwise(0)
    found = matches.groupBy(place.alias("place"), part.alias("part")).count().collect()
    direction = 1 if ascending else -1
    ranges = sorted(((r["place"], r["part"], r["count"]) for r in found), key=lambda r: (r[0] < 0, direction * r[0], r[1]))
    return PageIndex(sort, points, ids, tuple(ranges))
