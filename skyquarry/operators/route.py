"""Fewest jumps through the implicit graph of systems within range of each other.

Level by level, all of a frontier at once: the systems that have any of the frontier within range, less what
was reached before. Where that compares too many systems with each other, boxes around them are compared
first. Levels are cut off from each other by reliable checkpoints. From which system each stop was reached
is looked up on the way back alone. Where the number of jumps is bounded, systems too far from the start for
the jumps made, or from the goal for the jumps left, are pruned.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .cut import cut
from .spatial import Boxed, boxed, near_any, near_any_boxed, tiled, to_point

#: Pairs that a level compares at most without boxes.
FEW = 600_000_000
#: Systems from which on a route is first sought near the straight line.
MANY = 100_000


def levels(systems: DataFrame, start: int, range_ly: float, *, goal: int | None = None, max_jumps: int | None = None) -> DataFrame:
    """address, hop, x, y, z of every system reached from ``start``; of the level that has ``goal``, the last, only the goal."""
    places = _places(systems)
    starts, ends, _ = _ends(places, start, goal)
    return reduce(DataFrame.unionByName, _levels(places, starts, range_ly, None if goal is None else ends, max_jumps, goal == start)[0])


def _places(systems: DataFrame) -> DataFrame:
    return systems.filter(F.col("x").isNotNull()).select("address", "x", "y", "z")


def _ends(places: DataFrame, start: int, goal: int | None) -> tuple[list[Row], list[Row], int]:
    """The rows of the start's address, those of the goal's that have a whole position, and how many there are of all."""
    either = F.col("address").isin([a for a in (start, goal) if a is not None])
    # rows of two addresses
    rows, n = places.agg(F.collect_set(F.when(either, F.struct(*places.columns))), F.count(F.lit(1))).first()
    return [r for r in rows if r.address == start], [r for r in rows if r.address == goal and None not in r], n


def _local(places: DataFrame, rows: list[tuple], schema: StructType) -> DataFrame:
    """Few rows as literals, which need no Python worker."""
    spark = places.sparkSession
    if not rows:
        return spark.createDataFrame([], schema)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _near(rows: list[Row], reach: float) -> Column:
    return reduce(or_, [to_point(r[1:]) <= reach for r in rows], F.lit(False))


def _slack(way: float) -> float:
    """More than rounding adds to a way of that length."""
    return 1e-9 + 1e-12 * way


def _labelled(level: DataFrame, hop: int) -> DataFrame:
    return level.select("address", F.lit(hop).alias("hop"), "x", "y", "z")


def _levels(places: DataFrame, starts: list[Row], range_ly: float, ends: list[Row] | None, max_jumps: int | None, there: bool) -> tuple[list[DataFrame], bool]:
    """The levels, a frame each, and whether the last is the goal's; ``ends`` are its rows, and ``there`` if it is the start."""
    frontier = _local(places, starts, places.schema)
    found, hop = [_labelled(frontier, 0)], 0
    if there or ends == []:
        return found, there
    bounded, whole = bool(ends) and max_jumps is not None and range_ly > 0, [r for r in starts if None not in r]
    rows = places
    if bounded:
        slack = _slack(range_ly * max_jumps)
        # jumps along straight lines; rows that aren't at finite places are dropped below
        jumps = [F.ceil((reduce(F.least, [to_point(r[1:]) for r in of]) - 2 * slack) / range_ly) for of in (whole, ends) if of]
        # few and near each other, but compared with many: one core for all would be slow
        rows = places.filter(reduce(F.try_add, jumps) <= max_jumps).repartition(places.sparkSession.sparkContext.defaultParallelism, *places.columns)
    grid, boxes, crowd = cut(tiled(rows.distinct(), range_ly)), None, None
    size, last_two = grid.count(), frontier
    while max_jumps is None or hop < max_jumps:
        n, *hit = frontier.agg(F.count(F.lit(1)), *[F.bool_or(to_point(e[1:]) <= range_ly) for e in ends or []]).first()
        if not n:
            break
        hop += 1
        if any(hit):
            return [*found, _labelled(_local(places, [e for e, h in zip(ends, hit) if h], places.schema), hop)], True
        front, here, pairs = tiled(frontier, range_ly), grid, n * size
        if bounded:
            here = grid.filter(_near(whole, range_ly * hop + slack) & _near(ends, range_ly * (max_jumps - hop) + slack))
            pairs = pairs if pairs <= FEW else n * here.count()
        elif pairs > FEW:
            crowd = crowd or grid.groupBy("block").count().agg(F.max("count")).first()[0]
            pairs = min(pairs, n * 27 * crowd)
        if pairs <= FEW:
            met = near_any(here, front, range_ly)
        else:
            boxes = boxed(here) if bounded else boxes or Boxed(grid, *map(cut, boxed(grid)[1:]))
            met = near_any_boxed(boxes, boxed(front), range_ly)
        # what is near a level lies in it, the one before or the next
        before = last_two.select([F.col(c).alias("_" + c) for c in last_two.columns])
        last_two, frontier = frontier, cut(met.join(before, [F.col(c).eqNullSafe(F.col("_" + c)) for c in met.columns], "left_anti"))
        last_two = last_two.unionByName(frontier)
        found.append(_labelled(frontier, hop))
    return found, False


def _shortest(places: DataFrame, start: int, goal: int, range_ly: float, max_jumps: int | None) -> list[DataFrame]:
    """The levels from the start to the goal; none if it can't be reached.

    Of many systems, few lie near enough to both ends for as many jumps as a straight line takes, or for one more: these are tried
    first, then all without such a bound.
    """
    starts, ends, n = _ends(places, start, goal)
    away = [d for a in starts if None not in a for b in ends if math.isfinite(d := math.dist(a[1:], b[1:]))]
    tries = []
    if n >= MANY and away and range_ly > 0:
        least = max(1, math.ceil((min(away) - _slack(min(away))) / range_ly))
        tries = [jumps for jumps in (least, least + 1) if max_jumps is None or jumps < max_jumps]
    for most in [*tries, max_jumps]:
        found, there = _levels(places, starts, range_ly, ends, most, goal == start)
        if there:
            return found
    return []


def route(systems: DataFrame, start: int, goal: int, range_ly: float, *, max_jumps: int | None = None) -> DataFrame:
    """route, hop, address, x, y, z of the stops; no row if the goal can't be reached.

    Of the shortest routes the one that comes from least addresses. The walk back takes one row a jump.
    """
    places = _places(systems)
    stops, near = [], F.lit(True)
    for level in reversed(_shortest(places, start, goal, range_ly, max_jumps)):
        if (stop := level.filter(near).orderBy("address", "x", "y", "z").first()) is None:
            break
        stops.append(stop)
        near = to_point(stop[2:]) <= range_ly
    path = _local(places, stops, _labelled(places, 0).schema)
    return path.select(F.lit(0).alias("route"), "hop", "address", "x", "y", "z")


def hops(systems: DataFrame, start: int, goal: int, range_ly: float) -> DataFrame:
    """goal, jumps; no row if it can't be reached."""
    places = _places(systems)
    found = _shortest(places, start, goal, range_ly, None)
    last = found[-1] if found else _labelled(places, 0).limit(0)
    return last.groupBy(F.col("address").alias("goal")).agg(F.min("hop").alias("jumps"))


def message(stops: DataFrame, start: str, goal: str, range_ly: str) -> DataFrame:
    """What is said of a route that couldn't be plotted; null if it could."""
    said = f"No route from {start} to {goal} at {range_ly} Ly"
    return stops.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") < 2, said).alias("message"))
