"""Distance, radius and box searches in three dimensions, and the band join they scale by."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIGHT_YEAR = 9.4607304725808e15
LIGHT_SECOND = 2.99792458e8
# What is said when none, one, or more than two systems are picked for a route.
ENDS = ("Pick out two systems to plot between", "Pick out a second system to plot to", "A route runs between two systems for now")


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Null if a position is missing."""
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def between(a: str, b: str) -> Column:
    return distance(*[F.col(f"{a}.{c}") for c in "xyz"], *[F.col(f"{b}.{c}") for c in "xyz"])


def distance_or_zero(a: str, b: str) -> Column:
    """The form that answers 0 where a position is missing."""
    return F.coalesce(between(a, b), F.lit(0.0))


def to_point(point: tuple[float, float, float]) -> Column:
    return distance(F.col("x"), F.col("y"), F.col("z"), *[F.lit(float(v)) for v in point])


def in_box(df: DataFrame, point: tuple[float, float, float], half: float) -> DataFrame:
    """Rows of the box around a point, faces included; three ranges that reach the scan."""
    for c, v in zip("xyz", point):
        df = df.filter(F.col(c).between(v - half, v + half))
    return df


def near_point(df: DataFrame, point: tuple[float, float, float], radius: float) -> DataFrame:
    """Rows within the radius, inclusive; the box first, as only it can prune row groups."""
    return in_box(df, point, radius).filter(to_point(point) <= radius)


def position_of(df: DataFrame, name: str) -> tuple[float, float, float] | None:
    """Where the system of this name is; the least address if several have the name."""
    row = df.filter((F.col("name") == name.upper()) & F.col("x").isNotNull()).orderBy("address").select("x", "y", "z").first()
    return tuple(row) if row else None


def band_join(left: DataFrame, right: DataFrame, radius: float, *, prefix: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """All pairs within the radius, by an equi-join on grid cells as wide as the radius.

    A left row looks into 27 cells and a right row lies in one, so no pair comes twice. Rows without a position pair with nothing. At radius 0
    the cell is a position.
    """
    a, b = (df.filter(F.col("x").isNotNull()).select([F.col(c).alias(p + c) for c in df.columns]) for df, p in zip((left, right), prefix))
    p, q = prefix
    if radius <= 0:
        return a.join(b, [F.col(p + c) == F.col(q + c) for c in "xyz"]).withColumn("distance", F.lit(0.0))
    cell = lambda k: F.struct(*[F.floor(F.col(k + c) / radius).alias(c) for c in "xyz"])
    steps = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    around = F.transform(steps, lambda s: F.struct(*[F.try_add(F.col("_home")[c], s[c]).alias(c) for c in "xyz"]))
    looked = a.withColumn("_home", cell(p)).select("*", F.explode(around).alias("_cell"))
    d = distance(*[F.col(p + c) for c in "xyz"], *[F.col(q + c) for c in "xyz"])
    met = looked.join(b.withColumn("_of", cell(q)), F.col("_cell") == F.col("_of")).withColumn("distance", d).filter(F.col("distance") <= radius)
    return met.drop("_home", "_cell", "_of")


def tiled(df: DataFrame, radius: float) -> DataFrame:
    """Rows with the tile they lie in, a quarter of the radius wide, which of its eight parts, and its block of 125 tiles.

    Rows without a position, or with one that isn't finite, are near nothing and left out.
    """
    at = df.filter(" AND ".join(f"abs({c}) < DOUBLE('Infinity')" for c in "xyz"))
    side = max(radius / 4, 1e-6)
    tile = ", ".join(f"floor({c} / {side!r}D) AS {c}" for c in "xyz")
    part = " + ".join(f"pmod(floor({c} / {side / 2!r}D), 2) * {n}" for c, n in zip("xyz", (4, 2, 1)))
    # a point within the radius is at most five tiles away
    block = ", ".join(f"floor(tile.{c} / 5) AS {c}" for c in "xyz")
    return at.selectExpr("*", f"struct({tile}) AS tile", f"CAST({part} AS INT) AS part").selectExpr("*", f"struct({block}) AS block")


class Boxed(NamedTuple):
    """Tiled rows, and the boxes around what rows each tile and each part has."""

    rows: DataFrame
    tiles: DataFrame
    parts: DataFrame


def boxed(rows: DataFrame) -> Boxed:
    box = F.struct(*[f(c).alias(c + n) for c in "xyz" for f, n in ((F.min, "0"), (F.max, "1"))]).alias("box")
    return Boxed(rows, rows.groupBy("block", "tile").agg(box), rows.groupBy("tile", "part").agg(box))


def _around() -> Column:
    """The block and the 26 beside it, a row each."""
    steps = ", ".join(f"struct({i} AS x, {j} AS y, {k} AS z)" for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))
    return F.expr(f"explode(transform(array({steps}), s -> struct(block.x + s.x AS x, block.y + s.y AS y, block.z + s.z AS z)))")


def _positions() -> list[Column]:
    return [F.col(c).alias("_" + c) for c in "xyz"]


def _off() -> Column:
    return distance(*[F.col(c) for c in "xyz"], *[F.col("_" + c) for c in "xyz"])


def near_any(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """The rows of ``left`` with any of ``right`` within the radius, which both were tiled for; rows are compared with rows."""
    other = right.select(_around().alias("_block"), *_positions())
    return left.join(other, (F.col("block") == F.col("_block")) & (_off() <= radius), "left_semi").drop("tile", "part", "block")


def _apart(a: Column, b: Column, most: bool) -> Column:
    """Bounds on the distance of a row in box ``a`` from one in box ``b``; rounded as ``distance`` rounds, so they hold to the last bit."""
    gaps = [(a[c + "0"] - b[c + "1"], b[c + "0"] - a[c + "1"]) for c in "xyz"]
    dx, dy, dz = (F.greatest(-g, -h) if most else F.greatest(F.lit(0.0), g, h) for g, h in gaps)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def _needed(pairs: DataFrame, radius: float) -> DataFrame:
    """Of the pairs of boxes (a, a_box; b, b_box) those to look into: all that may hold rows within the radius, or one where all are."""
    pairs = pairs.filter(_apart(F.col("a_box"), F.col("b_box"), False) <= radius).withColumn("_most", _apart(F.col("a_box"), F.col("b_box"), True))
    sure = F.min(F.struct("_most", "b"))
    # a box meets at most 19 x 19 x 19 others
    met = pairs.groupBy("a").agg(sure.alias("_sure"), F.collect_list("b").alias("_all"))
    return met.select("a", F.explode(F.when(F.col("_sure._most") <= radius, F.array("_sure.b")).otherwise(F.col("_all"))).alias("b"))


def near_any_boxed(left: Boxed, right: Boxed, radius: float) -> DataFrame:
    """The same where rows are many, each once: boxes are compared before rows are, tiles first and then their parts.

    Where a whole box is within reach of another, one such pair stands for all; rows are compared only where
    boxes leave it open, so a dense crowd isn't multiplied out.
    """
    a = left.tiles.select(F.col("tile").alias("a"), F.col("box").alias("a_box"), "block")
    b = right.tiles.select(F.col("tile").alias("b"), F.col("box").alias("b_box"), _around().alias("block"))
    tiles = _needed(a.join(b, "block"), radius)
    a, b = (t.parts.select(F.col("tile").alias(k), F.struct("tile", "part").alias(k + "_part"), F.col("box").alias(k + "_box")) for t, k in ((left, "a"), (right, "b")))
    parts = tiles.join(a, "a").join(b, "b").select(F.col("a_part").alias("a"), "a_box", F.col("b_part").alias("b"), "b_box")
    looked = left.rows.withColumn("a", F.struct("tile", "part")).drop("tile", "part", "block").join(_needed(parts, radius), "a").drop("a")
    other = right.rows.select(F.struct("tile", "part").alias("_of"), *_positions())
    return looked.join(other, (F.col("b") == F.col("_of")) & (_off() <= radius), "left_semi").drop("b").distinct()


def nearest(df: DataFrame, point: tuple[float, float, float], reach: float) -> DataFrame:
    """The one nearest row within reach; the least address on a tie."""
    return near_point(df, point, reach).withColumn("distance", to_point(point)).orderBy("distance", "address").limit(1)


def settled(held: int | None, held_away: float | None, found: int | None, keep: float = 7.0) -> int | None:
    """Which system stays picked: one that was, until it is beyond ``keep``; else the one found."""
    return held if held is not None and held_away is not None and held_away <= keep else found


def framing(df: DataFrame) -> DataFrame:
    """Middle of the bounding box and the greatest distance from it; no row if nothing has a position."""
    box = df.filter(F.col("x").isNotNull()).agg(*[((F.min(c) + F.max(c)) / 2).alias(f"middle_{c}") for c in "xyz"])
    away = distance(F.col("x"), F.col("y"), F.col("z"), F.col("middle_x"), F.col("middle_y"), F.col("middle_z"))
    # the box is one row
    return df.filter(F.col("x").isNotNull()).crossJoin(F.broadcast(box)).groupBy("middle_x", "middle_y", "middle_z").agg(F.max(away).alias("extent"))


def picked_distance(picked: DataFrame) -> DataFrame:
    """Distance between the picked systems where they are exactly two; null otherwise."""
    ends = picked.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("address", "x", "y", "z")).alias("a"), F.max(F.struct("address", "x", "y", "z")).alias("b"))
    return ends.select(F.when(F.col("n") == 2, between("a", "b")).alias("distance"))


def route_ends(picked: DataFrame) -> DataFrame:
    """message: what keeps the picked systems from being the two ends of a route; null if nothing does."""
    n = picked.agg(F.count(F.lit(1)).alias("n"))
    said = F.when(F.col("n") == 0, ENDS[0]).when(F.col("n") == 1, ENDS[1]).when(F.col("n") > 2, ENDS[2])
    return n.select(said.alias("message"))


def light_years(metres: Column) -> Column:
    return metres / LIGHT_YEAR


def metres(light_years: Column) -> Column:
    return light_years * LIGHT_YEAR
