"""Latest rows, legs and neighbours along a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import LIGHT_YEAR, distance

SOLID = 0.35
DASH = 0.5 * LIGHT_YEAR


def latest(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def legs(stops: DataFrame, key: str = "route") -> DataFrame:
    """``stops`` (route, hop, address, x, y, z) with the distance from the stop before, null at the first."""
    w = Window.partitionBy(key).orderBy("hop")
    before = [F.lag(c).over(w) for c in "xyz"]
    return stops.withColumn("leg", distance(F.col("x"), F.col("y"), F.col("z"), *before))


def pairs(stops: DataFrame, key: str = "route") -> DataFrame:
    w = Window.partitionBy(key).orderBy("hop")
    return stops.select(key, "hop", F.col("address").alias("origin"), F.lead("address").over(w).alias("destination")).filter("destination IS NOT NULL")


def report(stops: DataFrame, key: str = "route") -> DataFrame:
    """Jumps, length of the path and straight distance of each route."""
    made = legs(stops, key).groupBy(key).agg(F.count(F.lit(1)).alias("stops"), F.sum("leg").alias("path"), F.min(F.struct("hop", "x", "y", "z")).alias("a"), F.max(F.struct("hop", "x", "y", "z")).alias("b"))
    straight = distance(*[F.col(f"a.{c}") for c in "xyz"], *[F.col(f"b.{c}") for c in "xyz"])
    return made.select(key, (F.col("stops") - 1).alias("jumps"), F.coalesce("path", F.lit(0.0)).alias("path"), straight.alias("straight"))


def neighbours(stops: DataFrame, here: int, standing: float = 0.0) -> DataFrame:
    """address, way: the stops before and after ``here`` on the routes, the first answer for each address.

    A route counts by its first stop at ``here``; nothing while the system's own mark still stands.
    """
    by_route = Window.partitionBy("route").orderBy("hop")
    around = stops.select("route", "hop", "address", F.lag("address").over(by_route).alias("behind"), F.lead("address").over(by_route).alias("ahead"))
    first = latest(around.filter((F.col("address") == here) & F.lit(standing <= 0)), ["route"], [F.col("hop")])
    both = F.explode(F.array(F.struct(F.col("behind").alias("address"), F.lit(0).alias("turn"), F.lit("last").alias("way")), F.struct(F.col("ahead").alias("address"), F.lit(1).alias("turn"), F.lit("next").alias("way"))))
    rows = first.select("route", both.alias("stop")).select("route", "stop.*").filter("address IS NOT NULL")
    return latest(rows, ["address"], [F.col("route"), F.col("turn")]).select("address", "way")


def drawn_legs(stops: DataFrame, key: str = "route") -> DataFrame:
    """route, hop, part, start, end: what is drawn of each leg, as shares of it from its shown end.

    ``stops`` in metres with ``shown``. Both ends shown: all of it; one: the solid share, then dashes
    with a gap before each and a gap left at the end; none: nothing.
    """
    w = Window.partitionBy(key).orderBy("hop")
    ahead = [F.lead(c).over(w) for c in ("x", "y", "z", "shown")]
    leg = stops.select(key, "hop", "shown", ahead[3].alias("next_shown"), distance(F.col("x"), F.col("y"), F.col("z"), *ahead[:3]).alias("leg")).filter("next_shown IS NOT NULL AND (shown OR next_shown) AND (leg > 0 OR shown = next_shown)")
    dashes = F.floor((F.col("leg") - 2 * DASH - (F.col("leg") * SOLID + DASH)) / (2 * DASH) + 1e-9) + 1
    count = F.greatest(dashes, F.lit(0)).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    start = lambda i: F.col("leg") * SOLID + DASH + i * (2 * DASH)
    dashed = F.transform(steps, lambda i: F.struct((start(i) / F.col("leg")).alias("start"), ((start(i) + DASH) / F.col("leg")).alias("end")))
    whole = lambda end: F.array(F.struct(F.lit(0.0).alias("start"), F.lit(end).alias("end")))
    parts = F.when(F.col("shown") & F.col("next_shown"), whole(1.0)).otherwise(F.concat(whole(SOLID), dashed))
    return leg.select(key, "hop", F.posexplode(parts).alias("part", "line")).select(key, "hop", "part", "line.start", "line.end")
