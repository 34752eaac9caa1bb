"""Orbital positions from recorded elements, through a hierarchy of bodies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS, SETTLED, ANCESTRY = 12, 1e-10, 16
STAND_IN = 1.5e12


def normalised(df: DataFrame) -> DataFrame:
    """Elements as they are used: a, e, angles in radians, and a period only where it turns."""
    period = F.col("orbital_period")
    return df.withColumns(
        {
            "a": F.greatest(F.col("semi_major_axis"), F.lit(0.0)),
            "e": F.least(F.greatest(F.col("eccentricity"), F.lit(0.0)), F.lit(0.99)),
            "inc": F.radians("inclination"), "peri": F.radians("periapsis"), "node": F.radians("ascending_node"), "mean": F.radians("mean_anomaly"),
            "period": F.when((period > 0) & (period < float("inf")), period),
        }
    )


def eccentric_anomaly(mean: Column, e: Column) -> Column:
    """Newton's method inside one higher-order function."""

    def turn(at: Column, _: Column) -> Column:
        missed = at - e * F.sin(at) - mean
        return F.when(F.abs(missed) < SETTLED, at).otherwise(at - missed / (1 - e * F.cos(at)))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), mean + e * F.sin(mean), turn)
    return F.when(e <= 0, mean).otherwise(solved)


def placed(anomaly: Column) -> tuple[Column, Column, Column]:
    """x, y, z on an orbit of ``normalised`` elements; the last two axes are swapped on the way out."""
    a, e, i, w, o = (F.col(c) for c in ("a", "e", "inc", "peri", "node"))
    u, v = a * (F.cos(anomaly) - e), a * F.sqrt(F.greatest(1 - e * e, F.lit(0.0))) * F.sin(anomaly)
    p, q = u * F.cos(w) - v * F.sin(w), u * F.sin(w) + v * F.cos(w)
    x = p * F.cos(o) - q * F.cos(i) * F.sin(o)
    y = p * F.sin(o) + q * F.cos(i) * F.cos(o)
    return x, q * F.sin(i), y


def positions(df: DataFrame, since: float) -> DataFrame:
    """``df`` with x, y, z about the parent, so many seconds after the elements' epoch."""
    flat = normalised(df)
    mean = F.when(F.col("period").isNotNull(), F.col("mean") + 2 * math.pi * since / F.col("period")).otherwise(F.col("mean"))
    flat = flat.withColumn("anomaly", eccentric_anomaly(mean, F.col("e")))
    still = F.coalesce(F.col("a") <= 0, F.lit(True))
    x, y, z = placed(F.col("anomaly"))
    return flat.withColumns({c: F.when(still, F.lit(0.0)).otherwise(v) for c, v in zip("xyz", (x, y, z))}).select(*df.columns, "x", "y", "z")


def paths(df: DataFrame, steps: int) -> DataFrame:
    """system_address, id, step, x, y, z around each orbit, evenly in eccentric anomaly; nothing under two steps."""
    flat = normalised(df).filter((F.col("a") > 0) & F.lit(steps >= 2)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(max(steps, 0)))))
    x, y, z = placed(F.col("step") * (2 * math.pi / max(steps, 1)))
    return flat.select("system_address", "id", "step", x.alias("x"), y.alias("y"), z.alias("z"))


def dashes(path: DataFrame, run: int) -> DataFrame:
    """The segments of a path that are drawn: runs of so many, alternately kept."""
    return path.filter(F.floor(F.col("step") / run) % 2 == 0)


def absolute(at: DataFrame) -> DataFrame:
    """``at`` (system_address, id, parent_id, x, y, z) summed up each ancestor chain, to its end or 16 levels."""
    tree = at.select("system_address", "id", "parent_id", "x", "y", "z")
    up = tree.select("system_address", F.col("id").alias("parent_id"), F.col("parent_id").alias("above"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    walk, level = tree, 1
    while level < ANCESTRY and walk.filter("parent_id IS NOT NULL").limit(1).count():
        met = walk.join(up, ["system_address", "parent_id"], "left")
        walk = met.select("system_address", "id", F.col("above").alias("parent_id"), *[(F.col(c) + F.coalesce(F.col(f"p{c}"), F.lit(0.0))).alias(c) for c in "xyz"])
        level += 1
    return walk.select("system_address", "id", "x", "y", "z")


def assembled(stars: DataFrame, bodies: DataFrame, centres: DataFrame) -> DataFrame:
    """The orbits of a system's contents: stars, bodies and those barycenters that something goes round.

    ``bodies`` have ``parent_ids``, nearest first; a centre's parent is what follows it in the chain
    of the first body that names it.
    """
    chain = bodies.select("system_address", "id", "parent_ids", F.posexplode("parent_ids").alias("pos", "centre"))
    first = chain.groupBy("system_address", "centre").agg(F.min_by(F.struct(F.get("parent_ids", F.col("pos") + 1).alias("next")), F.struct("id", "pos"))["next"].alias("parent_id"))
    ridden = centres.drop("parent_id").join(first.withColumnRenamed("centre", "id"), ["system_address", "id"])
    parent = lambda df: df.withColumn("parent_id", F.get("parent_ids", F.lit(0))).drop("parent_ids")
    return parent(stars).unionByName(parent(bodies), allowMissingColumns=True).unionByName(ridden, allowMissingColumns=True)


def primaries(stars: DataFrame) -> DataFrame:
    """The star of each system that ships arrive at."""
    return stars.groupBy("system_address").agg(F.min_by("id", F.struct("arrival", "id")).alias("primary_id"))


def about_primary(where: DataFrame, primary: DataFrame) -> DataFrame:
    """Absolute places less those of each system's primary; as they are without one."""
    middle = where.join(primary.withColumnRenamed("primary_id", "id"), ["system_address", "id"]).select("system_address", *[F.col(c).alias(f"m{c}") for c in "xyz"])
    return where.join(middle, "system_address", "left").select("system_address", "id", *[(F.col(c) - F.coalesce(F.col(f"m{c}"), F.lit(0.0))).alias(c) for c in "xyz"])


def extents(orbits: DataFrame, where: DataFrame, middle: DataFrame) -> DataFrame:
    """How far each system reaches from its middle: orbit centre, far end of the orbit, own radius; 1.5e12 m at least."""
    e = F.least(F.greatest(F.coalesce("eccentricity", F.lit(0.0)), F.lit(0.0)), F.lit(0.99))
    far = F.greatest(F.coalesce("semi_major_axis", F.lit(0.0)), F.lit(0.0)) * (1 + e)
    anchor = where.select("system_address", F.col("id").alias("parent_id"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    centre = where.join(middle.withColumnRenamed("primary_id", "id"), ["system_address", "id"]).select("system_address", *[F.col(c).alias(f"m{c}") for c in "xyz"])
    met = orbits.join(anchor, ["system_address", "parent_id"], "left").join(centre, "system_address", "left")
    d = [F.coalesce(F.col(f"a{c}"), F.lit(0.0)) - F.coalesce(F.col(f"m{c}"), F.lit(0.0)) for c in "xyz"]
    reach = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) + far + F.greatest(F.coalesce("radius", F.lit(0.0)), F.lit(0.0))
    good = met.select("system_address", reach.alias("reach")).filter((F.col("reach") > 0) & (F.col("reach") < float("inf")))
    return good.groupBy("system_address").agg(F.greatest(F.max("reach"), F.lit(STAND_IN)).alias("extent"))


def revision(df: DataFrame) -> Column:
    """A digest that changes only if the rows do, whatever their order."""
    return F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))
