"""Point and set lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import parents_of


def with_factions(systems: DataFrame, memberships: DataFrame) -> DataFrame:
    """``systems`` with their faction ids in order, an empty array where there are none."""
    ids = memberships.groupBy(F.col("system_address").alias("address")).agg(F.sort_array(F.collect_list("faction_id")).alias("factions"))
    return systems.join(ids, "address", "left").withColumn("factions", F.coalesce("factions", F.array().cast("array<int>")))


def by_address(systems: DataFrame, memberships: DataFrame, address: int) -> DataFrame:
    return with_factions(systems.filter(F.col("address") == address), memberships.filter(F.col("system_address") == address))


def by_name(systems: DataFrame, memberships: DataFrame, name: str) -> DataFrame:
    """Names aren't unique; the least address wins. Only the one system's memberships are aggregated."""
    found = systems.filter(F.col("name") == name.upper()).orderBy("address").limit(1)
    one = F.broadcast(found.select(F.col("address").alias("system_address")))  # one row
    return with_factions(found, memberships.join(one, "system_address", "left_semi"))


def by_addresses(systems: DataFrame, memberships: DataFrame, addresses: list[int]) -> DataFrame:
    return with_factions(systems.filter(F.col("address").isin(addresses)), memberships.filter(F.col("system_address").isin(addresses)))


def membership_map(memberships: DataFrame, addresses: list[int]) -> DataFrame:
    held = memberships.filter(F.col("system_address").isin(addresses))
    return held.groupBy("system_address").agg(F.sort_array(F.collect_list("faction_id")).alias("factions"))


def faction(factions: DataFrame, *, id: int | None = None, name: str | None = None, ids: list[int] | None = None) -> DataFrame:
    if ids is not None:
        return factions.filter(F.col("id").isin(ids))
    return factions.filter(F.col("id") == id if id is not None else F.lower("name") == name.lower())


def membership(memberships: DataFrame, factions: DataFrame, address: int, faction_id: int) -> DataFrame:
    return members(memberships.filter(F.col("faction_id") == faction_id), factions, address)


def members(memberships: DataFrame, factions: DataFrame, address: int | None = None) -> DataFrame:
    """Memberships with the faction's name, of one system or all, greatest influence first."""
    held = memberships if address is None else memberships.filter(F.col("system_address") == address)
    named = held.join(factions.select(F.col("id").alias("faction_id"), F.col("name").alias("faction_name")), "faction_id")
    return named.orderBy(F.col("influence").desc_nulls_first(), "system_address", "faction_id")


def bodies_with_materials(bodies: DataFrame, materials: DataFrame) -> DataFrame:
    """``bodies`` with the names and percents of their materials, by name; empty arrays without any."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "percent")))
    made = materials.filter("name IS NOT NULL").groupBy("system_address", F.col("body_id").alias("id")).agg(pairs.alias("made"))
    joined = bodies.join(made, ["system_address", "id"], "left")
    part = lambda f, kind: F.coalesce(F.transform("made", lambda m: m[f]), F.array().cast(kind))
    return joined.select("*", part("name", "array<string>").alias("material_names"), part("percent", "array<double>").alias("material_percents")).drop("made")


def body_like(bodies: DataFrame, pattern: str, address: int | None = None) -> DataFrame:
    found = bodies.filter(F.ilike("name", F.lit(pattern)))
    return found.orderBy("name", "system_address", "id") if address is None else found.filter(F.col("system_address") == address).orderBy("id").limit(1)


def composed(bodies: DataFrame) -> DataFrame:
    """``bodies`` with the nested composition and surface that are there only if their parts are."""
    made = F.when(F.col("ice").isNotNull() & F.col("rock").isNotNull() & F.col("metal").isNotNull(), F.struct("ice", "rock", "metal"))
    surface = F.when(F.col("atmosphere").isNotNull() & F.col("pressure").isNotNull(), F.struct("atmosphere", "pressure", made.alias("composition")))
    return bodies.withColumn("surface", surface)


ORBIT = ("semi_major_axis", "eccentricity", "inclination", "periapsis", "ascending_node", "mean_anomaly", "orbital_period")


def orbiting(df: DataFrame) -> DataFrame:
    """``df`` with ``orbit``, there only if all its parts are, and ``parents`` where ids and types of ancestors are."""
    whole = F.lit(True)
    for c in ORBIT:
        whole &= F.col(c).isNotNull()
    out = df.withColumn("orbit", F.when(whole, F.struct(*ORBIT)))
    return out.withColumn("parents", parents_of(F.col("parent_ids"), F.col("parent_types"))) if "parent_ids" in df.columns else out


def of_system(table: DataFrame, address: int, **keys: object) -> DataFrame:
    """Stars, barycenters, stations or bodies of a system, or the one of the given id or name."""
    found = table.filter(F.col("system_address") == address)
    for k, v in keys.items():
        found = found.filter(F.col(k) == v)
    return found


def article_page(articles: DataFrame, limit: int, offset: int = 0, turn: int = 0) -> DataFrame:
    """Rows by id; turning a page moves the offset by so many rows, not pages."""
    return articles.orderBy("id").offset(offset + turn).limit(limit)


def articles_between(articles: DataFrame, first: str, last: str) -> DataFrame:
    return articles.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
