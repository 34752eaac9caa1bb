"""Listings, rollups and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def listings(commodities: DataFrame, markets: DataFrame, stations: DataFrame, systems: DataFrame, name: str) -> DataFrame:
    """Where a commodity is listed, newest first."""
    priced = commodities.filter(F.col("name") == name.lower()).select("market_id", "mean_price", "stock", "listed_at")
    placed = priced.join(markets.select(F.col("id").alias("market_id"), "system_address", "station_name"), "market_id")
    docked = placed.join(stations.select("system_address", F.col("name").alias("station_name"), "ty"), ["system_address", "station_name"])
    named = docked.join(systems.select(F.col("address").alias("system_address"), F.col("name").alias("system_name")), "system_address")
    return named.select("system_name", "station_name", "ty", "mean_price", "stock", "listed_at").orderBy(F.col("listed_at").desc_nulls_first(), "station_name")


def conflicts_of(conflicts: DataFrame, factions: DataFrame, systems: DataFrame, name: str) -> DataFrame:
    """Conflicts with the faction on either side."""
    side = lambda i: factions.select(F.col("id").alias(f"faction_{i}_id"), F.col("name").alias(f"faction_{i}"))
    met = conflicts.join(side(1), "faction_1_id").join(side(2), "faction_2_id").filter((F.col("faction_1") == name) | (F.col("faction_2") == name))
    return met.join(systems.select(F.col("address").alias("system_address"), F.col("name").alias("system_name")), "system_address").select(
        "system_name", "type", "status", "faction_1", "faction_1_stake", "faction_1_won_days", "faction_2", "faction_2_stake", "faction_2_won_days"
    )


def dominant_disagrees(systems: DataFrame, memberships: DataFrame, factions: DataFrame, *, fixed: bool = False) -> DataFrame:
    """Systems whose most influential factions (all of a tie) have another government.

    The rule as first written also compares the system's allegiance with itself, which never holds;
    ``fixed`` compares it with the faction's.
    """
    top = memberships.withColumn("top", F.max("influence").over(Window.partitionBy("system_address"))).filter(F.col("influence") == F.col("top"))
    held = top.select(F.col("system_address").alias("address"), "faction_id", "influence", F.col("government").alias("faction_government"), F.col("allegiance").alias("faction_allegiance"))
    other = F.col("government") != F.col("faction_government")
    if fixed:
        other |= F.col("allegiance") != F.col("faction_allegiance")
    met = systems.join(held, "address").filter(other).join(factions.select(F.col("id").alias("faction_id"), F.col("name").alias("faction_name")), "faction_id")
    return met.select("address", F.col("name").alias("system_name"), "faction_name", "influence", "government", "faction_government", "allegiance", "faction_allegiance")


def named_changes(changes: DataFrame, systems: DataFrame, factions: DataFrame) -> DataFrame:
    placed = changes.join(systems.select(F.col("address").alias("system_address"), F.col("name").alias("system_name")), "system_address")
    return placed.join(factions.select(F.col("id").alias("faction_id"), F.col("name").alias("faction_name")), "faction_id")


def change_log(changes: DataFrame, systems: DataFrame, factions: DataFrame, *, system: str | None = None, faction: str | None = None) -> DataFrame:
    """Changes of influence by name, newest first; of one system or one faction if given."""
    named = named_changes(changes, systems.filter(F.col("name") == system) if system else systems, factions.filter(F.col("name") == faction) if faction else factions)
    return named.select("system_name", "faction_name", "old_influence", "new_influence", "old_timestamp", "new_timestamp").orderBy(F.col("new_timestamp").desc_nulls_first(), "system_name", "faction_name")


def change_counts(changes: DataFrame, systems: DataFrame, factions: DataFrame) -> DataFrame:
    return named_changes(changes, systems, factions).groupBy("system_name", "faction_id", "faction_name").agg(F.count(F.lit(1)).alias("changes"))


def change_counts_by_time(changes: DataFrame, systems: DataFrame) -> DataFrame:
    placed = changes.join(systems.select(F.col("address").alias("system_address"), F.col("name").alias("system_name")), "system_address")
    return placed.groupBy("system_name", "new_timestamp").agg(F.count(F.lit(1)).alias("changes")).orderBy(F.col("new_timestamp").desc_nulls_first(), "system_name")


def footprint(memberships: DataFrame, systems: DataFrame, faction_id: int) -> DataFrame:
    """Where a faction is, and how many factions are there."""
    here = memberships.filter(F.col("faction_id") == faction_id).select("system_address", "influence")
    counts = memberships.join(here.select("system_address"), "system_address", "left_semi").groupBy("system_address").agg(F.count(F.lit(1)).alias("factions"))
    named = systems.select(F.col("address").alias("system_address"), F.col("name").alias("system_name"), "population")
    return here.join(counts, "system_address").join(named, "system_address").select("system_name", "population", "influence", "factions").orderBy(F.col("influence").desc_nulls_first(), "system_name")


def trends(memberships: DataFrame, changes: DataFrame) -> DataFrame:
    """Change of influence a day by least squares over the old values; null with fewer than two."""
    seconds = F.unix_micros(F.col("old_timestamp").cast("timestamp")) / 1e6
    slope = changes.groupBy("system_address", "faction_id").agg((F.regr_slope("old_influence", seconds) * DAY).alias("slope"))
    return memberships.select("system_address", "faction_id", "influence").join(slope, ["system_address", "faction_id"], "left")


def rollup(systems: DataFrame, *keys: str) -> DataFrame:
    """Population, systems and population a system, by key; a null key is a group."""
    made = systems.groupBy(*keys).agg(F.sum("population").alias("population"), F.count(F.lit(1)).alias("systems"))
    return made.withColumn("ratio", F.col("population") / F.col("systems")).orderBy(F.col("population").desc_nulls_first(), *keys)


def systems_of_faction(systems: DataFrame, memberships: DataFrame, factions: DataFrame, pattern: str) -> DataFrame:
    """Systems of all factions that match; once for each."""
    held = memberships.select(F.col("system_address").alias("address"), "faction_id")
    return systems.join(held.join(factions.filter(F.ilike("name", F.lit(pattern))).select(F.col("id").alias("faction_id")), "faction_id", "left_semi"), "address")


def mean_population(systems: DataFrame) -> DataFrame:
    return systems.agg(F.coalesce(F.avg(F.coalesce("population", F.lit(0))), F.lit(0.0)).alias("mean"))


def tally(df: DataFrame, within, admitted) -> DataFrame:
    """How many are in reach, and how many of those are admitted."""
    return df.agg(F.count_if(within).alias("total"), F.count_if(within & admitted).alias("admitted"))


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def listed_factions(memberships: DataFrame, names: DataFrame) -> DataFrame:
    """system_address, faction_id, name, place: the named first and by name, those without one last by id."""
    named = memberships.select("system_address", "faction_id").join(names.select(F.col("id").alias("faction_id"), "name"), "faction_id", "left")
    order = Window.partitionBy("system_address").orderBy(F.col("name").isNull(), "name", "faction_id")
    return named.withColumn("place", F.row_number().over(order) - 1)


def in_order(rows: DataFrame, away: str, place: str) -> DataFrame:
    """By distance where there is one, else last; rows that tie keep the order they came in."""
    return rows.orderBy(F.col(away).asc_nulls_last(), place)
