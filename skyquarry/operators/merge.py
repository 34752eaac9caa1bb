"""Write operators: batches of events folded into tables with each table's own rules.

Two disciplines: guarded ones apply an event only if it is newer than what is there, arrival ones
apply whatever comes. Every event row has ``arrival``; ties go by ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import numbered

ARRIVAL = ("arrival", "event_id")


def accepted(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events newer than all that came before for their key."""
    before = F.max("updated_at").over(Window.partitionBy(*keys).orderBy(*ARRIVAL).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_before", before).filter("_before IS NULL OR updated_at > _before").drop("_before")


def _last(events: DataFrame, keys: list[str], columns: list[str], coalesced: bool) -> DataFrame:
    order = F.struct(*ARRIVAL)
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order) if coalesced else order).alias(c)
    return events.groupBy(*keys).agg(*[pick(c) for c in columns])


def guarded_upsert(current: DataFrame, events: DataFrame, keys: list[str], attributes: list[str], *, coalesced: bool = True, fixed: tuple[str, ...] = ()) -> DataFrame:
    """Fold in events newer than the row; a null keeps the old value if ``coalesced``.

    ``fixed`` columns are set on insert and never updated.
    """
    old = current.select(*keys, *attributes, *fixed, "updated_at", F.lit(-1).cast("long").alias("arrival"), F.lit(-1).cast("long").alias("event_id"))
    rows = accepted(old.unionByName(events.select(*keys, *attributes, *fixed, "updated_at", *ARRIVAL)), keys)
    order = F.struct(*ARRIVAL)
    stay = [F.min_by(c, order).alias(c) for c in fixed]
    made = _last(rows, keys, attributes, coalesced)
    return made.join(rows.groupBy(*keys).agg(*stay, F.max_by("updated_at", order).alias("updated_at")), keys)


def arrival_upsert(current: DataFrame, events: DataFrame, keys: list[str], attributes: list[str], *, coalesced: bool = True) -> DataFrame:
    """Fold in events as they came, older ones over newer ones too."""
    columns = [*attributes, "updated_at"]
    old = current.select(*keys, *columns, F.lit(-1).cast("long").alias("arrival"), F.lit(-1).cast("long").alias("event_id"))
    rows = old.unionByName(events.select(*keys, *columns, *ARRIVAL))
    made = _last(rows, keys, attributes, coalesced)
    return made.join(_last(rows, keys, ["updated_at"], False), keys)


def mixed_upsert(current: DataFrame, events: DataFrame, keys: list[str], attributes: list[str], *, kept: tuple[str, ...] = ()) -> DataFrame:
    """Fold in, as they came, events that are ``guarded`` and ones that aren't; a null keeps the old value.

    An unguarded event always applies and sets the time that guarded ones after it must be newer than,
    so each opens a part of its own, in which the times only rise. ``kept`` columns are those that only
    guarded events write.
    """
    columns = [*keys, *attributes, *kept, "updated_at"]
    old = current.select(*columns, F.lit(-1).cast("long").alias("arrival"), F.lit(-1).cast("long").alias("event_id"), F.lit(False).alias("guarded"))
    rows = old.unionByName(events.select(*columns, *ARRIVAL, "guarded"))
    part = F.count_if(~F.col("guarded")).over(Window.partitionBy(*keys).orderBy(*ARRIVAL).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.max("updated_at").over(Window.partitionBy(*keys, "_part").orderBy(*ARRIVAL).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_part", part).withColumn("_before", before).filter("NOT guarded OR _before IS NULL OR updated_at > _before")
    order = F.struct(*ARRIVAL)
    pick = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in (*attributes, *kept)]
    return rows.groupBy(*keys).agg(*pick, F.max_by("updated_at", order).alias("updated_at"))


def last_arrival(events: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key that came last; for tables that are overwritten whole."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in ARRIVAL])
    return events.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def canonical_factions(names: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """id, name for each spelling-blind name: the spelling that came first stays, new ids follow old ones.

    ``names``: name, arrival. Ids are dense by arrival, over distinct names only.
    """
    first = names.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", F.struct("arrival", "name")).alias("name"), F.min(F.struct("arrival", "name")).alias("at"))
    if current is not None:
        first = first.join(current.select(F.lower("name").alias("key")), "key", "left_anti")
    made = numbered(first, F.col("at")).select((F.col("place") + 1).cast("int").alias("id"), "name")
    if current is None:
        return made
    top = current.agg(F.max("id")).first()[0] or 0
    return current.select("id", "name").union(made.select((F.col("id") + top).alias("id"), "name"))


def memberships(events: DataFrame) -> DataFrame:
    """The guarded memberships: the newest of the accepted events, whole, nulls too."""
    return last_arrival(accepted(events, ["system_address", "faction_id"]), ["system_address", "faction_id"])


def state_rows(winners: DataFrame) -> DataFrame:
    """The states of each membership, replaced as a set by its last applied event."""
    kinds = (("Pending", "pending"), ("Active", "active"), ("Recovering", "recovering"))
    each = F.concat(*[F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _with_status(s)) for s, c in kinds])
    return winners.select("system_address", "faction_id", F.explode(each).alias("s")).select("system_address", "faction_id", "s.state", "s.status").distinct()


def _with_status(status: str):
    return lambda state: F.struct(state.alias("state"), F.lit(status).alias("status"))


def conflict_upsert(events: DataFrame, factions: DataFrame) -> DataFrame:
    """Conflicts by the ids of the named factions, last arrival; ``unknown_factions`` has the events that are left out."""
    known = _sided(events, factions).filter("faction_1_id IS NOT NULL AND faction_2_id IS NOT NULL")
    return last_arrival(known, ["system_address", "faction_1_id", "faction_2_id"])


def _sided(events: DataFrame, factions: DataFrame) -> DataFrame:
    side = lambda i: factions.select(F.lower("name").alias(f"key_{i}"), F.col("id").alias(f"faction_{i}_id"))
    return events.withColumns({f"key_{i}": F.lower(f"faction_{i}") for i in (1, 2)}).join(side(1), "key_1", "left").join(side(2), "key_2", "left").drop("key_1", "key_2")


def unknown_factions(events: DataFrame, factions: DataFrame) -> DataFrame:
    """Conflict events that name a faction not on record, with ``error``."""
    sided = _sided(events, factions)
    missing = F.when(F.col("faction_1_id").isNull(), F.col("faction_1")).when(F.col("faction_2_id").isNull(), F.col("faction_2"))
    return sided.withColumn("error", F.concat(F.lit("No faction named "), missing)).filter("error IS NOT NULL").drop("faction_1_id", "faction_2_id")


def insert_missing(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and those of ``new`` whose key isn't there; existing rows stay as they are."""
    return current.unionByName(new.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def market_replacement(events: DataFrame, systems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markets of the last event each, and their commodities, replaced whole.

    ``events``: market_id, system_name, station_name, listings (array of name, price), arrival,
    event_id. A system that isn't known leaves the market waiting. Names are stored in lower case;
    of one that an event lists twice the later listing stays.
    """
    last = last_arrival(events, ["market_id"])
    known = systems.groupBy(F.col("name").alias("key")).agg(F.min("address").alias("system_address"))
    markets = last.join(known, F.upper("system_name") == F.col("key"), "left").select("market_id", "system_name", "system_address", "station_name")
    listed = last.select("market_id", F.posexplode("listings").alias("pos", "l")).select("market_id", F.lower("l.name").alias("name"), F.col("l.price").alias("price"), "pos")
    w = Window.partitionBy("market_id", "name").orderBy(F.col("pos").desc())
    return markets, listed.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth", "pos")


def adopt_waiting(markets: DataFrame, systems: DataFrame) -> DataFrame:
    """``markets`` with the address of those that waited for a system that is now known."""
    known = systems.groupBy(F.upper("name").alias("key")).agg(F.min("address").alias("found"))
    return markets.join(known, F.upper("system_name") == F.col("key"), "left").withColumn("system_address", F.coalesce("system_address", "found")).drop("key", "found")


def adopted_stations(stations: DataFrame, markets: DataFrame, systems: DataFrame) -> DataFrame:
    """``stations`` and those of markets that waited for a system that is now known, where they are missing."""
    waiting = adopt_waiting(markets.filter("system_address IS NULL"), systems).filter("system_address IS NOT NULL")
    return insert_missing(stations, waiting.select("system_address", F.col("station_name").alias("name")), ["system_address", "name"])


def materials(readings: DataFrame) -> DataFrame:
    """Materials of bodies from the last event; of a name read twice the first reading stays. ``readings``: ..., pos."""
    w = Window.partitionBy("system_address", "body_id", "name").orderBy("pos")
    return readings.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth", "pos")


def delete(current: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Without the given keys; no error if absent."""
    return current.join(keys.select(*on), on, "left_anti")


def insert_articles(current: DataFrame, new: DataFrame) -> DataFrame:
    """``current`` and the ``new`` articles (title, date, body, arrival), with ids that follow the greatest there is."""
    top = current.agg(F.max("id")).first()[0] or 0
    made = numbered(new, F.struct("arrival", "title")).select((F.col("place") + top + 1).cast(current.schema["id"].dataType).alias("id"), "title", "date", "body")
    return current.select("id", "title", "date", "body").unionByName(made)


def named_after_system(rows: DataFrame, systems: DataFrame) -> DataFrame:
    """``rows`` with a missing name taken from their system, and all names in lower case."""
    known = systems.select(F.col("address").alias("system_address"), F.col("name").alias("_system"))
    return rows.join(known, "system_address", "left").withColumn("name", F.lower(F.coalesce("name", "_system"))).drop("_system")


def influence_changes(events: DataFrame) -> DataFrame:
    """Change capture: a row for each accepted event whose influence differs from the last accepted one."""
    keys = ["system_address", "faction_id"]
    w = Window.partitionBy(*keys).orderBy(*ARRIVAL)
    rows = accepted(events, keys).select(*keys, F.col("influence").alias("new_influence"), F.lag("influence").over(w).alias("old_influence"), F.col("updated_at").alias("new_timestamp"), F.lag("updated_at").over(w).alias("old_timestamp"))
    return rows.filter("new_influence <> old_influence")


def backfilled_parents(bodies: DataFrame) -> DataFrame:
    return bodies.withColumn("parent_ids", F.when(F.col("parent_id").isNotNull(), F.array("parent_id")).otherwise(F.array().cast("array<int>")))


def parents_of(ids: Column, types: Column) -> Column:
    """Ancestors, nearest first: ids decide how many, a missing type is null."""
    return F.transform(ids, lambda i, at: F.struct(F.get(types, at).alias("type"), i.alias("id")))


def flattened_parents(maps: Column) -> Column:
    """Ancestors from a journal's list of one-entry maps of kind to id."""
    return F.transform(maps, lambda m: F.struct(F.get(F.map_keys(m), F.lit(0)).alias("type"), F.get(F.map_values(m), F.lit(0)).alias("id")))


def downgraded(df: DataFrame, holds: Column) -> tuple[DataFrame, DataFrame]:
    """What a stricter schema can hold, and how many rows it can't."""
    return df.filter(F.coalesce(holds, F.lit(False))), df.agg(F.count_if(~F.coalesce(holds, F.lit(False))).alias("removed"))
