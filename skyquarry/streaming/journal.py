"""What each kind of journal event writes to which table: the router's handlers, and the tables made of their logs.

A handler takes the events of its kinds and shapes them as rows of its table's log; the fold is the
table's own merge, in the order of arrival. Systems come first: what a market or a station needs to know
of them is looked up when tables are read, so the order of the handlers in a batch doesn't matter, and
a market that came before its system is adopted as soon as that is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import merge
from ..operators.lookup import ORBIT
from .ingest import Handler, Ingest

#: Kinds of events that say where a system is and what holds there.
OF_SYSTEM = ("Scan", "ScanBaryCentre", "Location", "Docked", "FSDJump")
OF_FACTIONS = ("Location", "FSDJump")
TOLD = ("x", "y", "z", "population", "security", "government", "allegiance", "primary_economy", "secondary_economy")
_KEYS = ("arrival", "event_id")
#: Entries that a list of one event may have.
LISTED = 4096


def _kind(*kinds: str) -> Column:
    return F.col("event").isin(*kinds)


def _at(place: Column, i: int) -> Column:
    return F.get(place, F.lit(i))


def systems(events: DataFrame) -> DataFrame:
    """Rows of both disciplines: journal events apply as they come, the stops of a plotted route only if they are newer."""
    whole = F.col("event").isin(*OF_FACTIONS)  # the others name the system and, at most, say where it is
    told = {"population": "Population", "security": "SystemSecurity", "government": "SystemGovernment", "allegiance": "SystemAllegiance", "primary_economy": "SystemEconomy", "secondary_economy": "SystemSecondEconomy"}
    told_ = [F.when(whole, F.col(c)).alias(k) for k, c in told.items()]
    # a lone second economy is none
    told_[-1] = F.when(whole & F.col("SystemEconomy").isNotNull(), F.col("SystemSecondEconomy")).alias("secondary_economy")
    place = [F.when(F.col("event") != "Docked", _at(F.col("StarPos"), i)).alias(c) for i, c in enumerate("xyz")]
    direct = events.filter(_kind(*OF_SYSTEM)).select(F.col("SystemAddress").alias("address"), F.upper("StarSystem").alias("name"), *place, *told_, F.lit(None).cast("string").alias("primary_star_class"), F.col("timestamp").alias("updated_at"), F.lit(False).alias("guarded"), *_KEYS)
    stop = events.filter(_kind("NavRoute")).select("timestamp", *_KEYS, F.posexplode("Route").alias("hop", "r"))
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(TOLD[3:], ("bigint", *["string"] * 5))]
    plotted = stop.select(F.col("r.SystemAddress").alias("address"), F.upper("r.StarSystem").alias("name"), *[_at(F.col("r.StarPos"), i).alias(c) for i, c in enumerate("xyz")], *none, F.col("r.StarClass").alias("primary_star_class"), F.col("timestamp").alias("updated_at"), F.lit(True).alias("guarded"), *_KEYS)
    return direct.unionByName(plotted).filter("address IS NOT NULL")


def fold_systems(current: DataFrame | None, log: DataFrame) -> DataFrame:
    attributes = ["name", *TOLD, "primary_star_class"]
    return merge.mixed_upsert(_or_empty(current, log, ["address", *attributes, "updated_at"]), log, ["address"], attributes)


def _or_empty(current: DataFrame | None, log: DataFrame, columns: list[str]) -> DataFrame:
    return log.limit(0).select(*columns) if current is None else current


def _last(keys: list[str]):
    def fold(current: DataFrame | None, log: DataFrame) -> DataFrame:
        rows = log if current is None else current.withColumns({c: F.lit(-1).cast("long") for c in _KEYS}).unionByName(log)
        return merge.last_arrival(rows, keys).drop(*_KEYS)

    return fold


def _everything(current: DataFrame | None, log: DataFrame) -> DataFrame:
    return log if current is None else current.unionByName(log)


def _listed(events: DataFrame, column: str, name: str) -> DataFrame:
    """A row for each entry of a list; those of one event arrive in the list's order."""
    rows = events.filter(_kind(*OF_FACTIONS)).select(F.col("SystemAddress").alias("system_address"), "timestamp", *_KEYS, F.posexplode(column).alias("pos", name))
    return rows.withColumn("event_id", F.col("event_id") * LISTED + F.col("pos")).drop("pos")


def memberships(events: DataFrame) -> DataFrame:
    """A row for each faction that an event lists, by its name."""
    each = _listed(events, "Factions", "f")
    return each.select(
        "system_address", F.col("f.Name").alias("faction"), F.col("f.Influence").alias("influence"), F.col("f.FactionState").alias("state"), F.col("f.Happiness").alias("happiness"), F.col("f.Government").alias("government"), F.col("f.Allegiance").alias("allegiance"),
        F.col("f.PendingStates").alias("pending"), F.col("f.ActiveStates").alias("active"), F.col("f.RecoveringStates").alias("recovering"), F.col("timestamp").alias("updated_at"), *_KEYS,
    )


def conflicts(events: DataFrame) -> DataFrame:
    each = _listed(events, "Conflicts", "c")
    side = [F.col(f"c.Faction{i}.{c}").alias(f"faction_{i}{k}") for i in (1, 2) for c, k in (("Name", ""), ("Stake", "_stake"), ("WonDays", "_won_days"))]
    return each.select("system_address", F.col("c.WarType").alias("type"), F.col("c.Status").alias("status"), *side, F.col("timestamp").alias("updated_at"), *_KEYS)


def _orbit() -> list[Column]:
    said = ("SemiMajorAxis", "Eccentricity", "OrbitalInclination", "Periapsis", "AscendingNode", "MeanAnomaly", "OrbitalPeriod")
    return [F.col(c).alias(k) for k, c in zip(ORBIT, said)]


def _scanned() -> list[Column]:
    return [F.col("SystemAddress").alias("system_address"), F.col("BodyID").alias("id"), merge.flattened_parents(F.col("Parents")).alias("parents"), *_orbit(), F.col("timestamp").alias("updated_at"), *_KEYS]


def stars(events: DataFrame) -> DataFrame:
    own = {"name": "BodyName", "star_class": "StarType", "subclass": "Subclass", "stellar_mass": "StellarMass", "radius": "Radius", "absolute_magnitude": "AbsoluteMagnitude", "age_my": "Age_MY", "temperature": "SurfaceTemperature", "luminosity": "Luminosity", "arrival_ls": "DistanceFromArrivalLS"}
    return events.filter(_kind("Scan") & F.col("StarType").isNotNull()).select(*_scanned(), *[F.col(c).alias(k) for k, c in own.items()])


def bodies(events: DataFrame) -> DataFrame:
    """Bodies that were scanned, and those that a Location names, of which nothing else is known."""
    own = {"planet_class": "PlanetClass", "mass": "MassEM", "gravity": "SurfaceGravity", "temperature": "SurfaceTemperature", "radius": "Radius", "arrival_ls": "DistanceFromArrivalLS"}
    located = _kind("Location") & F.col("Body").isNotNull() & (F.coalesce("BodyType", F.lit("")) == "Planet")
    found = events.filter((_kind("Scan") & F.col("StarType").isNull()) | located)
    return found.select(*_scanned(), F.coalesce("BodyName", "Body").alias("name"), *[F.col(c).alias(k) for k, c in own.items()], F.col("Materials").alias("materials"))


def barycenters(events: DataFrame) -> DataFrame:
    return events.filter(_kind("ScanBaryCentre")).select(*_scanned())


def stations(events: DataFrame) -> DataFrame:
    docked = events.filter(_kind("Location", "Docked") & F.col("StationName").isNotNull())
    return docked.select(F.col("SystemAddress").alias("system_address"), F.col("StationName").alias("name"), F.col("StationType").alias("ty"), F.col("MarketID").alias("market_id"), F.col("timestamp").alias("updated_at"), *_KEYS)


def markets(events: DataFrame) -> DataFrame:
    listing = F.transform("Commodities", lambda c: F.struct(c["name"].alias("name"), c["buyPrice"].alias("price")))
    return events.filter(_kind("Commodity")).select(F.col("MarketID").alias("market_id"), F.col("StarSystem").alias("system_name"), F.col("StationName").alias("station_name"), listing.alias("listings"), F.col("timestamp").alias("updated_at"), *_KEYS)


HANDLERS = [
    ("systems", (*OF_SYSTEM, "NavRoute"), systems, fold_systems),
    ("memberships", OF_FACTIONS, memberships, _everything),
    ("conflicts", OF_FACTIONS, conflicts, _everything),
    ("stars", ("Scan",), stars, _last(["system_address", "id"])),
    ("bodies", ("Scan", "Location"), bodies, _last(["system_address", "id"])),
    ("barycenters", ("ScanBaryCentre",), barycenters, _last(["system_address", "id"])),
    ("stations", ("Location", "Docked"), stations, _last(["system_address", "name"])),
    ("markets", ("Commodity",), markets, _last(["market_id"])),
]


def handlers() -> list[Handler]:
    return [Handler(table, _kind(*kinds), rows, fold) for table, kinds, rows, fold in HANDLERS]


def assembled(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The catalogue's tables from those of the handlers: factions by name, memberships and conflicts by id, states, materials,
    and the markets with what follows once their system is known."""
    out = dict(tables)
    if "memberships" in tables:
        told = tables["memberships"]
        out["factions"] = merge.canonical_factions(told.select(F.col("faction").alias("name"), F.struct(*_KEYS, "faction").alias("arrival")))
        by_name = out["factions"].select(F.lower("name").alias("key"), F.col("id").alias("faction_id"))
        held = merge.memberships(told.join(by_name, F.lower("faction") == F.col("key")).drop("key", "faction"))
        out["memberships"] = held.drop("pending", "active", "recovering", *_KEYS)
        out["states"] = merge.state_rows(held)
        if "conflicts" in tables:
            out["conflicts"] = merge.conflict_upsert(tables["conflicts"], out["factions"]).drop("faction_1", "faction_2", *_KEYS)
            out["conflict_errors"] = merge.unknown_factions(tables["conflicts"], out["factions"])
    if "markets" in tables and "systems" in tables:
        folded = tables["markets"].withColumns({c: F.lit(0).cast("long") for c in _KEYS})
        out["markets"], out["commodities"] = merge.market_replacement(folded, tables["systems"])
        linked = out["markets"].filter("system_address IS NOT NULL").select("system_address", F.col("station_name").alias("name"))
        known = tables.get("stations")
        out["stations"] = merge.insert_missing(linked.limit(0) if known is None else known, linked, ["system_address", "name"])
    if "bodies" in tables:
        read = tables["bodies"].select("system_address", F.col("id").alias("body_id"), F.posexplode("materials").alias("pos", "m")).select("system_address", "body_id", F.col("m.Name").alias("name"), F.col("m.Percent").alias("percent"), "pos")
        out["body_materials"] = merge.materials(read)
        out["bodies"] = tables["bodies"].drop("materials")
    return out


def catalogue(live: Ingest) -> dict[str, DataFrame]:
    """All tables of a stream that runs with ``handlers()``."""
    made = {h.table: live.table(h.table) for h in live.handlers}
    return assembled({k: v for k, v in made.items() if v is not None})
