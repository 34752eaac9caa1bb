"""Explicit types of the catalogue's tables and events, in DDL; nothing is inferred."""

from __future__ import annotations

# Enum domains in declaration order, which is their sort order.
SECURITY = ("Low", "Medium", "High")
GOVERNMENT = ("Anarchy", "Carrier", "Communism", "Confederacy", "Cooperative", "Corporate", "Democracy", "Dictatorship", "Engineer", "Feudal", "Patronage", "Prison", "PrisonColony", "Theocracy")
ALLEGIANCE = ("Alliance", "Empire", "Federation", "Guardian", "Independent", "PilotsFederation", "PlayerPilots", "Thargoid")
ECONOMY = ("Agriculture", "Carrier", "Colony", "Extraction", "HighTech", "Industrial", "Military", "Prison", "Refinery", "Service", "Terraforming", "Tourism", "Undefined")
STATE = ("Blight", "Boom", "Bust", "CivilLiberty", "CivilUnrest", "CivilWar", "ColdWar", "Colonisation", "Drought", "Election", "Expansion", "Famine", "HistoricEvent", "InfrastructureFailure", "Investment", "Lockdown", "NaturalDisaster", "Outbreak", "PirateAttack", "PublicHoliday", "Retreat", "Revolution", "TechnologicalLeap", "Terrorism", "TradeWar", "War")
HAPPINESS = ("Elated", "Happy", "Discontented", "Unhappy", "Despondent")
CONFLICT = ("War", "CivilWar", "Election")
STATUS = ("Active", "Pending", "Recovering")
STATION_TYPE = ("AsteroidBase", "Coriolis", "CraterOutpost", "CraterPort", "FleetCarrier", "MegaShip", "Ocellus", "Orbis", "Outpost")
SERVICE = ("Autodock", "Blackmarket", "CarrierFuel", "CarrierManagement", "Commodities", "Contacts", "CrewLounge", "Dock", "Engineer", "Exploration", "Facilitator", "FlightController", "Initiatives", "MaterialTrader", "Missions", "MissionsGenerated", "Modulepacks", "Outfitting", "Powerplay", "Rearm", "Refuel", "Repair", "SearchRescue", "Shipyard", "Shop", "StationMenu", "StationOperations", "TechBroker", "Tuning", "VoucherRedemption", "Livery", "SocialSpace", "Bartender", "VistaGenomics", "PioneerSupplies", "ApexInterstellar", "FrontlineSolutions")

SYSTEM = (
    "address bigint, name string, x double, y double, z double, population bigint, security string, government string, allegiance string, primary_economy string, secondary_economy string, primary_star_class string, updated_at timestamp_ntz"
)
MEMBERSHIP = "system_address bigint, faction_id int, influence double, updated_at timestamp_ntz, state string, happiness string, government string, allegiance string"
#: A line of a journal, and of the live stream once its envelope is off.
JOURNAL_EVENT = (
    "event string, timestamp timestamp_ntz, SystemAddress bigint, StarSystem string, StarPos array<double>, Population bigint, SystemSecurity string, SystemGovernment string, SystemAllegiance string, SystemEconomy string, SystemSecondEconomy string, StarClass string, "
    "Factions array<struct<Name:string,Influence:double,Government:string,Allegiance:string,Happiness:string,FactionState:string,PendingStates:array<string>,ActiveStates:array<string>,RecoveringStates:array<string>>>, "
    "Conflicts array<struct<WarType:string,Status:string,Faction1:struct<Name:string,Stake:string,WonDays:int>,Faction2:struct<Name:string,Stake:string,WonDays:int>>>, "
    "Body string, BodyType string, StarType string, Subclass int, StellarMass double, AbsoluteMagnitude double, Age_MY int, Luminosity string, PlanetClass string, MassEM double, SurfaceGravity double, SurfaceTemperature double, Radius double, "
    "DistanceFromArrivalLS double, SemiMajorAxis double, Eccentricity double, OrbitalInclination double, Periapsis double, AscendingNode double, MeanAnomaly double, OrbitalPeriod double, Materials array<struct<Name:string,Percent:double>>, "
    "StationName string, MarketID bigint, StationType string, BodyID int, BodyName string, Parents array<map<string,int>>, Route array<struct<StarSystem:string,SystemAddress:bigint,StarPos:array<double>,StarClass:string>>, "
    "Commodities array<struct<name:string,buyPrice:int,sellPrice:int,demand:int,stock:int>>"
)
DUMP_CSV = "address bigint, name string, x double, y double, z double, population bigint, updated_at timestamp_ntz"
DUMP_JSON = "id64 bigint, name string, coords struct<x:double,y:double,z:double>, date timestamp_ntz"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
