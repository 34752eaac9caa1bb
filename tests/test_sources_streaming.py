"""Readers, writers and the stream."""

import json

from pyspark.sql import functions as F

from skyquarry import schemas as S
from skyquarry.operators import merge
from skyquarry.sources import readers, writers
from skyquarry.streaming import ingest, journal


def test_journal(spark, tmp_path):
    lines = [{"event": "Location", "SystemAddress": 1, "StarSystem": "Sol", "StarPos": [0, 0, 0]}, {"event": "FSDJump", "SystemAddress": 2}, {"event": "Music"}]
    (tmp_path / "Journal.log").write_text("\n".join([*map(json.dumps, lines), "not json", ""]))
    events, bad = readers.journal(spark, str(tmp_path))
    assert sorted(r.SystemAddress for r in events.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["not json"]


def test_dumps(spark, tmp_path):
    (tmp_path / "d.csv").write_text("address,name,x,y,z,population,updated_at\n1,SOL,0,0,0,5,2024-01-01T00:00:00\n,NONE,0,0,0,1,2024-01-01T00:00:00\nxx,BAD,0,0,0,1,2024-01-01T00:00:00\n")
    assert [r.name for r in readers.dump_csv(spark, str(tmp_path / "d.csv")).collect()] == ["SOL"]
    rows = [{"id64": 1, "name": "Sol", "coords": {"x": 0, "y": 0, "z": 0}}, {"name": "no id", "coords": {"x": 0, "y": 0, "z": 0}}, {"id64": 3, "name": "no place"}]
    (tmp_path / "d.json").write_text(json.dumps(rows))
    found = readers.dump_json(spark, str(tmp_path / "d.json"))
    assert [(r.address, r.name) for r in found.collect()] == [(1, "SOL")]
    (tmp_path / "l.json").write_text("[\n" + ",\n".join("    " + json.dumps(r) for r in rows) + "\n]\n")
    assert [(r.address, r.name) for r in readers.dump_json(spark, str(tmp_path / "l.json"), by_line=True).collect()] == [(1, "SOL")]
    assert readers.api(found, name="sol", sphere=((9.0, 9.0, 9.0), 1.0)).count() == 0 and readers.api(found, name="sol").count() == 1
    assert readers.api(found, cube=((0.0, 0.0, 0.0), 2.0), name="x").count() == 1


def test_import_report(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("c", None)], "name string, id int")
    good, bad, names = readers.import_report(rows, F.when(F.col("id").isNull(), "no id"))
    assert good.first().imported == 1 and [tuple(r) for r in bad.collect()] == [("no id", 2)] and [tuple(r) for r in names.collect()] == [("no id", "b"), ("no id", "c")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "SOL", 0, None, "Feudal", None), (2, "LAVE", 1234567, "Low", None, None)], "address long, name string, population long, security string, government string, allegiance string")
    assert {r.address: r.text for r in writers.record(df).collect()} == {1: "Name: SOL\nGovernment: Feudal", 2: "Name: LAVE\nPopulation: 1,234,567\nSecurity: Low"}
    assert writers.page(df).first().security == "---"
    writers.dump({"systems": df, "big": df, "small": df.limit(1)}, str(tmp_path))
    assert writers.restore(spark, str(tmp_path), ["systems"])["systems"].count() == 2
    assert {n for n, _ in writers.sizes(spark, str(tmp_path), ["systems", "big", "small"])} == {"big", "small"}
    pairs = spark.createDataFrame([(0, "A", "B", 7.126)], "hop int, origin string, destination string, leg double")
    assert tuple(writers.route_table(pairs).first()) == ("A", "B", "7.13 Ly")
    writers.save(df, str(tmp_path / "t"), bucket="address")
    writers.save(readers.table(spark, str(tmp_path / "t")).limit(1), str(tmp_path / "t"))  # over what is read
    assert readers.table(spark, str(tmp_path / "t")).count() == 1
    report = spark.createDataFrame([(3, 21.126, 20.0)], "jumps long, path double, straight double")
    assert writers.route_summary(report).first().summary == "jumps: 3.00, path: 21.13 Ly, distance: 20.00 Ly"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    arrival = F.col("event_id") + (F.col("event_id") * 7919) % 2000
    shaped = lambda df: df.select(F.col("user_id").alias("system_address"), F.length("event_type").alias("faction_id"), F.col("value").alias("influence"), F.col("ts").alias("updated_at"), arrival.alias("arrival"), "event_id")
    events.repartition(5).write.parquet(str(tmp_path / "in"))

    def fold(_, log):
        return merge.influence_changes(log)

    def failing(_):
        raise ValueError("broken table")

    broken = [failing]
    handlers = [ingest.Handler("changes", F.lit(True), shaped, fold), ingest.Handler("bad", F.lit(True), lambda df: broken[0](df), fold), ingest.Handler("big", F.col("value") > 50, shaped, lambda s, log: log if s is None else s.unionByName(log))]
    live = ingest.Ingest(spark, str(tmp_path / "base"), handlers)
    query = live.start(readers.stream(spark, str(tmp_path / "in"), S.EVENTS, pattern="*.parquet", files=2), once=True)
    query.awaitTermination()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(live.table("changes")) == rows(merge.influence_changes(shaped(events)))
    assert live.table("bad") is None and live.dead("bad").filter("error LIKE '%broken table%'").count() == 1000 and live.dead("big") is None
    broken[0] = shaped
    live.replay("bad")  # no event of a failed table is lost
    assert rows(live.table("bad")) == rows(live.table("changes")) and live.dead("bad") is None
    live.batch(events.limit(0), 0)  # a batch that is run again replaces what it wrote
    assert live.table("big").count() < shaped(events.filter("value > 50")).count()
    before = rows(live.table("big"))
    live.compact("big", 1)
    assert rows(live.table("big")) == before


def test_route_waypoints(spark):
    line = {"event": "NavRoute", "timestamp": "2024-01-01T00:00:00", "Route": [{"StarSystem": "Sol", "SystemAddress": 1, "StarPos": [1, 2, 3], "StarClass": "G"}]}
    events, _ = readers.parsed(spark.createDataFrame([(json.dumps(line),)], "value string"))
    assert tuple(ingest.waypoints(events).first())[:6] == (1, "SOL", 1.0, 2.0, 3.0, "G")


def _lines(spark, tmp_path, name, *events):
    (tmp_path / "lines").mkdir(exist_ok=True)
    (tmp_path / "lines" / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in events) + "\n")


def test_each_kind_of_event_reaches_its_tables(spark, tmp_path):
    at = lambda minute: f"2024-01-01T00:{minute:02d}:00"
    base = {"SystemAddress": 1, "StarSystem": "Sol", "StarPos": [0, 0, 0]}
    faction = lambda name, influence, **more: {"Name": name, "Influence": influence, **more}
    market = lambda minute, id_, system, *names: {"event": "Commodity", "timestamp": at(minute), "MarketID": id_, "StarSystem": system, "StationName": f"Port {id_}", "Commodities": [{"name": n, "buyPrice": i} for i, n in enumerate(names)]}
    orbit = {"SemiMajorAxis": 1.0, "Eccentricity": 0.1, "OrbitalInclination": 2.0, "Periapsis": 3.0, "AscendingNode": 4.0, "MeanAnomaly": 5.0, "OrbitalPeriod": 6.0}
    _lines(
        spark, tmp_path, "1.log",
        {"event": "Location", "timestamp": at(1), **base, "Population": 5, "SystemSecurity": "High", "SystemEconomy": "HighTech", "SystemSecondEconomy": "Service", "Body": "Earth", "BodyType": "Planet", "BodyID": 3, "StationName": "Galileo", "StationType": "Orbis", "MarketID": 9,
         "Factions": [faction("Mother Gaia", 0.4, PendingStates=["Boom"]), faction("MOTHER GAIA", 0.3), faction("Sol Workers", 0.2, ActiveStates=["War"])],
         "Conflicts": [{"WarType": "War", "Status": "Active", "Faction1": {"Name": "Mother Gaia", "Stake": "dock", "WonDays": 1}, "Faction2": {"Name": "sol workers", "Stake": None, "WonDays": 2}}, {"WarType": "War", "Status": "Active", "Faction1": {"Name": "Nobody"}, "Faction2": {"Name": "Mother Gaia"}}]},
        {"event": "Docked", "timestamp": at(2), **base, "StarPos": None, "StationName": "Galileo", "StationType": "Coriolis", "MarketID": 9},
        market(3, 7, "lave", "Tritium", "GOLD", "tritium"), market(3, 8, "sol"), market(3, 6, "nowhere", "Tea"),
        "not json",
    )
    live = ingest.Ingest(spark, str(tmp_path / "base"), journal.handlers(), readers.parsed)
    run = lambda: live.start(spark.readStream.text(str(tmp_path / "lines")), once=True).awaitTermination()
    run()
    _lines(
        spark, tmp_path, "2.log",
        {"event": "Scan", "timestamp": at(4), **base, "BodyID": 0, "BodyName": "Sol A", "StarType": "G", "Subclass": 2, "StellarMass": 1.0, "Radius": 7e8, "SurfaceTemperature": 5778.0, "Age_MY": 4600, "Luminosity": "V"},
        {"event": "Scan", "timestamp": at(4), **base, "BodyID": 3, "BodyName": "Earth", "PlanetClass": "Earthlike body", "MassEM": 1.0, "Parents": [{"Null": 1}, {"Star": 0}], **orbit, "Materials": [{"Name": "iron", "Percent": 30.0}, {"Name": "iron", "Percent": 1.0}]},
        {"event": "ScanBaryCentre", "timestamp": at(4), **base, "BodyID": 1, **orbit},
        {"event": "FSDJump", "timestamp": at(0), **base, "Population": 6, "Factions": [faction("mother gaia", 0.9)]},
        {"event": "NavRoute", "timestamp": at(0), "Route": [{"StarSystem": "Sol", "SystemAddress": 1, "StarPos": [9, 9, 9], "StarClass": "X"}, {"StarSystem": "Lave", "SystemAddress": 2, "StarPos": [1, 2, 3], "StarClass": "K"}]},
        {"event": "NavRoute", "timestamp": at(1), "Route": [{"StarSystem": "Sol", "SystemAddress": 1, "StarPos": [0, 0, 1], "StarClass": "G"}]},
        {"event": "Music", "timestamp": at(9)},
    )
    run()
    made = journal.catalogue(live)
    rows = lambda name, *columns: sorted(map(tuple, made[name].select(*columns).collect()), key=repr)
    # the older jump applies as it came, and only what is newer than it changes it after that
    assert rows("systems", "address", "name", "z", "population", "security", "secondary_economy", "primary_star_class") == [(1, "SOL", 1.0, 6, "High", "Service", "G"), (2, "LAVE", 3.0, None, None, None, "K")]
    assert rows("factions", "id", "name") == [(1, "Mother Gaia"), (2, "Sol Workers")]
    assert rows("memberships", "faction_id", "influence") == [(1, 0.4), (2, 0.2)]  # an older event and one of the same time come too late
    assert rows("states", "faction_id", "state", "status") == [(1, "Boom", "Pending"), (2, "War", "Active")]
    assert rows("conflicts", "type", "faction_1_stake", "faction_2_won_days") == [("War", "dock", 2)] and rows("conflict_errors", "error") == [("No faction named Nobody",)]
    assert rows("stations", "system_address", "name", "ty") == sorted([(1, "Galileo", "Coriolis"), (1, "Port 8", None), (2, "Port 7", None)], key=repr)
    assert rows("markets", "market_id", "system_address") == sorted([(7, 2), (8, 1), (6, None)], key=repr)
    assert rows("commodities", "market_id", "name", "price") == sorted([(7, "tritium", 2), (7, "gold", 1), (6, "tea", 0)], key=repr)
    assert rows("stars", "id", "star_class", "subclass", "age_my") == [(0, "G", 2, 4600)] and rows("barycenters", "id", "semi_major_axis") == [(1, 1.0)]
    assert rows("bodies", "id", "name", "planet_class") == [(3, "Earth", "Earthlike body")] and [[tuple(p) for p in r[0]] for r in rows("bodies", "parents")] == [[("Null", 1), ("Star", 0)]]
    assert rows("body_materials", "name", "percent") == [("iron", 30.0)]
    assert [r.value for r in spark.read.parquet(str(tmp_path / "base" / "_unreadable")).collect()] == ["not json"]


def test_a_silent_stream_is_connected_anew(spark, tmp_path):
    _lines(spark, tmp_path, "1.log", {"event": "FSDJump", "SystemAddress": 1, "StarSystem": "Sol"})
    live = ingest.Ingest(spark, str(tmp_path / "base"), journal.handlers()[:1], readers.parsed)
    tries = []

    def connect():
        tries.append(1)
        return spark.readStream.text(str(tmp_path / "lines"))

    assert live.watch(connect, 3.0, poll=0.2, until=lambda: len(tries) > 1) == 1
    assert live.table("systems").count() == 1


def test_windows_bound_their_state(spark, tmp_path):
    stream = readers.stream(spark, "/root/testdata/sf0.001", S.EVENTS, pattern="events.parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    query = ingest.windowed(stream, "1 hour", "1 day").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM counted").first().n == 1000
