"""Facts about the operators that fixed queries don't show."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyquarry.functions import describe as D
from skyquarry.operators import checks, labels, lookup, merge, orbit, route, search, spatial, windows
from skyquarry.operators import filters as P


def systems(spark, rows):
    return spark.createDataFrame(rows, "address long, name string, x double, y double, z double")


def test_escaping():
    assert search.escaped("Col 285 Sector") == "Col 285 Sector"
    assert search.escaped("100%") == r"100\%" and search.escaped("a_b") == r"a\_b" and search.escaped("a\\%b") == r"a\\\%b"


def test_ranked_search_without_a_place_falls_to_names(spark):
    df = systems(spark, [(1, "SOLAR", 0.0, 0.0, 0.0), (2, "SOL", 9.0, 0.0, 0.0), (3, "A SOL", 1.0, 0.0, 0.0), (4, "SOLO", None, None, None), (5, "X%Y", 0.0, 0.0, 0.0)])
    assert [r.address for r in search.ranked(df, "sol", 9).collect()] == [2, 1, 4, 3]
    assert [r.address for r in search.ranked(df, "sol", 2, near=(0, 0, 0)).collect()] == [2, 1]
    assert [r.address for r in search.ranked(df, "%", 9).collect()] == [5]


def test_located_stops_at_the_first_bad_name(spark):
    df = systems(spark, [(1, "SOL", 0.0, 0.0, 0.0), (2, "LOST", None, None, None)])
    assert [(r.asked, r.reason) for r in search.located(df, ["nope", "sol"]).collect()] == [("nope", "No system named nope")]
    assert [r.reason for r in search.located(df, ["sol", "lost"]).orderBy("place").collect()] == [None, "LOST has no position on record"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.floats(-50, 50))] * 3), max_size=25), st.floats(0, 30))
def test_band_join_is_the_cross_join(spark, points, radius):
    points = [p for p in points if all(v is not None for v in p) or all(v is None for v in p)]
    rows = [(i, "n", *p) for i, p in enumerate(points)]
    got = sorted((r.a_address, r.b_address) for r in spatial.band_join(systems(spark, rows), systems(spark, rows), radius).collect()) if rows else []
    near = lambda p, q: None not in p + q and math.sqrt(sum((a - b) * (a - b) for a, b in zip(p, q))) <= radius
    want = sorted((i, j) for i, p in enumerate(points) for j, q in enumerate(points) if near(p, q))
    assert got == want or radius < 1e-9


def test_band_join_counts_a_system_for_each_anchor(spark):
    df = systems(spark, [(1, "A", 0.0, 0.0, 0.0), (2, "A", 4.0, 0.0, 0.0), (3, "B", 2.0, 0.0, 0.0), (4, "A", None, None, None)])
    got = spatial.band_join(df.filter("name = 'A'"), df, 2.0).filter("b_address = 3")
    assert got.count() == 2


def test_framing(spark):
    one = spatial.framing(systems(spark, [(1, "a", 3.0, 4.0, 5.0)])).first()
    assert (one.middle_x, one.extent) == (3.0, 0.0)
    lopsided = spatial.framing(systems(spark, [(i, "a", float(x), 0.0, 0.0) for i, x in enumerate((0, 1, 2, 100))] + [(9, "b", None, None, None)])).first()
    assert (lopsided.middle_x, lopsided.extent) == (50.0, 50.0)
    assert spatial.framing(systems(spark, [(1, "a", None, None, None)])).collect() == []
    assert spatial.settled(1, 6.9, 2) == 1 and spatial.settled(1, 7.1, 2) == 2 and spatial.settled(None, None, None) is None


def test_filters(spark):
    df = spark.createDataFrame([(1, [7]), (2, []), (3, [8, 9])], "address long, factions array<int>")
    picked = lambda fs: sorted(r.address for r in df.filter(P.admitted(fs)).collect())
    assert picked([]) == [1, 2, 3] and picked([P.Filter(faction=7, enabled=False)]) == [1, 2, 3]
    assert picked([P.Filter(faction=9), P.Filter(addresses=(2,))]) == [2, 3] and picked([P.Filter(addresses=())]) == []
    assert P.admission([]) is None and P.admission([P.Filter(faction=1), P.Filter(addresses=(4, 5), range=9.0)]) == ([1], [4, 5])
    assert P.narrowed([P.Filter(faction=1)], 0.5) is None
    two = P.add(P.add([], P.Filter(faction=1)), P.Filter(faction=1))
    assert len(two) == 1 and not P.toggle(two, 0)[0].enabled and P.toggle_all(P.toggle(two, 0))[0].enabled and P.remove(two, 0) == []
    plotted = P.Filter(addresses=(5, 6, 7), range=10.0)
    assert plotted.hops == 2 and plotted.summary(3) == "3 systems, 10 Ly range" and P.Filter(faction=1).summary(4) == "4 systems"
    assert P.refreshes(((0, 0, 0), 10, None), ((0, 0, 0), 8, None)) and not P.refreshes(((0, 0, 0), 10, None), ((0, 0, 0), 8, ([1], [])))


def test_unspawned_keeps_the_order_of_picking(spark):
    picked = spark.createDataFrame([(9, 0), (4, 1), (9, 2), (5, 3)], "address long, place int")
    assert [r.address for r in P.unspawned(picked, spark.createDataFrame([(4,)], "address long")).collect()] == [9, 5]


def test_shortest_route(spark):
    rng = random.Random(7)
    places = {i: tuple(rng.uniform(0, 100) for _ in range(3)) for i in range(80)}
    df = systems(spark, [(i, "s", *p) for i, p in places.items()] + [(99, "lost", None, None, None)])
    hop, frontier = {0: 0}, [0]
    while frontier:
        frontier = sorted({j for i in frontier for j in places if j not in hop and math.dist(places[i], places[j]) <= 25})
        hop |= dict.fromkeys(frontier, max(hop.values()) + 1)
    goal = max(hop, key=hop.get)
    stops = sorted(route.route(df, 0, goal, 25.0).collect(), key=lambda r: r.hop)
    assert [r.hop for r in stops] == list(range(hop[goal] + 1)) and stops[0].address == 0 and stops[-1].address == goal
    assert all(math.dist(a[3:], b[3:]) <= 25 for a, b in zip(stops, stops[1:]))
    assert len(route.route(df, 0, goal, 25.0, max_jumps=hop[goal]).collect()) == hop[goal] + 1
    assert route.route(df, 0, goal, 25.0, max_jumps=hop[goal] - 1).collect() == []
    assert [r.hop for r in route.route(df, 0, 0, 25.0).collect()] == [0]
    assert route.route(df, 0, 99, 25.0).collect() == []
    assert route.message(route.route(df, 0, 99, 25.0), "A", "B", "25").first().message == "No route from A to B at 25 Ly"


@pytest.mark.parametrize("radius", [0.0, 9.0, 40.0])
def test_near_any_is_the_cross_join(spark, radius):
    rng = random.Random(11)
    crowd = [tuple(at + rng.uniform(-2, 2) for _ in range(3)) for at in (0, 15, 22) for _ in range(40)]
    points = crowd + [tuple(rng.uniform(-60, 60) for _ in range(3)) for _ in range(60)] + [(0.0, 0.0, 0.0), (9.0, 0.0, 0.0), (-40.0, 0.0, 0.0), (float("nan"), 0.0, 0.0), (float("inf"), 0.0, 0.0), (1.0, None, 1.0)]
    df = spatial.tiled(systems(spark, [(i, "s", *p) for i, p in enumerate(points)]).drop("name"), radius)
    far = lambda p, q: math.sqrt(sum((a - b) * (a - b) for a, b in zip(p, q)))
    known = {i for i, p in enumerate(points) if None not in p and all(map(math.isfinite, p))}
    some = df.filter("address % 4 = 0")
    want = [i for i in sorted(known) if any(far(points[i], points[j]) <= radius for j in known if j % 4 == 0)]
    assert sorted(r.address for r in spatial.near_any(df, some, radius).collect()) == want
    assert sorted(r.address for r in spatial.near_any_boxed(spatial.boxed(df), spatial.boxed(some), radius).collect()) == want


def test_hops_through_crowds_are_not_multiplied_out(spark):
    # ends of a line of three crowds, each within range of the next: 3.2e9 pairs
    crowd = spark.range(1, 120_001).selectExpr("id AS address", "'s' AS name", "double(id % 3) * 30 + id % 100 / 100.0D AS x", "id % 89 / 100.0D AS y", "id % 97 / 100.0D AS z")
    ends = systems(spark, [(0, "start", -39.5, 0.0, 0.0), (200_000, "goal", 100.5, 0.0, 0.0)])
    seen = []
    spatial_boxed = route.near_any_boxed
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(route, "near_any_boxed", lambda *a: seen.append(a) or spatial_boxed(*a))
        assert [tuple(r) for r in route.hops(crowd.union(ends), 0, 200_000, 40.0).collect()] == [(200_000, 4)]
    assert seen


def test_route_by_boxes_comes_from_least_addresses(spark, monkeypatch):
    monkeypatch.setattr(route, "FEW", 0)
    rows = [(0, "s", 0.0, 0.0, 0.0), (9, "s", 10.0, 0.0, 0.0), (3, "s", 9.0, 1.0, 0.0), (5, "s", 9.0, -1.0, 0.0), (8, "s", 18.0, 0.0, 0.0), (7, "s", 18.0, 0.5, 0.0), (4, "s", 27.0, 0.0, 0.0), (None, "s", 1.0, 0.0, 0.0)]
    assert [(r.hop, r.address) for r in route.route(systems(spark, rows), 0, 4, 10.0).orderBy("hop").collect()] == [(0, 0), (1, 3), (2, 7), (3, 4)]
    assert "parent" not in route.levels(systems(spark, rows), 0, 10.0).columns


def test_route_looks_only_between_its_ends(spark, monkeypatch):
    crowd = [(100 + i, "s", -5.0 - i % 20, float(i % 7), i % 11 / 10) for i in range(300)]
    line = [(i, "s", 9.0 * i, 0.0, 0.0) for i in range(5)]
    seen, tiled = [], route.tiled
    monkeypatch.setattr(route, "MANY", 0, raising=False)
    monkeypatch.setattr(route, "tiled", lambda df, radius: seen.append(df.count()) or tiled(df, radius))
    assert [r.address for r in route.route(systems(spark, crowd + line), 0, 4, 10.0).orderBy("hop").collect()] == [0, 1, 2, 3, 4]
    assert seen and max(seen) <= len(line)


def test_routes_with_detours_are_the_plain_search(spark, monkeypatch):
    monkeypatch.setattr(route, "MANY", 0)
    # a way around, far longer than the straight line; one jump more than that; positions not finite; one system at two places
    rows = [(0, 0.0, 0.0, 0.0), (6, 12.0, 0.0, 0.0), (1, 0.0, 8.0, 0.0), (2, 0.0, 16.0, 0.0), (3, 9.0, 16.0, 0.0), (4, 12.0, 8.0, 0.0), (5, 19.0, 2.0, 0.0), (7, 19.0, -6.0, 0.0), (8, 25.0, 3.0, 0.0), (8, 90.0, 0.0, 0.0), (9, math.inf, 0.0, 0.0), (10, 50.0, 0.0, 0.0)]
    df = systems(spark, [(a, "s", *p) for a, *p in rows])
    far = lambda p, q: math.dist(p[1:], q[1:])

    def plain(start, goal):
        level = [[r for r in rows if r[0] == start]]
        while level[-1] and not any(r[0] == goal for r in level[-1]):
            known = {r for rs in level for r in rs}
            level.append([r for r in rows if r not in known and any(far(r, q) <= 10 for q in level[-1])])
        stops = [min(r for r in level.pop() if r[0] == goal)] if level[-1] else []
        while stops and level:
            stops.append(min(r for r in level.pop() if far(r, stops[-1]) <= 10))
        return stops[::-1]

    for start, goal in ((0, 6), (0, 8), (0, 10)):
        want = plain(start, goal)
        assert [(r.address, r.x, r.y, r.z) for r in route.route(df, start, goal, 10.0).orderBy("hop").collect()] == want, (start, goal)
    assert route.route(df, 0, 6, 10.0, max_jumps=len(plain(0, 6)) - 2).collect() == []


def test_drawn_legs(spark):
    ly = spatial.LIGHT_YEAR
    rows = [(0, i, x * ly, 0.0, 0.0, s) for i, (x, s) in enumerate([(0, True), (10, True), (20, False), (30, False)])]
    got = [(r.hop, r.part, r.start, r.end) for r in windows.drawn_legs(spark.createDataFrame(rows, "route int, hop int, x double, y double, z double, shown boolean")).orderBy("hop", "part").collect()]
    assert got[0] == (0, 0, 0.0, 1.0) and got[1] == (1, 0, 0.0, 0.35) and {h for h, *_ in got} == {0, 1}
    want, at = [], 3.5 + 0.5
    while at + 0.5 <= 10 - 0.5:
        want.append((at / 10, (at + 0.5) / 10))
        at += 1
    assert [(pytest.approx(a), pytest.approx(b)) for _, _, a, b in got[2:]] == want


def body(spark, rows):
    cols = "system_address long, id int, parent_id int, semi_major_axis double, eccentricity double, inclination double, periapsis double, ascending_node double, mean_anomaly double, orbital_period double, radius double, arrival double"
    return spark.createDataFrame(rows, cols)


def test_kepler_inverts(spark):
    grid = [(e, m * math.tau / 24) for e in (0.01, 0.2, 0.5, 0.9, 0.99) for m in range(24)]
    df = spark.createDataFrame(grid, "e double, m double").withColumn("anomaly", orbit.eccentric_anomaly(F.col("m"), F.col("e")))
    for r in df.collect():
        assert r.anomaly - r.e * math.sin(r.anomaly) == pytest.approx(r.m, abs=1e-8)


def test_orbit_positions(spark):
    rows = [(1, 0, None, 1e11, 0.5, 0.0, 0.0, 0.0, 0.0, 1000.0, 0.0, 0.0), (1, 1, None, 1e11, 0.5, 0.0, 0.0, 0.0, 180.0, 1000.0, 0.0, 0.0), (1, 2, None, -1.0, 0.5, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0), (1, 3, None, 1e11, 0.0, 30.0, 20.0, 10.0, 40.0, 0.0, 0.0, 0.0)]
    at = lambda t: {r.id: (r.x, r.y, r.z) for r in orbit.positions(body(spark, rows), t).collect()}
    now, later, turned = at(0.0), at(400.0), at(1000.0)
    assert math.dist(now[0], (0, 0, 0)) == pytest.approx(0.5e11) and math.dist(now[1], (0, 0, 0)) == pytest.approx(1.5e11)
    assert now[2] == (0, 0, 0) and now[3] == later[3] and now[3][1] != 0
    assert all(math.dist(now[i], turned[i]) < 1e-3 * 1e11 for i in now) and math.dist(now[0], later[0]) > 1e10


def test_hierarchy(spark):
    circle = lambda i, p, a, r=0.0, arrival=0.0: (1, i, p, a, 0.0, 0.0, 0.0, 0.0, 0.0, 1000.0, r, arrival)
    rows = [circle(0, None, 0.0), circle(10, 0, 1e11), circle(11, 10, 1e9), circle(12, 77, 5e9), circle(13, 13, 1.0)]
    where = {r.id: r.x for r in orbit.absolute(orbit.positions(body(spark, rows), 0.0)).collect()}
    assert where[11] == pytest.approx(1e11 + 1e9) and where[12] == pytest.approx(5e9) and where[13] == pytest.approx(16.0)
    assert orbit.primaries(body(spark, [circle(2, None, 0.0, arrival=1e5), circle(1, None, 0.0)])).first().primary_id == 1
    small = body(spark, [circle(0, None, 0.0, 5.0)])
    assert orbit.extents(small, orbit.absolute(orbit.positions(small, 0.0)), orbit.primaries(small)).first().extent == orbit.STAND_IN


def test_unridden_barycenters_are_left_out(spark):
    bodies = spark.createDataFrame([(1, 11, [10, 1]), (1, 12, [10])], "system_address long, id int, parent_ids array<int>")
    stars = spark.createDataFrame([(1, 1, [])], "system_address long, id int, parent_ids array<int>")
    centres = spark.createDataFrame([(1, 10, None), (1, 20, None)], "system_address long, id int, parent_id int")
    assert {(r.id, r.parent_id) for r in orbit.assembled(stars, bodies, centres).collect()} == {(1, None), (11, 10), (12, 10), (10, 1)}


def events(spark, rows):
    return spark.createDataFrame([(k, a, b, t, i, i) for i, (k, a, b, t) in enumerate(rows)], "address long, population long, government string, updated_at timestamp_ntz, arrival long, event_id long")


def test_upsert_disciplines(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    now = spark.createDataFrame([(1, 5, "Feudal", day(10))], "address long, population long, government string, updated_at timestamp_ntz")
    rows = events(spark, [(1, 6, None, day(12)), (1, 7, "Prison", day(11)), (1, None, None, day(12)), (2, 1, None, day(1))])
    guarded = {r.address: (r.population, r.government, r.updated_at.day) for r in merge.guarded_upsert(now, rows, ["address"], ["population", "government"]).collect()}
    assert guarded == {1: (6, "Feudal", 12), 2: (1, None, 1)}
    arrived = {r.address: (r.population, r.government, r.updated_at.day) for r in merge.arrival_upsert(now, rows, ["address"], ["population", "government"]).collect()}
    assert arrived == {1: (7, "Prison", 12), 2: (1, None, 1)}
    whole = merge.guarded_upsert(now, events(spark, [(1, None, "War", day(20))]), ["address"], ["population", "government"], coalesced=False).first()
    assert (whole.population, whole.government) == (None, "War")


def test_change_capture(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, 0.5, day(2)), (1, 1, 0.5, day(3)), (1, 1, 0.9, day(1)), (1, 1, 0.7, day(4)), (1, 1, 0.5, day(4)), (1, 2, 0.1, day(9))]
    df = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "system_address long, faction_id int, influence double, updated_at timestamp_ntz, arrival long, event_id long")
    assert [(r.old_influence, r.new_influence, r.old_timestamp.day, r.new_timestamp.day) for r in merge.influence_changes(df).collect()] == [(0.5, 0.7, 3, 4)]


def test_get_or_create(spark):
    names = spark.createDataFrame([("The Blue", 3), ("the blue", 5), ("Red", 1), ("RED", 2), ("New", 9)], "name string, arrival long")
    assert {(r.id, r.name) for r in merge.canonical_factions(names).collect()} == {(1, "Red"), (2, "The Blue"), (3, "New")}
    have = spark.createDataFrame([(7, "red")], "id int, name string")
    assert {(r.id, r.name) for r in merge.canonical_factions(names, have).collect()} == {(7, "red"), (8, "The Blue"), (9, "New")}


def test_ancestors(spark):
    row = spark.sql("SELECT array(3, 1, 0) AS ids, array('Star') AS types, array(map('Null', 2), map('Star', 1)) AS maps")
    got = row.select(merge.parents_of(F.col("ids"), F.col("types")).alias("p"), merge.flattened_parents(F.col("maps")).alias("m")).first()
    assert [tuple(p) for p in got.p] == [("Star", 3), (None, 1), (None, 0)] and [tuple(p) for p in got.m] == [("Null", 2), ("Star", 1)]


def test_greedy_labels(spark):
    rows = [("v", 1, 5.0, 0.0, 0.0, 10.0, 2.0), ("v", 2, 9.0, 8.0, 0.0, 18.0, 2.0), ("v", 3, 1.0, 0.0, 5.0, 9.0, 7.0), ("w", 4, 0.0, 0.0, 0.0, 1.0, 1.0), ("v", 5, 9.0, 9.0, 1.0, 12.0, 3.0)]
    df = spark.createDataFrame(rows, "view string, id long, score double, left double, top double, right double, bottom double")
    assert {r.id for r in labels.placed(df).collect()} == {2, 3, 4}


def test_wording(spark):
    one = spark.range(1)
    say = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert say(D.shortened(lit("SOL -> LAVE"), 20)) == "SOL -> LAVE" and say(D.shortened(lit("COL 285 SECTOR -> LAVE"), 16)) == "COL 28.. -> LAVE"
    assert say(D.shortened(lit("ABCDEFGH -> ABCDEFGH"), 14)) == "ABC.. -> ABC.." and say(D.shortened(lit("ABCDEFGH -> ABCDEFGH"), 8)) == "ABCDEF.." and say(D.shortened(lit("no arrow here"), 4)) == "no arrow here"
    assert say(D.clipped(lit("AB CD"), lit(5))) == "AB CD" and say(D.clipped(lit("AB CDE"), lit(5))) == "AB.." and say(D.clipped(lit("ABC"), lit(1))) == "."
    assert say(D.spanning(lit(1.5e6))) == "1,500 km" and say(D.spanning(lit(2.99792458e8))) == "1.00 Ls"
    assert say(D.spent(lit(0.0))) == "Unknown" and say(D.spent(lit(86400.0))) == "1.0 days" and say(D.spent(lit(3600.0))) == "1.0 hours"
    assert say(D.plate(lit("sol"), lit(None).cast("double"))) == "SOL" and say(D.plate(lit("sol"), lit(4.26))) == "SOL 4.3 Ly"
    assert say(D.economy(lit("Service"), lit(None).cast("string"))) == "Service" and say(D.economy(lit(None).cast("string"), lit("Service"))) is None
    assert say(D.settled_rung(lit(3), lit(6.0))) == 2 and say(D.settled_rung(lit(3), lit(23.0))) == 3 and say(D.settled_rung(lit(0), lit(600.0))) == 5
    assert say(D.population_factor(lit(0), lit(10.0))) == 0.25 and say(D.population_factor(lit(5), lit(0.0))) == 1.0
    assert say(D.lumens(lit(-1.0), lit(5.0))) == 0 and say(D.glow(lit(" supermassiveBlackHole "))) == "Odd" and say(D.surface(lit(None).cast("string"))) == "Unknown"


def test_checks(spark):
    df = spark.createDataFrame([(1, None, None), (1, 2, None), (2, 2, 3)], "k int, a int, b int")
    assert [tuple(r) for r in checks.repeated(df, "k").collect()] == [(1, 2)]
    assert checks.partly_there(df, "a", "b").count() == 1
    assert [r.a for r in checks.orphans(df, spark.createDataFrame([(3,)], "id int"), {"a": "id"}).collect()] == [2, 2]


def test_lookup_keeps_empty_arrays(spark):
    held = spark.createDataFrame([(1, 3), (1, 2)], "system_address long, faction_id int")
    got = {r.address: r.factions for r in lookup.with_factions(systems(spark, [(1, "A", 0.0, 0.0, 0.0), (2, "B", 0.0, 0.0, 0.0)]), held).collect()}
    assert got == {1: [2, 3], 2: []}


def test_labels_stand_as_in_a_plain_layout(spark):
    rng = random.Random(11)
    rows = [(f"v{i % 3}", i, rng.choice([rng.random(), 0.5]), (x := rng.uniform(-50, 50)), (y := rng.uniform(-20, 20)), x + rng.uniform(0, 9), y + rng.uniform(0, 3)) for i in range(600)]
    got = {(r.view, r.id) for r in labels.placed(spark.createDataFrame(rows, "view string, id int, score double, left double, top double, right double, bottom double")).collect()}
    want = []
    for v, i, s, *box in sorted(rows, key=lambda r: (-r[2], r[1])):
        if all(v != w or box[2] <= b[0] or b[2] <= box[0] or box[3] <= b[1] or b[3] <= box[1] for w, _, b in want):
            want.append((v, i, box))
    assert got == {(v, i) for v, i, _ in want}
    one = labels.screens(spark.createDataFrame([(1, 1.0, -1.0, 41.0, 3.0, 42.0)], "id int, score double, left double, top double, right double, bottom double"), 60.0, 40.0)
    assert one.first().view == "-1:1"


def test_band_join_at_a_radius_near_nothing(spark):
    df = systems(spark, [(1, "A", 10.0, 0.0, 0.0), (2, "A", 10.0, 0.0, 0.0), (3, "B", -2.0, 0.0, 0.0)])
    assert {(r.a_address, r.b_address) for r in spatial.band_join(df, df, 1e-300).collect()} >= {(1, 1), (1, 2), (2, 1), (2, 2)}
