"""The command line: search for systems or factions, and routes between systems."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import route, search, spatial, windows
from .plans.views import Catalogue
from .sources import writers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="skyquarry")
    out.add_argument("--tables", required=True, help="folder of the tables")
    commands = out.add_subparsers(dest="command", required=True)
    find = commands.add_parser("search")
    find.add_argument("-s", "--system-like")
    find.add_argument("-f", "--faction-like")
    find.add_argument("-r", "--radius", type=float)
    find.add_argument("-d", "--diameter", type=float)  # read, and not used
    find.add_argument("-c", "--count", action="store_true")
    plot = commands.add_parser("route")
    plot.add_argument("start")
    plot.add_argument("end")
    plot.add_argument("-r", "--range", type=float, default=7.5)
    plot.add_argument("-m", "--mass", type=float, default=25.0)  # the ship is read, and a route doesn't ask for it
    plot.add_argument("-o", "--optimal-mass", type=float, default=48.0)
    plot.add_argument("-s", "--size", type=int, default=2)
    plot.add_argument("-c", "--drive", default="E")
    return out


def found(c: Catalogue, args: argparse.Namespace) -> Iterator[str]:
    if bool(args.system_like) == bool(args.faction_like):
        yield parser().format_help()
        return
    if args.faction_like:  # the radius is not asked
        factions = search.like(c.factions, args.faction_like)
        if args.count:
            yield f"{factions.count()} factions found."
        else:
            yield from (f"{f.id}: {f.name}" for f in factions.toLocalIterator())
        return
    systems = search.like(c.systems, args.system_like)
    if args.radius is not None:
        met = spatial.band_join(systems, c.systems, args.radius)
        systems = met.select([F.col(f"b_{x}").alias(x) for x in c.systems.columns])
    if args.count:
        yield f"{systems.count()} systems found."
        return
    bodies = c.bodies.join(systems.select(F.col("address").alias("system_address")).distinct(), "system_address", "left_semi")
    named = bodies.groupBy(F.col("system_address").alias("address")).agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("bodies"))
    lines = writers.record(systems).join(named, "address", "left")
    for r in lines.orderBy("text", "address").toLocalIterator():
        yield r.text + ("\n\tbodies:" + "".join(f"\n\t\t- {b.name}" for b in r.bodies) if r.bodies else "")


def plotted(c: Catalogue, args: argparse.Namespace) -> Iterator[str]:
    ends = search.located(c.systems, [args.start, args.end]).orderBy("place").collect()  # two rows
    if bad := [e.reason for e in ends if e.reason]:
        yield bad[0]
        return
    stops = windows.legs(route.route(c.systems, ends[0].address, ends[1].address, args.range))
    names = stops.join(c.systems.select("address", "name"), "address").orderBy("hop").select("hop", "name", "x", "y", "z", "leg").collect()  # a row a jump
    if not names:
        yield f"No route from {args.start} to {args.end} at {args.range:g} Ly"
        return
    yield "Origin | Destination | Distance"
    yield from (f"{a.name} | {b.name} | {b.leg:.2f} Ly" for a, b in zip(names, names[1:]))
    a, b = names[0], names[-1]
    straight = ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) ** 0.5
    yield f"jumps: {len(names) - 1:.2f}, path: {sum(n.leg or 0 for n in names):.2f} Ly, distance: {straight:.2f} Ly"


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    c = Catalogue(SparkSession.builder.getOrCreate(), args.tables)
    for line in (found if args.command == "search" else plotted)(c, args):
        print(line)


if __name__ == "__main__":
    main(sys.argv[1:])
