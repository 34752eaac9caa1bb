"""The six pages of the read interface, as HTML made of columns, and a small server for them.

``respond`` is a function of a path and its parameters; rows are streamed from the executors, so a list of
all systems is never held whole.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.describe import economy, or_dashes
from .operators import lookup, route, search, windows
from .plans.views import Catalogue

FOUND, MISSING, FAILED = 200, 404, 500
_FORM = '<form action="/systems"><input type="text" name="query" value="{}"><input type="submit" /></form>'


def escaped(value: Column) -> Column:
    text = value.cast("string")
    for char, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(by))
    return text


def cells(*values: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), v, F.lit("</td>")) for v in values], F.lit("</tr>"))


def position(x: Column, y: Column, z: Column) -> Column:
    return or_dashes(F.when(x.isNotNull(), F.concat_ws(", ", x.cast("string"), y.cast("string"), z.cast("string"))))


def link(href: Column, text: Column) -> Column:
    return F.concat(F.lit('<a href="'), href, F.lit('">'), escaped(text), F.lit("</a>"))


def _table(titles: str, rows: DataFrame, *order: str) -> Iterator[str]:
    yield "<table><tr>" + "".join(f"<th>{t}</th>" for t in titles.split("|")) + "</tr>"
    for r in rows.orderBy(*order).select("row").toLocalIterator():
        yield r.row
    yield "</table>"


def systems_page(c: Catalogue, query: str) -> Iterator[str]:
    found = search.like(c.systems, query)
    told = [or_dashes(escaped(F.col(k))) for k in ("security", "government", "allegiance")]
    row = cells(
        link(F.concat(F.lit("/systems/"), F.col("address").cast("string")), F.col("name")), position(F.col("x"), F.col("y"), F.col("z")), or_dashes(F.col("population")), *told,
        or_dashes(escaped(economy(F.col("primary_economy"), F.col("secondary_economy")))), or_dashes(F.col("updated_at")),
    )
    yield "<h1>Systems</h1>" + _FORM.format(html.escape(query))
    yield from _table("Name|Position|Population|Security|Government|Allegiance|Economy|Updated", found.withColumn("row", row), "name", "address")


def system_page(c: Catalogue, address: int) -> Iterator[str] | None:
    system = lookup.by_address(c.systems, c.system_factions, address).first()
    if system is None:
        return None
    here = f"/systems/{address}"

    def body() -> Iterator[str]:
        yield f"<h1>{html.escape(system.name)}</h1>" + _details(system.asDict(), ("population", "security", "government", "allegiance", "primary_economy", "updated_at"))
        stations = lookup.of_system(c.stations, address)
        yield from _table("Station|Type", stations.withColumn("row", cells(link(F.concat(F.lit(f"{here}/stations/"), escaped(F.col("name"))), F.col("name")), or_dashes(F.col("ty")))), "name")
        bodies = lookup.of_system(c.bodies, address)
        yield from _table("Body|Class", bodies.withColumn("row", cells(link(F.concat(F.lit(f"{here}/bodies/"), F.col("id").cast("string")), F.col("name")), or_dashes(escaped(F.col("class"))))), "id")

    return body()


def _details(row: dict, names: tuple[str, ...]) -> str:
    return "<dl>" + "".join(f"<dt>{n}</dt><dd>{html.escape(str(row[n])) if row[n] is not None else '---'}</dd>" for n in names) + "</dl>"


def one_page(c: Catalogue, found: DataFrame, address: int, names: tuple[str, ...]) -> Iterator[str] | None:
    row = found.first()
    if row is None:
        return None
    system = c.systems.filter(F.col("address") == address).select("name").first()
    return iter([f'<h1>{html.escape(row.name)}</h1><p><a href="/systems/{address}">{html.escape(system.name if system else "---")}</a></p>', _details(row.asDict(), names)])


def route_page(c: Catalogue, start: str, goal: str, range_ly: float) -> tuple[int, Iterator[str]]:
    ends = []
    for name, which in ((goal, "to"), (start, "from")):
        row = c.systems.filter(F.col("name") == name.upper()).orderBy("address").select("address", "name").first()
        if row is None:
            return FAILED, iter([f"Failed to fetch {which} system."])
        ends.append(row)
    to, origin = ends
    stops = windows.legs(route.route(c.systems, origin.address, to.address, range_ly)).join(c.systems.select("address", "name"), "address")
    if not stops.limit(1).count():
        return FAILED, iter(["Failed to find route (try increasing the range)."])
    # a row a jump
    held = [s.asDict() for s in stops.orderBy("hop").select("hop", "address", "name", "x", "y", "z", "leg").collect()]
    side = lambda s: f'<td><a href="/systems/{s["address"]}">{html.escape(s["name"])}</a></td><td>{s["x"]}, {s["y"]}, {s["z"]}</td>'
    rows = "".join(f"<tr>{side(a)}{side(b)}<td>{b['leg']} Ly</td></tr>" for a, b in zip(held, held[1:]))
    return FOUND, iter([f"<h3>{html.escape(origin.name)} -> {html.escape(to.name)}</h3><table><tr><th>Origin</th><th></th><th>Destination</th><th></th><th>Distance</th></tr>{rows}</table>"])


def respond(c: Catalogue, url: str) -> tuple[int, Iterator[str]]:
    """Status and page of ``url``."""
    at = urlsplit(url)
    given = {k: v[0] for k, v in parse_qs(at.query, keep_blank_values=True).items()}
    match [unquote(p) for p in at.path.split("/") if p]:
        case []:
            return FOUND, iter(["<h1>Systems</h1>" + _FORM.format("")])
        case ["systems"]:
            return FOUND, systems_page(c, given.get("query", ""))  # the empty pattern matches only an empty name
        case ["route"]:
            try:
                return route_page(c, given["from"], given["to"], float(given["range"]))
            except (KeyError, ValueError):
                return FAILED, iter(["Missing route params."])
        case ["systems", address, *rest] if address.lstrip("-").isdigit():
            number, what, page = int(address), "system", None
            match rest:
                case []:
                    page = system_page(c, number)
                case ["stations", name]:
                    what, page = "station", one_page(c, lookup.of_system(c.stations, number, name=name), number, ("ty", "market_id", "large", "medium", "small"))
                case ["bodies", id_] if id_.isdigit():
                    what, page = "body", one_page(c, lookup.of_system(c.bodies, number, id=int(id_)), number, ("class", "radius", "arrival", "atmosphere", "pressure"))
            return (FOUND, page) if page is not None else (MISSING, iter([f"No {what} with that address found."]))
    return MISSING, iter(["Not found."])


def server(c: Catalogue, port: int = 0) -> ThreadingHTTPServer:
    """A server of the pages; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, parts = respond(c, self.path)
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            for part in parts:
                self.wfile.write(part.encode())

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
