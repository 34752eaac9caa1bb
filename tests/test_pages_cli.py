"""The pages and the command line on the smallest tables."""

import threading
from urllib.request import urlopen

import pytest

from skyquarry import cli, pages
from skyquarry.plans.views import Catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def catalogue(spark):
    return Catalogue(spark, SF)


def got(c, url):
    status, parts = pages.respond(c, url)
    return status, "".join(parts)


def test_pages(catalogue):
    assert got(catalogue, "/")[0] == 200 and "form" in got(catalogue, "/")[1]
    status, text = got(catalogue, "/systems?query=%25%2300000001_")
    assert status == 200 and text.count("<tr>") == 11 and "CUSTOMER#000000010" in text and "---" in text
    assert got(catalogue, "/systems")[1].count("<tr>") == 1  # the empty pattern matches only an empty name
    status, text = got(catalogue, "/systems/4")
    assert status == 200 and "<h1>CUSTOMER#000000004</h1>" in text and "/systems/4/stations/Supplier#000000004" in text and "/systems/4/bodies/1" in text
    assert "<h1>Supplier#000000004</h1>" in got(catalogue, "/systems/4/stations/Supplier%23000000004")[1]
    status, text = got(catalogue, "/systems/4/bodies/3")
    assert status == 200 and '<a href="/systems/4">' in text and "class" in text
    for url, said in (("/systems/999999", "system"), ("/systems/4/stations/none", "station"), ("/systems/4/bodies/99", "body")):
        assert got(catalogue, url) == (404, f"No {said} with that address found.")
    assert got(catalogue, "/route?from=x") == (500, "Missing route params.") and got(catalogue, "/elsewhere")[0] == 404
    assert got(catalogue, "/route?from=CUSTOMER%23000000001&to=nowhere&range=9") == (500, "Failed to fetch to system.")
    assert got(catalogue, "/route?from=CUSTOMER%23000000001&to=CUSTOMER%23000000042&range=0.1")[1].startswith("Failed to find route")
    status, text = got(catalogue, "/route?from=customer%23000000001&to=customer%23000000042&range=80")
    assert status == 200 and "CUSTOMER#000000001 -> CUSTOMER#000000042" in text and text.count("<tr>") >= 2


def test_markup_is_escaped(catalogue, spark):
    class Other:
        systems = catalogue.systems.selectExpr("*").limit(1).withColumn("name", pages.F.lit("<b>&\"'"))

    assert "&lt;b&gt;&amp;&quot;&#x27;" in "".join(pages.systems_page(Other, "%")) and "<b>" not in "".join(pages.systems_page(Other, "%"))


def test_server(catalogue):
    server = pages.server(catalogue)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urlopen(f"http://127.0.0.1:{server.server_port}/systems/4") as r:
            assert r.status == 200 and "CUSTOMER#000000004" in r.read().decode()
    finally:
        server.shutdown()


def said(c, *argv):
    args = cli.parser().parse_args(["--tables", SF, *argv])
    return list((cli.found if args.command == "search" else cli.plotted)(c, args))


def test_command_line(catalogue):
    assert said(catalogue, "search", "-s", "%#00000001_", "-c") == ["10 systems found."]
    assert said(catalogue, "search", "-f", "supplier%", "-r", "5", "-c") == [f"{catalogue.factions.count()} factions found."]
    assert said(catalogue, "search")[0].startswith("usage") and said(catalogue, "search", "-s", "a", "-f", "b")[0].startswith("usage")
    one = said(catalogue, "search", "-s", "customer#000000004")
    assert len(one) == 1 and one[0].startswith("Name: CUSTOMER#000000004") and "\tbodies:\n\t\t- " in one[0]
    assert len(said(catalogue, "search", "-s", "customer#000000042", "-r", "40")) >= 1
    plot = said(catalogue, "route", "customer#000000001", "customer#000000042", "-r", "80")
    assert plot[0] == "Origin | Destination | Distance" and plot[-1].startswith("jumps: ") and plot[1].startswith("CUSTOMER#000000001 | ")
    assert said(catalogue, "route", "nobody", "customer#000000042") == ["No system named nobody"]
    assert said(catalogue, "route", "customer#000000001", "customer#000000042", "-r", "0.1") == ["No route from customer#000000001 to customer#000000042 at 0.1 Ly"]
