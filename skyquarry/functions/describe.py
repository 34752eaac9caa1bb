"""Classification, sizes and wording as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import LIGHT_SECOND, LIGHT_YEAR

# What is drawn in which hue.
ALLEGIANCE_HUE = {"Alliance": "Green", "Empire": "Cyan", "Federation": "Red", "PilotsFederation": "Orange", "PlayerPilots": "Yellow", "Independent": "Yellow", "Guardian": "Blue", "Thargoid": "Magenta"}
GOVERNMENT_HUE = {"Anarchy": "Yellow", "Carrier": "Green", "Communism": "Red", "Confederacy": "Red", "Cooperative": "Orange", "Corporate": "Cyan", "Democracy": "Blue", "Dictatorship": "Red", "Engineer": "Magenta", "Feudal": "Red", "Patronage": "Red", "Prison": "Red", "PrisonColony": "Red", "Theocracy": "Blue"}
SECURITY_HUE = {"High": "Blue", "Medium": "Cyan", "Low": "Green", "Anarchy": "Red"}
# Star classes by how they begin and planets by what they are called, in this order.
GLOW = ((("D",), "White"), (("N", "H"), "Odd"), (("W", "C"), "Odd"), (("SUPERMASSIVE",), "Odd"), (("O", "B"), "Blue"), (("A", "F"), "White"), (("G",), "Yellow"), (("K",), "Orange"), (("M", "L", "T", "Y"), "Red"))
SURFACE = (("earthlike", "Earthlike"), ("gas giant", "Gas"), ("water world", "Water"), ("water giant", "Water"), ("ammonia", "Ammonia"), ("rocky ice", "Icy"), ("icy", "Icy"), ("ice", "Icy"), ("metal", "Metal"), ("rocky", "Rocky"))
# Fuel by class of drive, exponent by size, rungs of detail by pixels.
FUEL = {"A": 12.0, "B": 10.0, "C": 8.0, "D": 10.0, "E": 11.0}
EXPONENT = {2: 2.0, 3: 2.15, 4: 2.3, 5: 2.45, 6: 2.6, 7: 2.75, 8: 2.9}
RUNGS = (0.0, 2.0, 8.0, 32.0, 128.0, 512.0, 2048.0)
RUNG_HOLD = 0.7
# Metres in a solar radius, metres per second squared in a gravity, pascals in an atmosphere.
SOLAR_RADIUS, GRAVITY, ATMOSPHERE = 6.957e8, 9.80665, 101_325.0
UNKNOWN = "Unknown"


def hue(column: str, hues: dict[str, str]) -> Column:
    out = F.lit("Grey")
    for value, h in hues.items():
        out = F.when(F.col(column) == value, h).otherwise(out)
    return out


def glow(star_class: Column) -> Column:
    name, out = F.upper(F.trim(star_class)), F.lit("Odd")
    for starts, g in reversed(GLOW):
        out = F.when(_any([F.startswith(name, F.lit(s)) for s in starts]), g).otherwise(out)
    return out


def surface(planet_class: Column) -> Column:
    name, out = F.lower(planet_class), F.lit("Unknown")
    for word, s in reversed(SURFACE):
        out = F.when(F.contains(name, F.lit(word)), s).otherwise(out)
    return out


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def fuel(distance: Column, mass: float, optimal_mass: float, size: int, drive: str) -> Column:
    return FUEL[drive] * 0.001 * F.pow(distance * mass / optimal_mass, F.lit(EXPONENT[size]))


def population_factor(population: Column, average: Column) -> Column:
    ratio = F.greatest(F.coalesce(population, F.lit(0)) / average, F.lit(1.17549435e-38))
    return F.when(average <= 0, 1.0).otherwise(F.least(F.greatest(1 + 0.2 * F.ln(ratio), F.lit(0.25)), F.lit(4.0)))


def shell(extent: Column, away: Column, prominence: Column) -> Column:
    return extent * 1.2 + (F.least(F.lit(0.085 * LIGHT_YEAR), away * 4e-3) + away * 4e-4) * prominence


def lumens(radius: Column, temperature: Column) -> Column:
    r, t = F.greatest(radius, F.lit(0.0)), F.greatest(temperature, F.lit(0.0))
    return 4 * math.pi * r * r * 5.670374419e-8 * (t * t * t * t) * 93


def standing(seen: Column) -> Column:
    return 1 - F.least(F.greatest((seen - 0.0125) / (0.05 - 0.0125), F.lit(0.0)), F.lit(1.0))


def rung(pixels: Column) -> Column:
    """The rung of detail that a size asks for, with none held before."""
    return sum((F.when(pixels >= r, 1).otherwise(0) for r in RUNGS[2:]), F.when(pixels >= RUNGS[1], 1).otherwise(0))


def settled_rung(held: Column, pixels: Column) -> Column:
    """From the rung held: up as far as asked, down only past the hold."""
    down = F.lit(0)
    for i, r in enumerate(RUNGS):
        down = F.when((held >= i) & (pixels >= r * RUNG_HOLD), i).otherwise(down)
    return F.greatest(rung(pixels), down)


def economy(primary: Column, secondary: Column) -> Column:
    """Both, where there is a primary; a lone secondary reads as none."""
    return F.when(primary.isNotNull(), F.concat_ws("/", primary, secondary))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def spanning(metres: Column) -> Column:
    far = F.concat(F.format_string("%.2f", metres / LIGHT_SECOND), F.lit(" Ls"))
    return F.when(metres >= LIGHT_SECOND, far).otherwise(F.concat(thousands(F.floor(metres / 1000)), F.lit(" km")))


def spent(seconds: Column) -> Column:
    days = seconds / 86400
    said = F.when(days >= 1, F.format_string("%.1f days", days)).otherwise(F.format_string("%.1f hours", days * 24))
    return F.when(seconds <= 0, "Unknown").otherwise(said)


def plate(name: Column, jump: Column) -> Column:
    return F.when(jump.isNull(), F.upper(name)).otherwise(F.concat(F.upper(name), F.format_string(" %.1f Ly", jump)))


def stamped(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def clipped(name: Column, room: Column) -> Column:
    """``name`` in so many characters, with two dots for what was cut."""
    kept = F.concat(F.rtrim(F.substring(name, F.lit(1), room - 2)), F.lit(".."))
    return F.when(F.length(name) <= room, name).when(room <= 2, F.substring(F.lit(".."), F.lit(1), room)).otherwise(kept)


def shortened(label: Column, room: int) -> Column:
    """A route's label in so many characters: what room there is goes to both ends, or to the first if too little."""
    arrow = " -> "
    at = F.instr(label, arrow)
    start, end = F.substring(label, F.lit(1), at - 1), F.substring(label, at + len(arrow), F.length(label))
    names = max(room - len(arrow), 0)
    half = names // 2
    first = F.when(F.length(start) <= half, F.length(start)).when(F.length(end) <= half, names - F.length(end)).otherwise(names - half)
    both = F.concat(clipped(start, first), F.lit(arrow), clipped(end, F.lit(names) - first))
    cut = clipped(label, F.lit(room)) if names < 6 else both
    return F.when((at == 0) | (F.length(label) <= room), label).otherwise(cut)


def or_dashes(value: Column) -> Column:
    """A value on a page, or what stands for a missing one."""
    return F.coalesce(value.cast("string"), F.lit("---"))


def _said(form: str, value: Column) -> Column:
    """``value`` as ``form`` says; what lies halfway goes to the even digit."""
    digits = int(form.split(".")[1][0])
    return F.when(value.isNotNull(), F.format_string(form, F.bround(value.cast("double"), digits)))


def light_seconds_away(away: Column) -> Column:
    return F.coalesce(_said("%.1f Ls", away), F.lit(UNKNOWN))


def kilometres(metres: Column) -> Column:
    return F.concat(thousands(F.floor(metres / 1e3)), F.lit(" km"))


def solar_radii(metres: Column) -> Column:
    return _said("%.3f Sol", metres / SOLAR_RADIUS)


def gravities(pull: Column) -> Column:
    return _said("%.2f g", pull / GRAVITY)


def atmospheres(pascals: Column) -> Column:
    return _said("%.3f atm", pascals / ATMOSPHERE)


def kelvins(temperature: Column) -> Column:
    return _said("%.0f K", temperature)


def degrees(angle: Column) -> Column:
    return _said("%.1f°", angle)


def star_said(stars: DataFrame) -> DataFrame:
    """``stars`` with what is said of each: its class, size and mass in suns, warmth and age."""
    age = F.concat(thousands(F.greatest(F.col("age_my"), F.lit(0))), F.lit(" million years"))
    return stars.withColumns({
        "class": F.concat("star_class", F.col("subclass").cast("string")), "radius_said": solar_radii(F.col("radius")), "mass": _said("%.3f Sol", F.col("stellar_mass")),
        "warmth": kelvins(F.col("temperature")), "age": age, "distance": light_seconds_away(F.col("arrival")), "magnitude": _said("%.2f", F.col("absolute_magnitude")),
    })


def body_said(bodies: DataFrame) -> DataFrame:
    """``bodies`` (planet_class, arrival, radius, mass, gravity, temperature, surface, rotation, tilt) with what is said of each;
    one without a surface says so once."""
    has = F.col("surface").isNotNull()
    return bodies.withColumns({
        "distance": light_seconds_away(F.col("arrival")), "radius_said": kilometres(F.col("radius")), "mass_said": _said("%.3f Earths", F.col("mass")), "gravity_said": gravities(F.col("gravity")), "warmth": kelvins(F.col("temperature")),
        "surface_said": F.when(~has, "None"), "pressure_said": F.when(has, atmospheres(F.col("surface.pressure"))), "turn": spent(F.col("rotation")), "tilt_said": degrees(F.col("tilt")),
    })


def route_label(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" -> "), last)
