"""The filter list of a map view, compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import systems_of_faction


@dataclass(frozen=True)
class Filter:
    """One of: a faction, a route (addresses in order, with a range), a set of addresses."""

    faction: int | None = None
    addresses: tuple[int, ...] = ()
    range: float | None = None
    enabled: bool = True
    name: str | None = None

    @property
    def ordered(self) -> bool:
        return self.range is not None

    @property
    def hops(self) -> int | None:
        return len(self.addresses) - 1 if self.ordered and self.addresses else None

    def admits(self) -> Column:
        """Over rows with ``address`` and ``factions``."""
        if self.faction is not None:
            return F.array_contains("factions", self.faction)
        return F.col("address").isin(list(self.addresses)) if self.addresses else F.lit(False)

    def place_of(self) -> Column:
        """Where a row stands in the list, from 0; null if it doesn't."""
        if not self.addresses:
            return F.lit(None).cast("long")
        at = F.array_position(F.array(*[F.lit(a).cast("long") for a in self.addresses]), F.col("address"))
        return F.when(at > 0, at - 1)

    def summary(self, held: int) -> str:
        return f"{held} systems, {self.range:g} Ly range" if self.ordered else f"{held} systems"


def admitted(filters: list[Filter]) -> Column:
    """Any enabled filter admits; without an enabled one everything is admitted."""
    return _any([f.admits() for f in filters if f.enabled])


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(True)


def admission(filters: list[Filter]) -> tuple[list[int], list[int]] | None:
    """Factions and addresses to ask for; None, not empty lists, where no filter is enabled."""
    on = [f for f in filters if f.enabled]
    if not on:
        return None
    return [f.faction for f in on if f.faction is not None], [a for f in on for a in f.addresses]


def add(filters: list[Filter], new: Filter) -> list[Filter]:
    return filters if any(replace(f, enabled=new.enabled) == new for f in filters) else [*filters, new]


def toggle(filters: list[Filter], at: int) -> list[Filter]:
    return [replace(f, enabled=not f.enabled) if i == at else f for i, f in enumerate(filters)]


def toggle_all(filters: list[Filter]) -> list[Filter]:
    """All on if all are off, else all off."""
    on = not any(f.enabled for f in filters)
    return [replace(f, enabled=on) for f in filters]


def remove(filters: list[Filter], *places: int) -> list[Filter]:
    return [f for i, f in enumerate(filters) if i not in places]


def visible(hop: Column, within: Column, is_admitted: Column, dim: float) -> Column:
    return hop | (within & (is_admitted | F.lit(dim > 0)))


def spyglass(away: Column, radius: float, clear: bool) -> Column:
    return away <= radius if clear else F.lit(True)


def narrowed(filters: list[Filter], dim: float) -> tuple[list[int], list[int]] | None:
    """The admission that a query is narrowed to: only where what isn't admitted isn't drawn at all."""
    return admission(filters) if dim == 0 else None


def admitted_in_range(near: DataFrame, memberships: DataFrame, factions: list[int], addresses: list[int]) -> DataFrame:
    """Addresses in ``near`` that are listed or have a listed faction; each once."""
    listed = near.filter(F.col("address").isin(addresses)).select("address")
    held = memberships.filter(F.col("faction_id").isin(factions)).select(F.col("system_address").alias("address"))
    return listed.union(near.join(held, "address", "left_semi").select("address")).distinct()


def systems_of(one: Filter, systems: DataFrame, memberships: DataFrame, factions: DataFrame) -> DataFrame:
    """The systems that a filter is about: those of a faction, whose name is taken as a pattern, or those it lists."""
    if one.faction is not None:
        return systems_of_faction(systems, memberships, factions, one.name or "").drop("faction_id")
    return systems.filter(F.col("address").isin(list(one.addresses)))


def unspawned(picked: DataFrame, spawned: DataFrame) -> DataFrame:
    """Picked addresses not there yet, in the order of picking, each once."""
    first = picked.groupBy("address").agg(F.min("place").alias("place"))
    return first.join(spawned.select("address"), "address", "left_anti").orderBy("place")


def refreshes(known: tuple, wanted: tuple) -> bool:
    """Whether (centre, radius, admission) asks again for what is known."""
    return known[0] == wanted[0] and wanted[1] <= known[1] and known[2] == wanted[2]
