"""The catalogue's tables, derived from the star-schema tables by plain arithmetic.

Each definition is one SQL text for both engines; what they spell differently is between ``@`` signs
and filled in for each. Spark reads them as DataFrames, the oracle as common table expressions.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def case(expr: str, values: tuple[str, ...]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_KINDS = ("War", "CivilWar", "Election")


def _axis(times: int, modulus: int, off: int) -> str:
    return f"CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE (c_custkey * {times} % {modulus}) / 10 - {off} END"


TEMPLATES = {
    "systems": f"""
        SELECT c_custkey AS address, upper(c_name) AS name,
               {_axis(7919, 2003, 100)} AS x, {_axis(104729, 1009, 50)} AS y, {_axis(1299709, 1511, 75)} AS z,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(floor(abs(c_acctbal) * 1000) AS BIGINT) END AS population,
               {case("c_custkey % 5", S.SECURITY)} AS security,
               {case("c_nationkey % 14", S.GOVERNMENT)} AS government, {case("c_nationkey % 8", S.ALLEGIANCE)} AS allegiance,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS primary_economy,
               CASE WHEN (c_custkey @div@ 5) % 2 = 0 THEN NULL ELSE {case("(c_custkey @div@ 5) % 5", _SEGMENTS)} END AS secondary_economy,
               {case("c_custkey % 9", ("G2V", "M5", "K1", "DA", "N", "TTS", "F8", "SupermassiveBlackHole", " o "))} AS primary_star_class,
               @minutes(c_custkey)@ AS updated_at
        FROM customer""",
    "factions": "SELECT CAST(s_suppkey AS INT) AS id, s_name AS name FROM supplier",
    "system_factions": f"""
        SELECT system_address, CAST(faction_id AS INT) AS faction_id, influence, updated_at,
               {case("(system_address + faction_id) % 27", S.STATE)} AS state, {case("(system_address + faction_id) % 5", S.HAPPINESS)} AS happiness,
               {case("faction_id % 14", S.GOVERNMENT)} AS government, {case("faction_id % 8", S.ALLEGIANCE)} AS allegiance
        FROM (SELECT o_custkey AS system_address, l_suppkey AS faction_id, round(sum(l_quantity) / 100, 4) AS influence, max(l_shipdate) AS updated_at
              FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1 GROUP BY o_custkey, l_suppkey) AS held""",
    "conflicts": f"""
        SELECT a.system_address, {case("(a.system_address + a.faction_id + b.faction_id) % 3", _KINDS)} AS type,
               {case("(a.system_address + b.faction_id) % 3", S.STATUS)} AS status, a.faction_id AS faction_1_id, b.faction_id AS faction_2_id,
               CASE WHEN a.faction_id % 4 = 0 THEN NULL ELSE concat('stake ', CAST(a.faction_id AS @text@)) END AS faction_1_stake,
               CASE WHEN b.faction_id % 5 = 0 THEN NULL ELSE concat('stake ', CAST(b.faction_id AS @text@)) END AS faction_2_stake,
               CAST(a.faction_id % 4 AS INT) AS faction_1_won_days, CAST(b.faction_id % 4 AS INT) AS faction_2_won_days
        FROM system_factions a JOIN system_factions b ON a.system_address = b.system_address AND a.faction_id < b.faction_id
        WHERE (a.system_address + a.faction_id + b.faction_id) % 17 = 0""",
    "stations": f"""
        SELECT s_suppkey AS system_address, s_name AS name, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE {case("s_suppkey % 9", S.STATION_TYPE)} END AS ty,
               s_suppkey AS market_id, CAST(s_suppkey % 9 AS INT) AS large, CAST(s_suppkey % 5 AS INT) AS medium, CAST(s_suppkey % 3 AS INT) AS small,
               @array({case("s_suppkey % 37", S.SERVICE)}, {case("(s_suppkey + 5) % 37", S.SERVICE)})@ AS services
        FROM supplier""",
    "markets": """
        SELECT CAST(s_suppkey AS BIGINT) AS id, name AS system_name, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_suppkey END AS system_address, s_name AS station_name
        FROM supplier JOIN systems ON address = s_suppkey""",
    "commodities": """
        SELECT l_suppkey AS market_id, lower(p_name) AS name, CAST(round(avg(p_retailprice)) AS INT) AS mean_price, CAST(sum(l_quantity) AS INT) AS stock, max(l_shipdate) AS listed_at
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, lower(p_name)""",
    "bodies": """
        SELECT p_partkey @div@ 10 AS system_address, CAST(p_partkey % 10 AS INT) AS id, p_name AS name,
               CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST((p_partkey % 10) @div@ 3 AS INT) END AS parent_id, p_type AS class,
               p_size * 1e10 AS semi_major_axis, (p_partkey % 90) / 100 AS eccentricity, CAST((p_partkey * 7) % 180 AS DOUBLE) AS inclination,
               CAST((p_partkey * 11) % 360 AS DOUBLE) AS periapsis, CAST((p_partkey * 13) % 360 AS DOUBLE) AS ascending_node,
               CAST((p_partkey * 17) % 360 AS DOUBLE) AS mean_anomaly, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_size * 1e6 END AS orbital_period,
               CAST(p_retailprice * 1000 AS DOUBLE) AS radius, CAST(p_partkey % 10 * 5 AS DOUBLE) AS arrival,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'thin' END AS atmosphere, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice END AS pressure,
               CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(0.2 AS DOUBLE) END AS ice, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(0.3 AS DOUBLE) END AS rock, CASE WHEN p_partkey % 15 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS metal
        FROM part""",
    "stars": f"""
        SELECT p_partkey @div@ 10 AS system_address, CAST(0 AS INT) AS id, p_name AS name, {case("p_partkey % 7", tuple("OBAFGKM"))} AS star_class, CAST((p_partkey @div@ 10) % 10 AS INT) AS subclass,
               CAST(p_size AS DOUBLE) / 16 AS stellar_mass, p_size * 2.5e7 AS radius, CAST(p_size * 211 AS DOUBLE) AS temperature, CAST(p_partkey % 13000 AS INT) AS age_my, CAST(p_partkey % 30 AS DOUBLE) - 10 AS absolute_magnitude,
               CASE WHEN p_partkey % 3 = 0 THEN 'V' ELSE 'III' END AS luminosity, 0.0e0 AS arrival, CAST(1 AS INT) AS parent_id,
               CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_size * 1e10 END AS semi_major_axis, (p_partkey % 90) / 100 AS eccentricity, CAST((p_partkey * 7) % 180 AS DOUBLE) AS inclination, CAST((p_partkey * 11) % 360 AS DOUBLE) AS periapsis,
               CAST((p_partkey * 13) % 360 AS DOUBLE) AS ascending_node, CAST((p_partkey * 17) % 360 AS DOUBLE) AS mean_anomaly, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_size * 1e6 END AS orbital_period
        FROM part WHERE p_partkey % 10 = 0""",
    "barycenters": """
        SELECT p_partkey @div@ 10 AS system_address, CAST(p_partkey % 10 AS INT) AS id, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_size * 1e9 END AS semi_major_axis, (p_partkey % 80) / 100 AS eccentricity,
               CAST((p_partkey * 7) % 180 AS DOUBLE) AS inclination, CAST((p_partkey * 11) % 360 AS DOUBLE) AS periapsis, CAST((p_partkey * 13) % 360 AS DOUBLE) AS ascending_node, CAST((p_partkey * 17) % 360 AS DOUBLE) AS mean_anomaly, p_size * 1e5 AS orbital_period
        FROM part WHERE p_partkey % 10 IN (1, 2)""",
    "body_materials": """
        SELECT p_partkey @div@ 10 AS system_address, CAST(p_partkey % 10 AS INT) AS body_id, name, CAST((p_partkey + nth * 7) % 100 AS DOUBLE) AS percent
        FROM (SELECT p_partkey, @words(p_name)@ FROM part WHERE p_partkey % 3 > 0) AS words WHERE name <> ''""",
    "articles": """
        SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('Article ', CAST(doc_id AS @text@)) END AS title,
               @days(doc_id % 730)@ AS date, text AS body
        FROM documents""",
    "membership_events": f"""
        SELECT user_id AS system_address, CAST(kind AS INT) AS faction_id, value AS influence, ts AS updated_at, event_id + (event_id * 7919 % 2000) AS arrival, event_id,
               {case("event_id % 3", ("Boom", "War", "Election"))} AS pending, {case("event_id % 4", ("Bust", "Famine", "Blight", "Drought"))} AS active, {case("event_id % 5", S.STATE[:5])} AS recovering
        FROM events JOIN (SELECT event_type AS known, row_number() OVER (ORDER BY event_type) - 1 AS kind FROM (SELECT DISTINCT event_type FROM events) AS t) AS kinds ON event_type = known""",
    "influences": """
        SELECT system_address, faction_id, new_influence, old_influence, new_timestamp, old_timestamp
        FROM (SELECT system_address, faction_id, influence AS new_influence, lag(influence) OVER (PARTITION BY system_address, faction_id ORDER BY arrival, event_id) AS old_influence,
                     updated_at AS new_timestamp, lag(updated_at) OVER (PARTITION BY system_address, faction_id ORDER BY arrival, event_id) AS old_timestamp
              FROM (SELECT *, max(updated_at) OVER (PARTITION BY system_address, faction_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM membership_events) AS seen
              WHERE before IS NULL OR updated_at > before) AS accepted
        WHERE new_influence <> old_influence""",
}

_SPARK = {
    r"@div@": "div", r"@text@": "STRING", r"@minutes\((.*?)\)@": r"timestampadd(MINUTE, \1, TIMESTAMP_NTZ '2024-01-01 00:00:00')", r"@days\((.*?)\)@": r"date_add(DATE '3301-01-01', CAST(\1 AS INT))",
    r"@array\((.*)\)@": r"array(\1)", r"@words\((.*?)\)@": r"posexplode(split(\1, ' ')) AS (nth, name)",
}
_DUCK = {
    r"@div@": "//", r"@text@": "VARCHAR", r"@minutes\((.*?)\)@": r"TIMESTAMP '2024-01-01 00:00:00' + to_minutes(\1)", r"@days\((.*?)\)@": r"CAST(DATE '3301-01-01' + CAST(\1 AS INT) AS DATE)",
    r"@array\((.*)\)@": r"[\1]", r"@words\((.*?)\)@": r"unnest(string_split(\1, ' ')) AS name, generate_subscripts(string_split(\1, ' '), 1) - 1 AS nth",
}


def _filled(text: str, dialect: dict[str, str]) -> str:
    for pattern, by in dialect.items():
        text = re.sub(pattern, by, text, flags=re.S)
    return text


class Catalogue:
    """The derived tables of one folder as DataFrames; made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in TEMPLATES:
            raise AttributeError(name)
        if name not in self._made:
            text = _filled(TEMPLATES[name], _SPARK)
            used = [t for t in (*BASE, *TEMPLATES) if t != name and re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
            for t in used:
                text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
            self._made[name] = self.spark.sql(text, **{t: getattr(self, t) for t in used})
        return self._made[name]

    @cached_property
    def positioned(self) -> DataFrame:
        return self.systems.filter("x IS NOT NULL")


def oracle(sql: str) -> str:
    """``sql`` with the definitions of the derived tables that it names."""
    need: list[str] = []

    def add(text: str) -> None:
        for t in TEMPLATES:
            if t not in need and re.search(rf"\b(?:FROM|JOIN) {t}\b", text, re.I):
                add(_filled(TEMPLATES[t], _DUCK))
                need.append(t)

    add(sql)
    if not need:
        return sql
    ctes = ", ".join(f"{t} AS ({_filled(TEMPLATES[t], _DUCK)})" for t in need)
    body = sql.lstrip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    return f"WITH {ctes}, {body[4:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
