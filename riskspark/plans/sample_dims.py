"""Small dimensions for the demonstration queries, as tables and as SQL; a user brings their own (``sources.dims``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COUNTRIES = [
    ("Chile", ["Karcalsund", "Norkarstad", "Yaltorfield", "Ulmawick", "Lor", "Zelmouth"]), ("Japan", ["Port Kelkarmouth", "Lorsalton", "Raldaleno"]), ("Brazil", ["Korkorfield Bay", "Nalyalfield"]),
    ("India", ["Belveleno Bay"]), ("Germany", ["Karhelmouth", "Fenpelton"]),
]
MATERIALS = [
    ("iron ore", ["iron ore fines", "Fe"], ["Brazil", "India", "Peru", "Chile"]), ("copper", ["copper concentrate", "refined copper"], ["Chile", "Peru"]), ("tin", ["refined tin"], ["Japan", "Germany"]), ("nickel", [], ["india"]),
    ("zinc", ["zinc concentrate"], []), ("lithium", ["lithium hydroxide"], ["Chile"]),
]
PORTS = [("Port of Nornalwick", "Nornalwick", "Germany", ["Nornalwick"]), ("Port Dalvelwick", "Korkorfield", "Brazil", ["Dalvelwick"]), ("Port of Yallorhaven", "Yallorhaven", "Norway", ["yallorhaven", "Yallor"])]
ROUTES = [("Corulness", ["Corulness strait", "Corulness"]), ("mergarton bay", ["Mergarton Bay", "Mergarton passage"]), ("Talselsund Bay", [])]


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    make = lambda rows, schema: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pos int, {schema}")
    return {
        "countries": make(COUNTRIES, "country string, major_cities array<string>"), "materials": make(MATERIALS, "material string, synonyms array<string>, top_producers array<string>"),
        "ports": make(PORTS, "port string, city string, country string, aliases array<string>"), "routes": make(ROUTES, "route string, query_terms array<string>"),
    }


def _sql(x: object) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(_sql, x)) + "]::varchar[]"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def ctes() -> str:
    """The same tables as common table expressions d_countries, d_materials, d_ports, d_routes."""
    make = lambda name, rows, columns: f"{name}(pos, {columns}) as (values {', '.join('(' + ', '.join(map(_sql, (i, *r))) + ')' for i, r in enumerate(rows))})"
    return ", ".join([make("d_countries", COUNTRIES, "country, major_cities"), make("d_materials", MATERIALS, "material, synonyms, top_producers"), make("d_ports", PORTS, "port, city, country, aliases"), make("d_routes", ROUTES, "route, query_terms")])
