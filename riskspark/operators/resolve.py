"""Client profiles bound to dimension tables, the queries made from that, and relevance for every client at once.

Dimensions (small, given by the user): countries (country, pos, major_cities), materials (material, pos, synonyms,
top_producers), ports (port, pos, city, country, aliases), routes (route, pos, query_terms). Order of first sight is
kept in two columns: the part of the profile a thing comes from, and its place there.

Defined results: names are matched without regard to case and outer blanks; a name that several entries have goes to
the first in file order; an unknown material stays under its own name, an unknown node stays a plain node, a country
that the dimension does not have is left out; null profiles, lists and names bring nothing; repeated names count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as X
from ..session import materialize
from .exposure import explode_profile, first_seen, quoted, resolve_names
from .relevance import any_phrase, article_text, disruption_domains, disruption_score, impact_level, keyword_density, padded, press_penalty, trust_points

Dims = dict[str, DataFrame]
POINTS = {"supplier": 8, "material": 6, "port": 5, "route": 5, "node": 3}  # fixed values: points of a matched name
MOST_NAMES, MOST_LITERALS = 100_000, 2_000
SCORES = ["client_id", "disruption_domains", "disruption", "supply_chain", "trust", "penalty", "entity", "geo", "matched", "linked_nodes", "total", "impact"]


def _none() -> Column:
    return F.array().cast("array<string>")


def _named(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def suppliers(profiles: DataFrame) -> DataFrame:
    return explode_profile(profiles)["suppliers"].withColumn("name", _named("name"))


def bind_materials(profiles: DataFrame, dims: Dims) -> DataFrame:
    """(client_id, pos, commodity, material, synonyms, top_producers): material is null where none matches."""
    goods = explode_profile(profiles)["materials"].select("client_id", "pos", F.lower(_named("commodity")).alias("commodity")).where("commodity <> ''")
    got = resolve_names(goods, dims["materials"], name="commodity", key="material", aliases="synonyms").withColumnRenamed("resolved", "material")
    return got.join(F.broadcast(dims["materials"].select("material", "synonyms", "top_producers")), "material", "left")


def bind_nodes(profiles: DataFrame, dims: Dims) -> DataFrame:
    """(client_id, pos, name, port, route): the port a node is, or else the route; both null if it is neither."""
    nodes = explode_profile(profiles)["nodes"].select("client_id", "pos", _named("name").alias("name")).where("name <> ''")
    got = resolve_names(nodes, dims["ports"], name="name", key="port", aliases="aliases").withColumnRenamed("resolved", "port")
    got = resolve_names(got, dims["routes"], name="name", key="route").withColumnRenamed("resolved", "route")
    return got.withColumn("route", F.when(F.col("port").isNull(), F.col("route")))


def exposure_countries(profiles: DataFrame, dims: Dims) -> DataFrame:
    """(client_id, pos, country): countries of suppliers, of the three first producers of materials, of ports, as first seen."""
    s = suppliers(profiles).select("client_id", F.lit(0).alias("k"), "pos", F.lit(0).alias("i"), F.col("country").alias("name"))
    m = bind_materials(profiles, dims).select("client_id", F.lit(1).alias("k"), "pos", F.posexplode(F.slice("top_producers", 1, 3)).alias("i", "name")).select("client_id", "k", "pos", "i", "name")
    p = bind_nodes(profiles, dims).join(F.broadcast(dims["ports"].select("port", "country")), "port").select("client_id", F.lit(2).alias("k"), "pos", F.lit(0).alias("i"), F.col("country").alias("name"))
    got = resolve_names(s.unionByName(m).unionByName(p), dims["countries"], name="name", key="country")
    return first_seen(got, ["client_id"], "resolved", F.struct("k", "pos", "i")).select("client_id", "pos", F.col("resolved").alias("country"))


def exposure_cities(profiles: DataFrame, dims: Dims) -> DataFrame:
    """(client_id, country_pos, country, pos, city): cities that suppliers name, the last named first, then the country's own."""
    countries = exposure_countries(profiles, dims).withColumnRenamed("pos", "country_pos")
    own = resolve_names(suppliers(profiles).select("client_id", "pos", "country", _named("city").alias("city")).where("city <> ''"), dims["countries"], name="country", key="country")
    own = own.where(F.col("resolved").isNotNull()).groupBy("client_id", F.col("resolved").alias("country"), "city").agg(F.min("pos").alias("p"))
    major = countries.join(F.broadcast(dims["countries"].select("country", "major_cities")), "country").select("client_id", "country", F.posexplode("major_cities").alias("p", "city"))
    every = own.join(major.select("client_id", "country", "city"), ["client_id", "country", "city"], "left_anti").select("client_id", "country", "city", F.lit(0).alias("k"), (-F.col("p")).alias("p"))
    every = every.unionByName(major.select("client_id", "country", "city", F.lit(1).alias("k"), "p"))
    place = F.row_number().over(Window.partitionBy("client_id", "country").orderBy("k", "p")) - 1
    return countries.join(every, ["client_id", "country"]).select("client_id", "country_pos", "country", place.cast("int").alias("pos"), "city")


def exposure(profiles: DataFrame, dims: Dims) -> DataFrame:
    """(client_id, node_type, node, pos, names): what a client depends on, and the names by which texts may call it."""
    own = suppliers(profiles).where("name <> ''").select("client_id", F.lit("supplier").alias("node_type"), F.col("name").alias("node"), F.array("name").alias("names"), F.lit(0).alias("k"), "pos")
    goods = bind_materials(profiles, dims)
    two = goods.select("client_id", F.lit("material").alias("node_type"), F.coalesce("material", "commodity").alias("node"), F.concat(F.array(F.coalesce("material", "commodity")), F.coalesce("synonyms", _none())).alias("names"), F.lit(1).alias("k"), "pos")
    bound = bind_nodes(profiles, dims)
    ports = bound.join(F.broadcast(dims["ports"].select("port", "aliases")), "port").select("client_id", F.lit("port").alias("node_type"), F.col("port").alias("node"), F.concat(F.array("port"), F.coalesce("aliases", _none())).alias("names"), F.lit(2).alias("k"), "pos")
    terms = F.when(F.size(F.coalesce("query_terms", _none())) > 0, F.col("query_terms")).otherwise(F.array("route"))
    routes = bound.join(F.broadcast(dims["routes"].select("route", "query_terms")), "route").select("client_id", F.lit("route").alias("node_type"), F.col("route").alias("node"), terms.alias("names"), F.lit(3).alias("k"), "pos")
    plain = bound.select("client_id", F.lit("node").alias("node_type"), F.col("name").alias("node"), F.array("name").alias("names"), F.lit(4).alias("k"), "pos")
    every = reduce(DataFrame.unionByName, [own, two, ports, routes, plain])
    firsts = every.groupBy("client_id", "node_type", "node").agg(F.min(F.struct("k", "pos")).alias("o"), F.min_by("names", F.struct("k", "pos")).alias("names"))
    place = F.row_number().over(Window.partitionBy("client_id").orderBy("o", "node")) - 1
    return firsts.select("client_id", "node_type", "node", place.cast("int").alias("pos"), "names")


def exposure_places(profiles: DataFrame, dims: Dims, *, cities: int = 5) -> DataFrame:
    """(client_id, kind, name): countries, and the first cities of each that have four letters or more."""
    countries = exposure_countries(profiles, dims).select("client_id", F.lit("country").alias("kind"), F.col("country").alias("name"))
    towns = exposure_cities(profiles, dims).where((F.col("pos") < cities) & (F.length("city") >= 4)).select("client_id", F.lit("city").alias("kind"), F.col("city").alias("name"))
    return countries.unionByName(towns).distinct()


def generate_queries(profiles: DataFrame, dims: Dims, *, lexicon: dict[str, list[str]] | None = None, limit: int = 400, cities: int = 3) -> DataFrame:
    """(client_id, pos, prong, query): entity, city, port city, commodity, origin and route queries, each text once, in that order.

    A city query longer than ``limit`` with all terms is split into one for each domain.
    """
    lexicon = lexicon or X.SAMPLE_LEXICON
    order = lambda *xs: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("int").alias(f"o{i}") for i, x in enumerate(xs)]).alias("o")
    made: list[DataFrame] = [
        suppliers(profiles).select("client_id", F.lit("entity").alias("prong"), F.col("name").alias("query"), order(0, F.col("pos"), 0, 0)),
        bind_nodes(profiles, dims).select("client_id", F.lit("entity").alias("prong"), F.col("name").alias("query"), order(1, F.col("pos"), 0, 0)),
    ]
    towns = exposure_cities(profiles, dims)
    bound = bind_nodes(profiles, dims)
    first = bound.where(F.col("port").isNotNull()).groupBy("client_id", "port").agg(F.min("pos").alias("pos"))
    known = towns.groupBy("client_id", "country").agg(F.array_join(F.array_sort(F.collect_set("city")), "\n").alias("known"))
    harbour = first.join(F.broadcast(dims["ports"].select("port", "city", "country")), "port").join(known, ["client_id", "country"], "left")
    harbour = harbour.where((_named("city") != "") & ~F.coalesce(F.contains("known", "city"), F.lit(False))).select("client_id", "city", F.lit("port city").alias("prong"), F.lit(3).alias("a"), "pos", F.lit(0).alias("i"))
    towns = towns.where(F.col("pos") < cities).select("client_id", "city", F.lit("city").alias("prong"), F.lit(2).alias("a"), F.col("country_pos").alias("pos"), F.col("pos").alias("i"))
    head = F.concat(F.lit('"'), F.col("city"), F.lit('" AND ('))
    full = F.concat(head, F.lit(quoted([t for terms in lexicon.values() for t in terms])), F.lit(")"))
    split = F.array(*[F.concat(head, F.lit(quoted(terms)), F.lit(")")) for terms in lexicon.values()])
    geo = towns.unionByName(harbour).select("client_id", "prong", "a", "pos", "i", F.posexplode(F.when(F.length(full) <= limit, F.array(full)).otherwise(split)).alias("d", "query"))
    made.append(geo.select("client_id", "prong", "query", order(F.col("a"), F.col("pos"), F.col("i"), F.col("d"))))
    goods = bind_materials(profiles, dims)
    main = F.when(F.size(F.coalesce("synonyms", _none())) > 0, F.col("synonyms")[0]).otherwise(F.col("material"))
    goods = goods.withColumn("main", main)
    about = F.concat(F.lit('"'), F.col("main"), F.lit(f'" AND ({quoted(X.COMMODITY_TERMS)})'))
    fallback = F.concat(F.lit('"'), F.col("commodity"), F.lit('" AND (shortage OR "supply disruption" OR "price surge")'))
    made.append(goods.select("client_id", F.when(F.col("material").isNull(), "unknown material").otherwise("commodity").alias("prong"), F.coalesce(about, fallback).alias("query"), order(4, F.col("pos"), 0, 0)))
    origin = goods.where(F.col("material").isNotNull()).select("client_id", "pos", "main", F.posexplode(F.slice("top_producers", 1, 3)).alias("i", "region"))
    made.append(origin.select("client_id", F.lit("origin").alias("prong"), F.concat(F.lit('"'), F.col("region"), F.lit('" AND "'), F.col("main"), F.lit(f'" AND ({quoted(X.ORIGIN_TERMS)})')).alias("query"), order(4, F.col("pos"), 1, F.col("i"))))
    ways = bound.join(F.broadcast(dims["routes"].select("route", "query_terms")), "route").select("client_id", F.lit("route").alias("prong"), "pos", F.posexplode("query_terms").alias("i", "query"))
    made.append(ways.select("client_id", "prong", "query", order(5, F.col("pos"), F.col("i"), 0)))
    every = reduce(DataFrame.unionByName, made).withColumn("query", F.trim("query")).where(F.coalesce("query", F.lit("")) != "")
    firsts = every.groupBy("client_id", "query").agg(F.min("o").alias("o"), F.min_by("prong", "o").alias("prong"))
    place = F.row_number().over(Window.partitionBy("client_id").orderBy("o", "query")) - 1
    return firsts.select("client_id", place.cast("int").alias("pos"), "prong", "query")


def _geo_text(text: Column) -> Column:
    """The text without phrases that only sound like places."""
    bare = reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), X.GEO_NOISE, text)
    return F.when(any_phrase(text, X.GEO_NOISE), bare).otherwise(text)


def name_hits(articles: DataFrame, nodes: DataFrame, places: DataFrame, *, keys: list[str], text: Column | None = None) -> DataFrame:
    """(keys, client_id, node_type, node, pos): each node and place that an article names as a whole word, once.

    Names are few (checked: at most ``MOST_NAMES``) and are met by their first word, so that no article is compared with all
    of them; where first words are few as well, other words of a text are not even looked up.
    """
    one = nodes.select("client_id", "node_type", "node", "pos", F.explode("names").alias("name")).where(F.length(F.trim("name")) >= 3)
    two = places.select("client_id", F.col("kind").alias("node_type"), F.col("name").alias("node"), F.lit(-1).alias("pos"), "name")
    names = one.unionByName(two).select("client_id", "node_type", "node", "pos", padded(F.col("name")).alias("name")).where(F.trim("name") != "")
    names = names.withColumn("_w", F.split(F.trim("name"), " ")[0])
    first = [r["_w"] for r in names.select("_w").distinct().limit(MOST_NAMES + 1).collect()]
    if len(first) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} first words of names: score the clients in blocks")
    body = text if text is not None else article_text()
    own = articles.select(*keys, padded(body).alias("_t"), padded(_geo_text(body)).alias("_g"))
    words = F.array_distinct(F.split(F.trim("_t"), " "))
    if len(first) <= MOST_LITERALS:
        words = F.array_intersect(words, F.array(*map(F.lit, sorted(first))) if first else _none())
    met = own.withColumn("_w", F.explode(words)).join(F.broadcast(names), "_w")
    shown = F.when(F.col("node_type").isin("country", "city"), F.col("_g")).otherwise(F.col("_t"))
    return met.where(F.contains(shown, F.col("name"))).select(*keys, "client_id", "node_type", "node", "pos").distinct()


def client_scores(hits: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, client_id, entity, geo, matched, linked_nodes) of every article and client with a hit.

    A plain node counts only where no other match has its name; linked nodes are suppliers, materials, ports and routes.
    """
    g = hits.groupBy(*keys, "client_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_type", "node"))).alias("h"))
    place = lambda x: x["node_type"].isin("country", "city")
    sure = F.filter("h", lambda x: ~place(x) & (x["node_type"] != "node"))
    g = g.withColumn("_s", sure).withColumn("_m", F.transform("_s", lambda x: x["node"]))
    loose = F.filter("h", lambda x: (x["node_type"] == "node") & ~F.array_contains(F.col("_m"), x["node"]))
    g = g.withColumn("_l", loose)
    point = lambda x: reduce(lambda e, kv: F.when(x["node_type"] == kv[0], kv[1]).otherwise(e), POINTS.items(), F.lit(0))
    entity = F.aggregate(F.concat("_s", "_l"), F.lit(0), lambda s, x: s + point(x))
    geo = F.aggregate("h", F.lit(0), lambda s, x: s + F.when(x["node_type"] == "country", 5).when(x["node_type"] == "city", 3).otherwise(0))
    return g.select(
        *keys, "client_id", F.least(entity, F.lit(20)).cast("int").alias("entity"), F.least(geo, F.lit(15)).cast("int").alias("geo"), F.array_distinct(F.concat("_m", F.transform("_l", lambda x: x["node"]))).alias("matched"),
        F.transform("_s", lambda x: F.concat_ws(":", x["node_type"], x["node"])).alias("linked_nodes"),
    )


def score_for_clients(articles: DataFrame, profiles: DataFrame, dims: Dims, *, keys: list[str], lexicon: dict[str, list[str]] | None = None, text: Column | None = None, trust: str = "trust_score", most_clients: int = 1_000) -> DataFrame:
    """All scores, the total, impact level, matched names and linked nodes of each article for each client.

    The parts that only the text decides are computed once an article; what a client's exposure adds comes by one join.
    Columns of ``articles`` that have the name of a score give way to it.
    """
    body = text if text is not None else article_text()
    clients = [r["client_id"] for r in profiles.select("client_id").distinct().orderBy("client_id").limit(most_clients + 1).collect()]
    if len(clients) > most_clients:
        raise ValueError(f"more than {most_clients} clients: score them in blocks")
    own = articles.withColumn("_text", body).drop(*SCORES)
    own = own.withColumns({"disruption_domains": disruption_domains("_text", lexicon), "supply_chain": keyword_density("_text"), "trust": trust_points(F.col(trust)), "penalty": press_penalty("_text")}).drop("_text")
    own = own.withColumn("disruption", disruption_score(F.col("disruption_domains")))
    own = own.withColumn("client_id", F.explode(F.array(*map(F.lit, clients)) if clients else _none()))
    # A few rows by many joins: written, so that the plan over the articles does not hold these.
    nodes, places = materialize(exposure(profiles, dims), "exposure"), materialize(exposure_places(profiles, dims), "places")
    hits = client_scores(name_hits(articles, nodes, places, keys=keys, text=text), keys=keys)
    own = own.join(hits, [*keys, "client_id"], "left")
    own = own.withColumns({"entity": F.coalesce("entity", F.lit(0)), "geo": F.coalesce("geo", F.lit(0)), "matched": F.coalesce("matched", _none()), "linked_nodes": F.coalesce("linked_nodes", _none())})
    total = F.col("disruption") + F.col("supply_chain") + F.col("entity") + F.col("geo") + F.col("trust") - F.col("penalty")
    own = own.withColumn("total", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"))
    return own.withColumn("impact", impact_level(F.col("total"), F.col("disruption"), F.col("supply_chain")))
