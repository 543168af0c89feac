"""Exposure over dimensions, query prongs and relevance, for all clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as X
from ..operators import relevance as R
from ..operators import resolve as V
from ..operators.exposure import quoted
from ..session import table
from . import sample_dims as D
from .base import query
from .q_relevance import BASE, DENSITY, KEYS, PENALTY, TEXT, TRUST, _domains_sql, _points_sql, lit, padded_sql


def _each(column: str) -> str:
    return f"(select client_id, unnest({column}) as x, generate_subscripts({column}, 1) - 1 as i from client_profiles)"


def _named(x: str) -> str:
    return f"trim(coalesce({x}, ''))"


BOUND = f"""{D.ctes()},
    sup as (select client_id, i, {_named('x.name')} as name, case when {_named('x.country')} <> '' then x.country when {_named('x.location')} <> '' then x.location else '' end as country, {_named('x.city')} as city from {_each('tier1_suppliers')}),
    mat as (select * from (select client_id, i, lower({_named('x.commodity')}) as commodity from {_each('raw_materials')}) where commodity <> ''),
    nod as (select * from (select client_id, i, {_named('x.name')} as name from {_each('logistics_nodes')}) where name <> ''),
    mal as (select lower(trim(a)) as alias, arg_min(material, pos) as material from (select material, pos, unnest(list_concat([material], synonyms)) as a from d_materials) group by 1),
    pal as (select lower(trim(a)) as alias, arg_min(port, pos) as port from (select port, pos, unnest(list_concat([port], aliases)) as a from d_ports) group by 1),
    ral as (select lower(trim(route)) as alias, arg_min(route, pos) as route from d_routes group by 1),
    cal as (select lower(trim(country)) as alias, arg_min(country, pos) as country from d_countries group by 1),
    goods as (select client_id, i, commodity, mal.material, m.synonyms, m.top_producers from mat left join mal on commodity = alias left join d_materials m on m.material = mal.material),
    bound as (select client_id, i, name, pal.port, case when pal.port is null then ral.route end as route from nod left join pal on lower(name) = pal.alias left join ral on lower(name) = ral.alias),
    cn as (select client_id, 0 as k, i, 0 as j, country as name from sup union all select client_id, 1, i, generate_subscripts(top_producers[1:3], 1) - 1, unnest(top_producers[1:3]) from goods
           union all select client_id, 2, i, 0, p.country from bound join d_ports p using (port)),
    cf as (select client_id, cal.country, min((k, i, j)) as o from cn join cal on lower(trim(cn.name)) = alias group by 1, 2),
    countries as (select client_id, cast(row_number() over (partition by client_id order by o, country) - 1 as integer) as pos, country from cf),
    own as (select client_id, cal.country, city, min(i) as p from sup join cal on lower(trim(sup.country)) = alias where city <> '' group by 1, 2, 3),
    major as (select client_id, country, generate_subscripts(major_cities, 1) - 1 as p, unnest(major_cities) as city from countries join d_countries using (country)),
    ct as (select client_id, country, city, 0 as k, -p as p from own anti join major using (client_id, country, city) union all select client_id, country, city, 1, p from major),
    towns as (select ct.client_id, c.pos as country_pos, ct.country, cast(row_number() over (partition by ct.client_id, ct.country order by k, p) - 1 as integer) as pos, city from ct join countries c on c.client_id = ct.client_id and c.country = ct.country),
    ex as (select client_id, 'supplier' as node_type, name as node, [name] as names, 0 as k, i from sup where name <> ''
           union all select client_id, 'material', coalesce(material, commodity), list_concat([coalesce(material, commodity)], coalesce(synonyms, [])), 1, i from goods
           union all select client_id, 'port', port, list_concat([port], aliases), 2, i from bound join d_ports using (port)
           union all select client_id, 'route', route, case when len(query_terms) > 0 then query_terms else [route] end, 3, i from bound join d_routes using (route)
           union all select client_id, 'node', name, [name], 4, i from bound),
    exposure as (select client_id, node_type, node, cast(row_number() over (partition by client_id order by min((k, i)), node) - 1 as integer) as pos, arg_min(names, (k, i)) as names from ex group by client_id, node_type, node),
    places as (select distinct client_id, 'country' as kind, country as name from countries union select distinct client_id, 'city', city from towns where pos < 5 and length(city) >= 4)"""


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, V.Dims]:
    return table(spark, d, "client_profiles"), D.tables(spark)


@query(f"with {BOUND} select client_id, cast(i as integer) as pos, commodity, material from goods")
def exposure_materials(spark: SparkSession, d: str) -> DataFrame:
    """Commodities bound to materials by key or synonym; unknown ones stay."""
    return V.bind_materials(*_profiles(spark, d)).select("client_id", "pos", "commodity", "material")


@query(f"with {BOUND} select client_id, cast(i as integer) as pos, name, port, route from bound")
def exposure_logistics(spark: SparkSession, d: str) -> DataFrame:
    """Nodes bound to a port by key or alias, else to a route by key."""
    return V.bind_nodes(*_profiles(spark, d)).select("client_id", "pos", "name", "port", "route")


@query(f"with {BOUND} select client_id, pos, country from countries")
def exposure_countries(spark: SparkSession, d: str) -> DataFrame:
    return V.exposure_countries(*_profiles(spark, d))


@query(f"with {BOUND} select client_id, country_pos, country, pos, city from towns")
def exposure_cities(spark: SparkSession, d: str) -> DataFrame:
    return V.exposure_cities(*_profiles(spark, d))


@query(f"with {BOUND} select client_id, node_type, node, pos, array_to_string(names, '|') as names from exposure")
def exposure_union(spark: SparkSession, d: str) -> DataFrame:
    return V.exposure(*_profiles(spark, d)).select("client_id", "node_type", "node", "pos", F.array_join("names", "|").alias("names"))


def _prongs_sql() -> str:
    every = quoted([t for ts in X.SAMPLE_LEXICON.values() for t in ts])
    split = " union all ".join(f"select client_id, prong, '\"' || city || '\" AND (' || {lit(quoted(ts))} || ')' as query, (a, p, i, {n}) as o from geo where length(city) + {len(every) + 9} > 400" for n, ts in enumerate(X.SAMPLE_LEXICON.values()))
    return f"""with {BOUND},
      known as (select client_id, country, string_agg(city, chr(10)) as known from towns group by 1, 2),
      first as (select client_id, port, min(i) as i from bound where port is not null group by 1, 2),
      geo as (select client_id, city, 'city' as prong, 2 as a, country_pos as p, pos as i from towns where pos < 3
              union all select f.client_id, p.city, 'port city', 3, f.i, 0 from first f join d_ports p using (port) left join known k on k.client_id = f.client_id and k.country = p.country where trim(p.city) <> '' and not coalesce(contains(known, p.city), false)),
      q as (select client_id, 'entity' as prong, name as query, (0, i, 0, 0) as o from sup
        union all select client_id, 'entity', name, (1, i, 0, 0) from nod
        union all select client_id, prong, '"' || city || '" AND (' || {lit(every)} || ')', (a, p, i, 0) from geo where length(city) + {len(every) + 9} <= 400
        union all {split}
        union all select client_id, 'commodity', '"' || case when len(synonyms) > 0 then synonyms[1] else material end || '" AND (' || {lit(quoted(X.COMMODITY_TERMS))} || ')', (4, i, 0, 0) from goods where material is not null
        union all select client_id, 'unknown material', '"' || commodity || '" AND (shortage OR "supply disruption" OR "price surge")', (4, i, 0, 0) from goods where material is null
        union all select client_id, 'origin', '"' || r || '" AND "' || m || '" AND (' || {lit(quoted(X.ORIGIN_TERMS))} || ')', (4, i, 1, j) from (select client_id, i, case when len(synonyms) > 0 then synonyms[1] else material end as m, unnest(top_producers[1:3]) as r, generate_subscripts(top_producers[1:3], 1) - 1 as j from goods where material is not null)
        union all select client_id, 'route', t, (5, i, j, 0) from (select client_id, i, unnest(query_terms) as t, generate_subscripts(query_terms, 1) - 1 as j from bound join d_routes using (route))),
      f as (select client_id, trim(query) as query, min(o) as o, arg_min(prong, o) as prong from q where trim(coalesce(query, '')) <> '' group by 1, 2)
      select client_id, cast(row_number() over (partition by client_id order by o, query) - 1 as integer) as pos, prong, query from f"""


@query(_prongs_sql())
def client_queries(spark: SparkSession, d: str) -> DataFrame:
    """All prongs over the dimensions: entity, city, port city, commodity, unknown material, origin, route."""
    return V.generate_queries(*_profiles(spark, d))


def _bare(x: str) -> str:
    for phrase in X.GEO_NOISE:
        x = f"replace({x}, {lit(phrase)}, '')"
    return x


HITS = f"""{BOUND},
    nm as (select client_id, node_type, node, pos, {padded_sql('name')} as name from (select client_id, node_type, node, pos, unnest(names) as name from exposure) where length(trim(name)) >= 3
           union all select client_id, kind, name, -1, {padded_sql('name')} from places),
    ar as (select article_id, run_id, {padded_sql(TEXT)} as t, {padded_sql(_bare(TEXT))} as g from preprocessed_articles),
    hits as (select distinct article_id, run_id, client_id, node_type, node, nm.pos from ar join nm on trim(name) <> '' and contains(case when node_type in ('country', 'city') then g else t end, name)),
    sure as (select * from hits where node_type not in ('country', 'city', 'node')),
    loose as (select * from hits h where node_type = 'node' and not exists (select 1 from sure s where s.article_id = h.article_id and s.run_id = h.run_id and s.client_id = h.client_id and s.node = h.node)),
    ent as (select article_id, run_id, client_id, least(sum(case node_type when 'supplier' then 8 when 'material' then 6 when 'node' then 3 else 5 end), 20) as entity, count(distinct node) as matched from (select * from sure union all select * from loose) group by 1, 2, 3),
    geo as (select article_id, run_id, client_id, least(sum(case node_type when 'country' then 5 else 3 end), 15) as geo from hits where node_type in ('country', 'city') group by 1, 2, 3),
    lin as (select article_id, run_id, client_id, string_agg(node_type || ':' || node, '|' order by pos, node_type, node) as linked from sure group by 1, 2, 3)"""
SCORED = f"""with {BASE}, d as (select *, {_domains_sql()} as ds from t), s as (select article_id, run_id, {_points_sql()} as disruption, {DENSITY} as supply_chain, {TRUST} as trust, {PENALTY} as penalty from d), {HITS},
    f as (select s.article_id, s.run_id, c.client_id, disruption, supply_chain, cast(coalesce(entity, 0) as integer) as entity, cast(coalesce(geo, 0) as integer) as geo, trust, penalty, coalesce(matched, 0) as matched, coalesce(linked, '') as linked
          from s cross join (select distinct client_id from client_profiles) c left join ent e on e.article_id = s.article_id and e.run_id = s.run_id and e.client_id = c.client_id left join geo g on g.article_id = s.article_id and g.run_id = s.run_id and g.client_id = c.client_id
          left join lin l on l.article_id = s.article_id and l.run_id = s.run_id and l.client_id = c.client_id),
    total as (select *, greatest(0, least(100, disruption + supply_chain + entity + geo + trust - penalty)) as total from f),
    scored as (select *, case when disruption = 0 or supply_chain = 0 then 'LOW' when total >= 55 then 'HIGH' when total >= 30 then 'MEDIUM' else 'LOW' end as impact from total)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return V.score_for_clients(table(spark, d, "preprocessed_articles"), *_profiles(spark, d), keys=KEYS)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    profiles, dims = _profiles(spark, d)
    hits = V.name_hits(table(spark, d, "preprocessed_articles"), V.exposure(profiles, dims), V.exposure_places(profiles, dims), keys=KEYS)
    return V.client_scores(hits, keys=KEYS)


@query(f"with {HITS} select article_id, run_id, client_id, cast(entity as integer) as entity, matched::integer as matched from ent")
def score_entity_match(spark: SparkSession, d: str) -> DataFrame:
    """Entity points of every article and client with any, by names, synonyms, aliases and query terms."""
    return _hits(spark, d).where("entity > 0").select(*KEYS, "client_id", "entity", F.size("matched").alias("matched"))


@query(f"with {HITS} select article_id, run_id, client_id, cast(geo as integer) as geo from geo")
def score_geo(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).where("geo > 0").select(*KEYS, "client_id", "geo")


@query(f"with {HITS} select article_id, run_id, client_id, linked from lin")
def linked_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).where(F.size("linked_nodes") > 0).select(*KEYS, "client_id", F.array_join("linked_nodes", "|").alias("linked"))


@query(f"{SCORED} select article_id, run_id, client_id, disruption, supply_chain, entity, geo, trust, penalty, total, impact from scored")
def score_total_impact(spark: SparkSession, d: str) -> DataFrame:
    """Every article for every client."""
    return scored(spark, d).select(*KEYS, "client_id", "disruption", "supply_chain", "entity", "geo", "trust", "penalty", "total", "impact")


@query(f"{SCORED} select client_id, article_id, run_id, total, impact from scored qualify row_number() over (partition by client_id order by case impact when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end desc, total desc, article_id, run_id) <= 30")
def ranked_articles_top30(spark: SparkSession, d: str) -> DataFrame:
    """The thirty articles that each client sees first."""
    from ..operators.vectors import rank_rows

    order = [R.level_rank(F.col("impact")).desc(), F.col("total").desc(), *map(F.col, KEYS)]
    return rank_rows(scored(spark, d), ["client_id"], order, 30).select("client_id", *KEYS, "total", "impact")


@query(f"{SCORED} select client_id, impact, count(*) as n, max(total) as best from scored group by 1, 2")
def impact_histogram(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("client_id", "impact").agg(F.count("*").alias("n"), F.max("total").alias("best"))


@query(f"""{SCORED} select client_id, count(*) as scored, count(*) filter (disruption > 0) as disrupted, count(*) filter (matched > 0) as matched, count(*) filter (linked <> '') as linked,
    count(*) filter (impact = 'HIGH') as high, count(*) filter (impact = 'MEDIUM') as medium, count(*) filter (impact = 'LOW') as low from scored group by 1""")
def funnel_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many articles each stage leaves, for each client, in one pass."""
    level = lambda v: F.count_if(F.col("impact") == v).alias(v.lower())
    return scored(spark, d).groupBy("client_id").agg(
        F.count("*").alias("scored"), F.count_if(F.col("disruption") > 0).alias("disrupted"), F.count_if(F.size("matched") > 0).alias("matched"), F.count_if(F.size("linked_nodes") > 0).alias("linked"), level("HIGH"), level("MEDIUM"), level("LOW")
    )


@query(f"""{BASE.replace('t as', 'with t as', 1)}, d as (select *, {_domains_sql()} as ds from t), e as (select unnest(ds) as domain from d)
    select domain, count(*) as n from e group by 1 order by n desc, domain limit 8""")
def top_domains(spark: SparkSession, d: str) -> DataFrame:
    """The eight most frequent disruption domains: a chart's top-k."""
    own = table(spark, d, "preprocessed_articles").select(R.article_text().alias("_text")).select(F.explode(R.disruption_domains("_text")).alias("domain"))
    return own.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "domain").limit(8)
