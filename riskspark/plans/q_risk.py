"""Cluster, node and portfolio risk over the corpus records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as X
from ..operators import legacy_risk as L
from ..operators import risk as K
from ..session import small_side, table
from .q_relevance import lit
from .base import query

AS_OF = "2025-06-01 00:00:00"
C = """c as (select r.record_id as pos, r.cluster_id, r.risk_score_norm * 100 as score, r.disruption_domain as domain, f.country, r.source, r.fetched_at as published, r.impact_level as level,
      list_transform(coalesce(r.ner_tags, []), lambda x: case x.label when 'ORG' then 'supplier' when 'GPE' then 'country' when 'RULE' then 'material' else 'other' end || ':' || x.text) as nodes
      from corpus_records r left join feed_sources f on r.source = f.source)"""
WEIGHT = "case split_part(x, ':', 1) when 'supplier' then 100 when 'material' then 80 when 'port' then 60 when 'route' then 40 when 'country' then 20 else 0 end"
KNOWN = "case when trim({0}) <> '' then lower(trim({0})) end"
DIMS = f"""g as (select cluster_id, count(*) as articles, max(score) as intensity, avg(score) as mean, avg(case when published >= timestamp '{AS_OF}' - interval '24 hours' then 1.0e0 else 0e0 end) as recent,
        max(coalesce(list_max(list_transform(nodes, lambda x: {WEIGHT})), 0)) as node_criticality,
        count(distinct case when {KNOWN.format('domain')} <> 'none' then {KNOWN.format('domain')} end) as dn, count(distinct {KNOWN.format('country')}) as cn, count(distinct {KNOWN.format('source')}) as sn
        from c where cluster_id >= 0 group by cluster_id),
    dims as (select cluster_id, articles, least(intensity, 100.0e0) as intensity, cast(least(dn * 20, 100) as double) as breadth, cast(node_criticality as double) as node_criticality, cast(least(cn * 20, 100) as double) as geo_spread,
        cast(case when sn <= 0 then 0 when sn = 1 then 10 when sn = 2 then 30 when sn = 3 then 50 when sn = 4 then 70 when sn = 5 then 90 else 100 end as double) as corroboration,
        round(recent * 100, 1) as velocity, round(least(100.0e0, log2(articles + 1) / log2(33) * 100), 4) as size, round(mean, 1) as confidence, sn as sources from g)"""
COMPOSITE = """comp as (select *, round(least(100.0e0, round(intensity * 0.25e0 + breadth * 0.15e0 + node_criticality * 0.2e0 + geo_spread * 0.1e0 + corroboration * 0.1e0 + velocity * 0.1e0 + size * 0.05e0 + confidence * 0.05e0, 6)), 1) as composite from dims),
    sev as (select *, case when composite >= 75 then 'CRITICAL' when composite >= 55 then 'HIGH' when composite >= 35 then 'MEDIUM' else 'LOW' end as severity from comp)"""


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Corpus records as the articles of clusters; outlets give the country, tags the nodes."""
    kind = lambda t: F.when(t["label"] == "ORG", "supplier").when(t["label"] == "GPE", "country").when(t["label"] == "RULE", "material").otherwise("other")
    none = F.array().cast("array<string>")
    rows = table(spark, d, "corpus_records").select(
        F.col("record_id").alias("pos"), "cluster_id", (F.col("risk_score_norm") * 100).alias("score"), F.col("disruption_domain").alias("domain"), "source", F.col("fetched_at").cast("timestamp").alias("published"), F.col("impact_level").alias("level"),
        F.coalesce(F.transform("ner_tags", lambda t: F.concat(kind(t), F.lit(":"), t["text"])), none).alias("nodes"),
    )
    return rows.join(small_side(table(spark, d, "feed_sources").select("source", "country")), "source", "left")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return K.composite(K.cluster_dimensions(articles(spark, d), AS_OF))


def _dimension(name: str, column: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return K.cluster_dimensions(articles(spark, d), AS_OF).select("cluster_id", column)

    run.__name__ = f"dim_{name}"
    query(f"with {C}, {DIMS} select cluster_id, {column} from dims")(run)


for _name, _column in (("intensity", "intensity"), ("breadth", "breadth"), ("node_criticality", "node_criticality"), ("geo_spread", "geo_spread"), ("corroboration", "corroboration"), ("velocity", "velocity"), ("size", "size"), ("sem_confidence", "confidence")):
    _dimension(_name, _column)


@query(f"with {C}, {DIMS}, {COMPOSITE} select cluster_id, articles, composite, severity from sev")
def composite_severity(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("cluster_id", "articles", "composite", "severity")


PRIMARY = f"""pd as (select cluster_id, min_by(domain, (-n, first)) as primary_domain from (select cluster_id, {KNOWN.format('domain')} as domain, count(*) as n, min(pos) as first from c where cluster_id >= 0 and coalesce({KNOWN.format('domain')}, 'none') <> 'none' group by 1, 2) group by cluster_id)"""


@query(f"with {C}, {PRIMARY} select * from pd")
def primary_domain_mode(spark: SparkSession, d: str) -> DataFrame:
    return K.primary_domain(articles(spark, d))


@query(f"""with {C}, {DIMS}, {COMPOSITE}, {PRIMARY},
    tn as (select cluster_id, min_by(substr(x, strpos(x, ':') + 1), (-w, x)) as top_node from (select cluster_id, x, {WEIGHT} as w from (select cluster_id, unnest(nodes) as x from c where cluster_id >= 0)) group by 1),
    ct as (select cluster_id, list_slice(list_sort(list(distinct country)), 1, 2) as cs from c where cluster_id >= 0 and trim(coalesce(country, '')) <> '' group by 1)
    select sev.cluster_id, concat_ws(' — ', upper(substr(severity, 1, 1)) || lower(substr(severity, 2)) || ' composite risk (' || cast(round_even(composite, 0) as integer) || '/100)',
      case when primary_domain is not null then case when intensity >= 75 then 'high-intensity' when intensity >= 50 then 'moderate' else 'low-level' end || ' ' || primary_domain || ' signal' end,
      case when top_node is not null then 'affecting ' || top_node || case when len(cs) > 0 then ' in ' || array_to_string(cs, ', ') else '' end end,
      'corroborated by ' || sources || ' source' || case when sources = 1 then '' else 's' end) || '.' as narrative
    from sev left join pd using (cluster_id) left join tn using (cluster_id) left join ct using (cluster_id)""")
def risk_narrative(spark: SparkSession, d: str) -> DataFrame:
    own = articles(spark, d)
    places = own.where((F.col("cluster_id") >= 0) & (F.trim(F.coalesce("country", F.lit(""))) != "")).groupBy("cluster_id").agg(F.array_sort(F.collect_set("country")).alias("countries"))
    full = K.composite(K.cluster_dimensions(own, AS_OF)).join(K.primary_domain(own), "cluster_id", "left").join(K.top_node(own), "cluster_id", "left").join(places, "cluster_id", "left")
    return K.narrative(full).select("cluster_id", "narrative")


PORTFOLIO = f"""{C}, {DIMS}, {COMPOSITE},
    pf as (select round(coalesce(sum(composite * case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end) / sum(case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end), 0), 1) as overall_score,
      count(*) as clusters, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low from sev),
    ps as (select *, case when overall_score >= 75 then 'CRITICAL' when overall_score >= 55 then 'HIGH' when overall_score >= 35 then 'MEDIUM' else 'LOW' end as overall_severity from pf)"""


@query(f"""with {PORTFOLIO} select *, case overall_severity
      when 'CRITICAL' then critical || ' critical and ' || high || ' high-severity event' || case when critical + high = 1 then '' else 's' end || ' detected. Immediate executive review required.'
      when 'HIGH' then high || ' high-severity event' || case when high = 1 then '' else 's' end || ' detected across your supply chain exposure. Prompt review recommended.'
      when 'MEDIUM' then medium || ' medium-severity event' || case when medium = 1 then '' else 's' end || ' identified. Monitor developments and review affected nodes.'
      else 'No significant disruption signals detected across your supply chain.' end as message from ps""")
def portfolio_risk(spark: SparkSession, d: str) -> DataFrame:
    return K.portfolio(scored(spark, d))


@query(f"with {C} select {KNOWN.format('domain')} as domain, count(*) as n from c where {KNOWN.format('domain')} is not null group by 1")
def domain_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return K.domain_breakdown(articles(spark, d))


@query(f"with {C}, {DIMS}, {COMPOSITE} select cluster_id, composite, severity from sev order by composite desc, cluster_id limit 3")
def top_clusters(spark: SparkSession, d: str) -> DataFrame:
    return K.top_clusters(scored(spark, d)).select("cluster_id", "composite", "severity")


@query(f"""with {C}, l as (select cluster_id, max(case upper(level) when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end) as r, max(score) as risk_score, count(*) as articles, array_to_string(list_sort(list(distinct source)), '|') as sources from c where cluster_id >= 0 group by 1),
    n as (select cluster_id, string_agg(x, '|' order by x) as nodes from (select distinct cluster_id, unnest(nodes) as x from c where cluster_id >= 0) group by 1)
    select l.cluster_id, case r when 3 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as impact_level, risk_score, articles, coalesce(sources, '') as sources, coalesce(n.nodes, '') as nodes from l left join n using (cluster_id)""")
def cluster_rollup(spark: SparkSession, d: str) -> DataFrame:
    return K.cluster_rollup(articles(spark, d))


@query("""with e as (select lower(split_part(x, ':', 1)) as node_type, substr(x, strpos(x, ':') + 1) as node, upper(impact_level) as level, relevance_score from (select unnest(linked_nodes) as x, impact_level, relevance_score from preprocessed_articles)),
    n as (select distinct 'supplier' as node_type, x.name as node from (select unnest(tier1_suppliers) as x from client_profiles) union select distinct 'material', x.commodity from (select unnest(raw_materials) as x from client_profiles) union select distinct coalesce(x.type, 'node'), x.name from (select unnest(logistics_nodes) as x from client_profiles)),
    g as (select node_type, node, count(*) filter (level = 'HIGH') as high, count(*) filter (level = 'MEDIUM') as medium, count(*) filter (level = 'LOW') as low, max(relevance_score) as best from e group by 1, 2)
    select n.node_type, n.node, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(low, 0) as low, cast(coalesce(best, 0) as bigint) as max_score from n left join g using (node_type, node) where trim(coalesce(n.node, '')) <> ''""")
def node_risk_summary(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.exposure import exposure_nodes

    rows = table(spark, d, "preprocessed_articles").select(F.col("linked_nodes").alias("nodes"), F.col("impact_level").alias("level"), F.col("relevance_score").alias("score"))
    return K.node_risk(rows, exposure_nodes(table(spark, d, "client_profiles")))


VOTE = "case when coalesce(industry_label, 'general') = 'general' then -1 else length(industry_label) end"


@query(f"""with v as (select cluster_id, {VOTE} as topic_id, count(*) as n, min(record_id) as first from corpus_records where cluster_id >= 0 group by 1, 2)
    select cluster_id, cast(topic_id as integer) as topic_id from v qualify row_number() over (partition by cluster_id order by (topic_id = -1)::integer, n desc, first) = 1""")
def topic_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_records").where(F.col("cluster_id") >= 0).select("cluster_id", F.expr(VOTE).cast("int").alias("topic_id"), F.col("record_id").alias("pos"))
    return K.plurality(rows)


def _has(words: list[str]) -> str:
    return " + ".join(f"max(cast(contains(lower(text), {lit(w)}) as integer))" for w in words)


TOPICS = f"""lt as (select coalesce(industry_label, 'general') as topic, impact_level as level, risk_score_norm * 100 as score, coalesce(extractive_summary, '') as text, disruption_domain as domain, coalesce(semantic_category, 'none') as industry,
      coalesce(title, '') as commodity, coalesce(trust_score, 0) >= 0.7 as verified, coalesce(trust_score, 1) < 0.56 as rejected from corpus_records),
    lg as (select topic, count(*) as articles, round(least(10.0e0, 0.5e0 * (count(*) filter (upper(level) = 'HIGH') * 9 + count(*) filter (upper(level) = 'MEDIUM') * 5) / count(*) + 0.3e0 * least(3.0e0, 0.5e0 * ({_has(X.HIGH_SEVERITY)}) + 0.2e0 * ({_has(X.MEDIUM_SEVERITY)})) + 0.2e0 * avg(score) / 10), 4) as severity,
      min(domain) as domain, count(distinct industry) as industries, max(greatest({', '.join(f"case when contains(lower(commodity), {lit(k)}) then {v}e0 else 1e0 end" for k, v in X.CONCENTRATION.items())})) as factor, count(*) filter (verified) as verified, count(*) filter (rejected) as rejected from lt group by topic),
    lp as (select *, least(10.0e0, (case lower(domain) {' '.join(f"when {lit(k)} then {v}e0" for k, v in X.PROPAGATION.items())} else 4e0 end) + least(0.4e0 * industries, 2.0e0)) as propagation,
      round(least(severity * factor, 10.0e0), 4) as concentration,
      case when articles >= 20 then 9.5e0 when articles >= 11 then 8e0 when articles >= 6 then 6.5e0 when articles >= 3 then 4e0 else articles::double end as velocity,
      case when articles = 0 then 0.9e0 when rejected > 0 then 0.8e0 when verified = 0 then 0.9e0 when verified = articles then 1.1e0 when verified * 2 >= articles then 1.05e0 else 1e0 end as multiplier from lg),
    lr as (select *, round(least(10.0e0, round((severity + propagation + concentration + velocity) / 4 * multiplier, 6)), 2) as risk from lp)"""


def legacy_articles(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c, v: F.coalesce(c, F.lit(v))
    return table(spark, d, "corpus_records").select(
        none("industry_label", "general").alias("topic"), F.col("impact_level").alias("level"), (F.col("risk_score_norm") * 100).alias("score"), none("extractive_summary", "").alias("text"), F.col("disruption_domain").alias("domain"),
        none("semantic_category", "none").alias("industry"), none("title", "").alias("commodity"), (none("trust_score", 0.0) >= 0.7).alias("verified"), (none("trust_score", 1.0) < 0.56).alias("rejected"),
    )


def _legacy(name: str, column: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return L.score_topics(legacy_articles(spark, d)).select("topic", column)

    run.__name__ = f"legacy_{name}"
    query(f"with {TOPICS} select topic, {column} from lr")(run)


for _name in ("severity", "propagation", "concentration", "velocity"):
    _legacy(_name, _name)
_legacy("verification", "multiplier")


@query(f"with {TOPICS} select topic, articles, risk, case when risk >= 8 then 'CRITICAL' when risk >= 6 then 'HIGH' when risk >= 3.5 then 'MEDIUM' else 'LOW' end as risk_level from lr")
def legacy_composite(spark: SparkSession, d: str) -> DataFrame:
    return L.score_topics(legacy_articles(spark, d)).select("topic", "articles", "risk", "risk_level")


@query("""with g as (select count(*) filter (upper(impact_level) = 'HIGH') as high, count(*) filter (upper(impact_level) = 'MEDIUM') as medium from corpus_records)
    select high, medium, cast(least(high * 20 + medium * 10, 100) as bigint) as score, case when high >= 5 then 'HIGH' when high >= 1 then 'MEDIUM' else 'LOW' end as badge from g""")
def legacy_overall(spark: SparkSession, d: str) -> DataFrame:
    return L.overall(table(spark, d, "corpus_records").select(F.col("impact_level").alias("level")))


@query(f"with {TOPICS} select topic, round(risk, 2) as risk, case when risk >= 8 then 'CRITICAL' when risk >= 6 then 'HIGH' when risk >= 3.5 then 'MEDIUM' else 'LOW' end as impact_level, articles >= 1 as scored from lr union all select 'unscored', null, 'LOW', false")
def legacy_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Topics as clusters with their risk; one without a score keeps its level."""
    scores = L.score_topics(legacy_articles(spark, d))
    clusters = scores.select("topic").unionByName(spark.createDataFrame([("unscored",)], "topic string")).withColumn("impact_level", F.lit("LOW"))
    return L.enrich(clusters, scores).select("topic", "risk", "impact_level", F.col("risk_breakdown").isNotNull().alias("scored"))


@query(f"""with {TOPICS}, b as (select count(*) as clusters, coalesce(max(risk), 0) as best, count(*) filter (risk >= 8) as critical, count(*) filter (risk >= 6 and risk < 8) as high from lr)
    select case when best >= 8 or critical >= 1 then 'HIGH' when best >= 6 or high >= 1 then 'MEDIUM' else 'LOW' end as badge, cast(least(floor(round(best * 10, 6)), 100) as bigint) as score, clusters, critical, high from b""")
def legacy_badge(spark: SparkSession, d: str) -> DataFrame:
    """The overall badge by the best score."""
    return L.overall_of_clusters(L.score_topics(legacy_articles(spark, d)).withColumn("is_noise", F.lit(False)))
