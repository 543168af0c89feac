"""Relevance scores, exposure, query generation, sources and filters on the article tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as X
from ..functions.text import outlet_trust, safe_id
from ..operators import exposure as E
from ..operators import filters as FL
from ..operators import relevance as R
from ..session import table
from ..sources import feeds, runs
from .base import query

KEYS = ["article_id", "run_id"]
TEXT = "lower(concat_ws(' ', coalesce(clean_title, ''), coalesce(clean_body, '')))"
BASE = f"t as (select article_id, run_id, trust_score, {TEXT} as t from preprocessed_articles)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def padded_sql(x: str) -> str:
    return rf"(' ' || trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')"


def count_sql(words: list[str], t: str = "t") -> str:
    return "(" + " + ".join(f"cast(contains({t}, {lit(w)}) as integer)" for w in words) + ")"


def _domains_sql() -> str:
    hits = [f"case when regexp_matches(t, {lit(X.whole_words(ws))}) then {lit(d)} end" for d, ws in X.SAMPLE_LEXICON.items()]
    for d, ws in X.INLINE_DOMAINS.items():
        no = f" and not regexp_matches(t, {lit(X.whole_words(X.SAMPLE_LEXICON[d]))})" if d in X.SAMPLE_LEXICON else ""
        hits.append(f"case when {count_sql(ws)} > 0{no} then {lit(d)} end")
    return f"list_filter([{', '.join(hits)}], lambda x: x is not null)"


def _points_sql(ds: str = "ds") -> str:
    case = "case x " + " ".join(f"when {lit(d)} then {p}" for d, p in X.DOMAIN_POINTS.items()) + f" else {X.OTHER_DOMAIN_POINTS} end"
    return f"cast(least(coalesce(list_sum(list_transform({ds}, lambda x: {case})), 0) + case when len({ds}) >= 2 then {X.MULTI_DOMAIN_BONUS} else 0 end, 35) as integer)"


DENSITY = f"case when {count_sql(X.SUPPLY_CHAIN)} = 0 then 0 when {count_sql(X.SUPPLY_CHAIN)} = 1 then 6 when {count_sql(X.SUPPLY_CHAIN)} = 2 then 11 when {count_sql(X.SUPPLY_CHAIN)} <= 4 then 16 else 20 end"
PENALTY = f"case when {count_sql(X.PRESS_RELEASE)} >= 2 then 15 when {count_sql(X.PRESS_RELEASE)} = 1 then 5 else 0 end"
TRUST = "least(cast(round_even(coalesce(trust_score, 0.5) * 10, 0) as integer), 10)"

def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "preprocessed_articles")


@query(f"with {BASE}, d as (select *, {_domains_sql()} as ds from t) select article_id, run_id, array_to_string(ds, ',') as domains, {_points_sql()} as disruption from d")
def score_disruption(spark: SparkSession, d: str) -> DataFrame:
    own = _articles(spark, d).select(*KEYS, R.article_text().alias("_text")).withColumn("ds", R.disruption_domains("_text"))
    return own.select(*KEYS, F.array_join("ds", ",").alias("domains"), R.disruption_score(F.col("ds")).alias("disruption"))


@query(f"with {BASE} select article_id, run_id, {DENSITY} as supply_chain from t")
def score_keyword_density(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select(*KEYS, R.article_text().alias("_text")).select(*KEYS, R.keyword_density("_text").alias("supply_chain"))


@query(f"select article_id, run_id, {TRUST} as trust from preprocessed_articles")
def score_trust(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select(*KEYS, R.trust_points(F.col("trust_score")).alias("trust"))


@query(f"with {BASE} select article_id, run_id, {PENALTY} as penalty from t")
def score_pr_penalty(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select(*KEYS, R.article_text().alias("_text")).select(*KEYS, R.press_penalty("_text").alias("penalty"))


EXPOSURE = """n0 as (
      select client_id, 'supplier' as node_type, x.name as node, 0 as k, i from (select client_id, unnest(tier1_suppliers) as x, generate_subscripts(tier1_suppliers, 1) - 1 as i from client_profiles)
      union all select client_id, 'material', x.commodity, 1, i from (select client_id, unnest(raw_materials) as x, generate_subscripts(raw_materials, 1) - 1 as i from client_profiles)
      union all select client_id, coalesce(x.type, 'node'), x.name, 2, i from (select client_id, unnest(logistics_nodes) as x, generate_subscripts(logistics_nodes, 1) - 1 as i from client_profiles))"""


@query(f"with {EXPOSURE} select client_id, node_type, node, cast(row_number() over (partition by client_id order by min((k, i)), node_type, node) - 1 as integer) as pos from n0 where trim(coalesce(node, '')) <> '' group by client_id, node_type, node")
def exposure_map(spark: SparkSession, d: str) -> DataFrame:
    return E.exposure_nodes(table(spark, d, "client_profiles"))


@query("""
    with s as (select client_id, unnest(tier1_suppliers) as x from client_profiles), c as (select distinct client_id, x.country as country from s where trim(coalesce(x.country, '')) <> '')
    select c.client_id, c.country, (select min(n_name) from nation where lower(n_name) = lower(trim(c.country))) as resolved from c""")
def exposure_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Countries of suppliers looked up in a dimension without regard to case; unresolved ones stay with null."""
    raw = table(spark, d, "client_profiles").select("client_id", F.explode("tier1_suppliers").alias("x")).select("client_id", F.col("x.country").alias("country")).where(F.trim(F.coalesce("country", F.lit(""))) != "").distinct()
    dimension = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    return E.resolve_names(raw, dimension, name="country", key="name").select("client_id", "country", "resolved")


@query(f"select n_name as country, substring('\"' || n_name || '\" AND (' || {lit(E.quoted(X.COUNTRY_TERMS))} || ')', 1, 500) as query from nation")
def country_queries(spark: SparkSession, d: str) -> DataFrame:
    return E.country_queries(table(spark, d, "nation").withColumnRenamed("n_name", "country"))


@query("select source, 'https://news.example/rss/search?q=' || url_encode(source) as url from feed_sources")
def url_build(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feed_sources").select("source", E.search_url(F.col("source")).alias("url"))


@query("select client_id, client_name, regexp_replace(replace(lower(client_name), ' ', '_'), '[^\\p{L}\\p{N}_-]', '', 'g') as file_id, len(tier1_suppliers)::integer as suppliers, len(raw_materials)::integer as materials, len(logistics_nodes)::integer as nodes, len(own_facilities)::integer as facilities from client_profiles")
def client_summaries(spark: SparkSession, d: str) -> DataFrame:
    return runs.client_summaries(table(spark, d, "client_profiles"))


@query("""
    select run_id, regexp_replace(run_id, '_\\d{8}_\\d{6}$', '') as client, count(*) as articles, count(*) filter (upper(impact_level) = 'HIGH') as high, coalesce(sum(len(linked_nodes)), 0)::bigint as nodes
    from preprocessed_articles group by run_id""")
def run_listing(spark: SparkSession, d: str) -> DataFrame:
    return runs.list_runs(_articles(spark, d)).withColumn("nodes", F.coalesce("nodes", F.lit(0)).cast("bigint"))


@query("""
    select record_id, url from (select record_id, url, row_number() over (partition by md5(lower(trim(url))) order by record_id) as r from corpus_records where trim(coalesce(url, '')) <> '') where r = 1""")
def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_records").select("record_id", "url")
    return feeds.dedup_addresses(rows, order=["record_id"])


@query("""
    with r as (select source, doc_id, row_number() over (partition by source order by crawled_at, doc_id) as r from documents) select source, doc_id, cast(r as integer) as rank from r where r <= 15""")
def per_source_cap15(spark: SparkSession, d: str) -> DataFrame:
    """The first fifteen documents of each source, as a feed's page holds: a top-k report."""
    from ..operators.vectors import rank_rows
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("source", "doc_id", "crawled_at")
    cut = rank_rows(rows, ["source"], [F.col("crawled_at"), F.col("doc_id")], 15)
    return cut.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("crawled_at", "doc_id")).cast("int").alias("rank"))


def _outlet_sql() -> str:
    whens = " ".join(f"when contains(lower(coalesce(source, '')), {lit(o)}) then {v}" for o, v in X.OUTLET_TRUST.items())
    return f"select source, cast(case {whens} else {X.OTHER_TRUST} end as double) as trust, count(*) as n from corpus_records group by 1, 2"


@query(_outlet_sql())
def outlet_trust_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_records").groupBy("source").agg(F.count("*").alias("n")).select("source", outlet_trust(F.col("source")).alias("trust"), "n")


@query("""
    with b as (select source as name, url, case category when 'local' then 0 when 'government' then 1 when 'global_wire' then 2 else 3 end as o, category as bucket, trust_score from feed_sources
               where (country = 'Germany' or country is null) and trim(coalesce(url, '')) <> ''),
         r as (select *, row_number() over (partition by url order by o, name) as r from b)
    select name, url, bucket, coalesce(trust_score, 0.65) as trust_score from r where r = 1""")
def source_registry_merge(spark: SparkSession, d: str) -> DataFrame:
    registry = table(spark, d, "feed_sources").select("country", F.col("category").alias("bucket"), F.lit(0).alias("pos"), F.col("source").alias("name"), "url", "trust_score")
    return feeds.select_sources(registry, "Germany")


@query("""
    select record_id, regexp_replace(trim(coalesce(title, '')), '\\s+', ' ', 'g') as title, trim(url) as url from corpus_records
    where trim(coalesce(url, '')) not in ('', 'https://removed.com') and trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) not in ('', '[Removed]')""")
def feed_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_records").select(F.lit("f").alias("feed"), F.col("record_id").alias("pos"), "title", F.col("url").alias("link"), F.lit("").alias("description"), "published", "source")
    return feeds.normalise_entries(rows).select(F.col("pos").alias("record_id"), "title", "url")


@query("""
    select article_id, run_id from preprocessed_articles
    where upper(impact_level) in ('HIGH', 'MEDIUM') and upper(country) in ('GERMANY', 'FRANCE', 'SPAIN') and trust_score >= 0.6 and fetched_at >= timestamp '2023-06-01' - interval '720 hours'""")
def filter_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).withColumn("published_ts", F.col("fetched_at").cast("timestamp"))
    chosen = FL.Filters(levels=["HIGH", "MEDIUM"], countries=["Germany", "France", "Spain"], least_trust=0.6, within_hours=720, as_of="2023-06-01 00:00:00")
    return FL.apply_filters(rows, chosen).select(*KEYS)


@query("select semantic_category as category, count(*) as n from article_encodings where semantic_category is not null and lower(semantic_category) <> 'unknown' group by 1")
def category_facet(spark: SparkSession, d: str) -> DataFrame:
    return FL.category_facet(table(spark, d, "article_encodings"))


@query(f"select article_id, clean_title from preprocessed_articles where contains({TEXT}, 'shortage') order by article_id, clean_title limit 10")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return FL.keyword_search(_articles(spark, d), "shortage", key="article_id", title="clean_title", body="clean_body")


@query("select source, regexp_replace(replace(lower(source), ' ', '_'), '[^\\p{L}\\p{N}_-]', '', 'g') as safe from feed_sources")
def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feed_sources").select("source", safe_id(F.col("source")).alias("safe"))
