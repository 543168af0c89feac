"""Fetch plans and the stages of an analysis, one query a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve as V
from ..operators import stages as ST
from ..operators import topics as TP
from ..session import table
from ..sources import fetch as FE
from . import sample_dims as D
from .base import query
from .q_exposure import BOUND, _prongs_sql
from .q_text import SPLIT, USABLE, _articles

AS_OF = "2025-06-01"
QUERIES_CTE = "cq as (" + _prongs_sql() + ")"
REGISTRY = "reg as (select case when category in ('local', 'government') then country end as country, category as bucket, 0 as pos, source as name, url, trust_score, case category when 'local' then 0 when 'government' then 1 when 'global_wire' then 2 else 3 end as b from feed_sources where trim(coalesce(url, '')) <> '')"


def _registry(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("category").isin("local", "government"), F.col("country"))
    return table(spark, d, "feed_sources").select(own.alias("country"), F.col("category").alias("bucket"), F.lit(0).alias("pos"), F.col("source").alias("name"), "url", "trust_score")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return V.generate_queries(table(spark, d, "client_profiles"), D.tables(spark))


@query(f"""with {BOUND}, {REGISTRY},
    e as (select c.client_id, c.country, r.name, r.url, r.trust_score, r.bucket, r.b from countries c join reg r on r.country = c.country or r.country is null),
    u as (select * from e qualify row_number() over (partition by client_id, country, url order by b, name) = 1)
    select client_id, country, cast(row_number() over (partition by client_id, country order by b, name) - 1 as integer) as pos, name, url, coalesce(trust_score, 0.65) as trust_score, bucket as category from u""")
def fetch_country_plan(spark: SparkSession, d: str) -> DataFrame:
    return FE.country_plan(V.exposure_countries(table(spark, d, "client_profiles"), D.tables(spark)), _registry(spark, d))


@query(f"with {QUERIES_CTE} select client_id, pos, query, 'https://news.example/rss/search?q=' || url_encode(query) as url, 'Google News: ' || substring(query, 1, 60) as source, 0.7e0 as trust_score, 'google_news' as category from cq where pos < 15")
def fetch_query_plan(spark: SparkSession, d: str) -> DataFrame:
    """The first fifteen queries of each client: the stage's own cut."""
    return FE.query_plan(_queries(spark, d))


@query(f"with {QUERIES_CTE} select client_id, pos, substring(query, 1, 500) as q, strftime(date '{AS_OF}' - 3, '%Y-%m-%d') as from_date, 'en' as language, 'publishedAt' as sort, 10 as page_size from cq")
def fetch_service_plan(spark: SparkSession, d: str) -> DataFrame:
    return FE.service_plan(_queries(spark, d), AS_OF)


@query(f"""with {BOUND}, {QUERIES_CTE}, near as (select distinct client_id, city from towns where pos < 3)
    select client_id, pos, query from cq q where not (contains(query, '"') and contains(query, ' AND (') and exists (select 1 from near n where n.client_id = q.client_id and contains(q.query, n.city)))""")
def fetch_phase_four(spark: SparkSession, d: str) -> DataFrame:
    """Queries without the city queries of the phases before."""
    cities = V.exposure_cities(table(spark, d, "client_profiles"), D.tables(spark))
    return FE.phase_four(_queries(spark, d), cities).select("client_id", "pos", "query")


@query(r"""with p as (select record_id, regexp_replace(trim(coalesce(published, '')), '^[A-Za-z]{3},\s*', '') as b from corpus_records),
    m as (select record_id, case when regexp_full_match(b, '\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} ([+-]\d{4}|GMT|UTC|Z)') then try_strptime(regexp_replace(b, '(GMT|UTC|Z)$', '+0000'), '%d %b %Y %H:%M:%S %z')
      when regexp_full_match(b, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?') then try_strptime(replace(b[1:19], 'T', ' ') || case when regexp_extract(b, '(Z|[+-]\d{2}:\d{2})$', 1) in ('', 'Z') then '+00:00' else regexp_extract(b, '(Z|[+-]\d{2}:\d{2})$', 1) end, '%Y-%m-%d %H:%M:%S%z') end as t from p)
    select record_id, strftime(t at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as published from m where t is not null""")
def feed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of feeds in RFC 2822 and ISO 8601 as UTC."""
    rows = table(spark, d, "corpus_records").select("record_id", FE.feed_moment(F.trim("published")).alias("t")).where("t is not null")
    return rows.select("record_id", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"))


@query("select article_id, run_id, coalesce(published, '') as published_at, coalesce(clean_body, '') as description, coalesce(category, 'unknown') as source_type, coalesce(trust_score, 0.5) as trust_score from preprocessed_articles")
def field_aliases(spark: SparkSession, d: str) -> DataFrame:
    return ST.with_aliases(_articles(spark, d).withColumn("summary", F.col("clean_body"))).select("article_id", "run_id", "published_at", "description", "source_type", "trust_score")


NAMES = {"Nornalwick": "GPE", "Corulness": "LOC", "Karcalsund": "GPE", "Belveleno Bay": "GPE", "Nalyalfield": "GPE"}
KINDS = {"supplier": {"balanmarys chemicals"}, "port": {"nornalwick"}, "route": {"corulness"}}


def _tags_sql(x: str) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({x}, '(^|[^\\p{{L}}\\p{{N}}_]){n}([^\\p{{L}}\\p{{N}}_]|$)') then {{'t': '{n}', 'l': '{label}'}} end" for n, label in NAMES.items()) + "], lambda y: y is not null)"


@query(f"""with a as (select article_id, run_id, coalesce(matched_entities, []) as m, {_tags_sql("concat_ws(' ', coalesce(title, ''), coalesce(clean_body, ''))")} as tags from preprocessed_articles),
    e as (select article_id, run_id, i as k, trim(regexp_replace(regexp_replace(trim(x), '[''’]s$', ''), '^(the|an|a)\\s+', '', 'i')) as text, 'RULE' as label from (select article_id, run_id, unnest(m) as x, generate_subscripts(m, 1) as i from a)
          union all select article_id, run_id, 1000000 + i, y.t, y.l from (select article_id, run_id, unnest(tags) as y, generate_subscripts(tags, 1) as i from a)),
    f as (select * from e qualify row_number() over (partition by article_id, run_id, lower(text) order by k) = 1)
    select article_id, run_id, string_agg(text || '/' || label || '/' || case lower(text) when 'balanmarys chemicals' then 'supplier' when 'nornalwick' then 'port' when 'corulness' then 'route' else '' end, '|' order by k) as entities from f group by 1, 2""")
def ner_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Matched names and names tagged by a gazetteer, fused, with the node types they stand for."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("clean_body", F.lit("")))
    rows = _articles(spark, d).select("article_id", "run_id", "matched_entities", ST.tag_entities(text, ST.gazetteer(NAMES)).alias("t")).select("*", F.col("t.entities").alias("tagged"))
    made = ST.fuse_rows(rows, by=["article_id", "run_id"], matched="matched_entities", entities="tagged", kinds=KINDS)
    shown = F.transform("ner_entities", lambda e: F.concat(e["text"], F.lit("/"), e["label"], F.lit("/"), F.coalesce(e["node_type"], F.lit(""))))
    shown = F.array_compact(shown)
    return made.select("article_id", "run_id", F.when(F.size(shown) > 0, F.array_join(shown, "|")).alias("entities"))


@query(f"""with a as (select {USABLE} as s, coalesce(len(list_distinct(list_transform(coalesce(matched_entities, []), lambda x: lower(trim(x))))), 0) as e, coalesce(title, '') as t from preprocessed_articles),
    b as (select len(s) as n, e, array_to_string(s, '  ') as body, t from a),
    c as (select n, e, floor(length('[TITLE] ' || t || '  [BODY] ' || case when length(body) > 512 then regexp_replace(body[1:512], ' [^ ]*$', '') || '...' else body end) * 0.75) as k from b)
    select count(*) as articles, round(sum(n) / greatest(count(*), 1), 2) as sentences, round(sum(e) / greatest(count(*), 1), 2) as entities, round(sum(k) / greatest(count(*), 1), 2) as tokens from c""")
def entity_averages(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).withColumn("matched", F.transform("matched_entities", lambda x: F.lower(F.trim(x))))
    return ST.entity_averages(ST.preprocess(rows, title="title", body="clean_body", clean=False))


@query(f"""select article_id, run_id, '[TITLE] ' || coalesce(title, '') || '  [BODY] ' || case when length(b) > 512 then regexp_replace(b[1:512], ' [^ ]*$', '') || '...' else b end as text, n as sentences
    from (select article_id, run_id, title, clean_body, array_to_string({USABLE}, '  ') as b, len({USABLE})::integer as n from preprocessed_articles) where trim(coalesce(title, '') || coalesce(clean_body, '')) <> ''""")
def encoder_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).withColumn("key", F.concat_ws("/", "article_id", "run_id"))
    made = ST.preprocess(rows, key="key", title="title", body="clean_body", clean=False)
    payload = ST.encoder_payload(made, key="key", with_entities=False)
    parts = F.split("key", "/", 2)
    return payload.select(parts[0].cast("bigint").alias("article_id"), parts[1].alias("run_id"), "text", F.size("sentences").alias("sentences"))


@query()
def encode_articles(spark: SparkSession, d: str) -> DataFrame:
    """Vectors, categories and core paragraphs of all articles by the encoder of hashed words."""
    rows = _articles(spark, d).dropDuplicates(["article_id"])
    payload = ST.encoder_payload(ST.preprocess(rows, title="title", body="clean_body", clean=False))
    return ST.encode(payload, _centroids(spark), dim=64).select("article_id", "semantic_category", "semantic_score", "core_paragraph_idx", "sbert_encoded")


def _centroids(spark: SparkSession) -> DataFrame:
    about = [("conflict", "war attack troops border missile"), ("weather", "storm flood drought rain heat"), ("labour", "strike union wage workers walkout"), ("trade", "tariff export sanctions customs levy")]
    texts = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(about)], "pos long, category string, text string")
    return texts.join(ST.hash_encode(texts, key="pos", text="text", dim=64), "pos").select("category", F.col("pos").cast("int").alias("pos"), F.col("embedding").cast("array<double>").alias("centroid"))


@query("select article_id, run_id, lower(concat_ws(' ', coalesce(title, ''), substring(coalesce(clean_body, ''), 1, 300))) as text from preprocessed_articles")
def topic_document_text(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("article_id", "run_id", ST.document_text(F.col("title"), F.col("clean_body")).alias("text"))


VOTES = """top(topic_id, label) as (values (0, 'Zero'), (1, 'One'), (2, '')), asg as (select vec_id, case when vec_id % 7 = 0 then -1 else cast(vec_id % 5 as integer) end as topic_id from embeddings where vec_id % 11 <> 0)"""


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    got = v.where("vec_id % 11 <> 0").select("vec_id", F.when(F.col("vec_id") % 7 == 0, -1).otherwise((F.col("vec_id") % 5).cast("int")).alias("topic_id"))
    return v, got, spark.createDataFrame([(0, "Zero"), (1, "One"), (2, "")], "topic_id int, label string")


@query(f"""with {VOTES}, v as (select e.label as cluster_id, e.vec_id, coalesce(a.topic_id, -1) as topic_id from embeddings e left join asg a using (vec_id)),
    c as (select cluster_id, topic_id, count(*) as n, min(vec_id) as f from v group by 1, 2), w as (select cluster_id, topic_id from c qualify row_number() over (partition by cluster_id order by (topic_id = -1)::integer, n desc, f) = 1)
    select cluster_id, w.topic_id, coalesce(nullif(label, ''), 'General News') as topic_label from w left join top using (topic_id)""")
def attach_topics(spark: SparkSession, d: str) -> DataFrame:
    v, got, names = _assigned(spark, d)
    return ST.attach_topics(v.select(F.col("label").alias("cluster_id"), "vec_id", F.col("vec_id").alias("pos")), got, names, key="vec_id")


@query(f"""with {VOTES} select topic_id, count(*) as articles, case max(case label % 3 when 0 then 3 when 1 then 2 else 1 end) when 3 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as impact_level, max(label) as risk_score from asg join embeddings using (vec_id) where topic_id >= 0 group by 1""")
def topic_rollup(spark: SparkSession, d: str) -> DataFrame:
    v, got, _ = _assigned(spark, d)
    level = F.when(F.col("label") % 3 == 0, "high").when(F.col("label") % 3 == 1, "Medium").otherwise("LOW")
    return ST.topic_rollup(v.withColumn("impact_level", level).withColumn("relevance_score", F.col("label")), got, key="vec_id")


@query("""with g as (select cluster_id, count(*) as article_count, min_by(title, record_id) as headline, min_by(extractive_summary, record_id) as summary, list_sort(list(distinct 'outlet:' || source) filter (source is not null)) as nodes from corpus_records group by 1)
    select cluster_id, coalesce(headline, '') as headline, case when cluster_id >= 0 and article_count >= 2 then array_to_string(list_slice(string_split(summary, ' ||| '), 1, 3), '  ') else coalesce(summary, '') end as what_happened,
      array_to_string(list_transform(coalesce(nodes, []), lambda n: n[8:]), '|') as affected, 'fallback' as source, case when cluster_id >= 0 and article_count >= 2 then len(string_split(summary, ' ||| ')) else 0 end::integer as mmr from g""")
def attach_briefs(spark: SparkSession, d: str) -> DataFrame:
    """Briefs of all clusters, noise among them, where no language model is given."""
    g = table(spark, d, "corpus_records").groupBy("cluster_id").agg(
        F.count("*").alias("article_count"), F.min_by("title", "record_id").alias("headline"), F.min_by("extractive_summary", "record_id").alias("summary"), F.array_sort(F.collect_set(F.concat(F.lit("outlet:"), F.col("source")))).alias("linked_nodes")
    )
    made = ST.attach_briefs(g.withColumn("is_noise", F.col("cluster_id") < 0).withColumn("mmr_sentences", F.split("summary", r" \|\|\| ")))
    return made.select("cluster_id", "brief.headline", "brief.what_happened", F.array_join("brief.affected_nodes", "|").alias("affected"), "brief.source", F.col("brief.mmr_sentence_count").alias("mmr"))


@query(f"""with s as (select article_id, trim(s) as s, i from (select article_id, unnest(x) as s, generate_subscripts(x, 1) as i from (select article_id, {SPLIT.format("coalesce(clean_body, '')")} as x from preprocessed_articles qualify row_number() over (partition by article_id order by run_id) = 1)) where length(trim(s)) >= 40),
    c as (select article_id, i, case when length(s) > 300 then regexp_replace(s[1:300], '\\s+\\S*$', '') || '…' else s end as text from s),
    k as (select article_id, substring(lower(text), 1, 80) as k, min(i) as p, arg_min(text, i) as text from c group by 1, 2)
    select article_id, cast(row_number() over (partition by article_id order by p) as integer) as rank, text from k qualify row_number() over (partition by article_id order by p) <= 6""")
def brief_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences for briefs where there are no vectors: of fit length, distinct by their beginning."""
    from ..operators.vectors import rank_rows

    rows = rank_rows(_articles(spark, d).select("article_id", "run_id", "clean_body"), ["article_id"], [F.col("run_id")], 1)
    rows = rows.select("article_id", F.posexplode(ST.brief_sentences(F.coalesce("clean_body", F.lit("")))).alias("pos", "text"))
    return ST.distinct_sentences(rows, by="article_id", pos="pos", text="text")


@query("""with s as (select cluster_id, cluster_id < 0 as is_noise, count(*) as cluster_size from corpus_records group by 1) select cluster_id, cluster_size, cast(row_number() over (order by is_noise, cluster_size desc, cluster_id) as integer) as place from s""")
def cluster_order(spark: SparkSession, d: str) -> DataFrame:
    """Clusters as they are listed; the place makes the order a column."""
    s = table(spark, d, "corpus_records").groupBy("cluster_id").agg(F.count("*").alias("cluster_size")).withColumn("is_noise", F.col("cluster_id") < 0)
    from pyspark.sql import Window

    # One row per cluster; a listing is read in one order by nature.
    place = F.row_number().over(Window.orderBy("is_noise", F.col("cluster_size").desc(), "cluster_id"))
    return s.select("cluster_id", "cluster_size", place.cast("int").alias("place"))


@query("""select record_id from corpus_records where list_has_any([lower(disruption_domain)], ['conflict', 'weather']) and upper(impact_level) in ('HIGH', 'MEDIUM')""")
def filter_domains(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_records").select("record_id", F.array_compact(F.array("disruption_domain")).alias("disruption_domains"), "impact_level", F.lit(None).cast("string").alias("severity"))
    return ST.filter_clusters(rows.withColumns({"affected_nodes": F.lit(None).cast("array<string>"), "linked_nodes": F.lit(None).cast("array<string>")}), severities=["High", "Medium"], domains=["Conflict", "weather"]).select("record_id")


@query("""with t as (select unnest(['Reuters says: ```json {"headline": "A", "n": 1} ``` ok', 'no object', '{"headline": "B"', '{"n": 2}']) as t, unnest([1, 2, 3, 4]) as i)
    select i, case i when 1 then 'A' end as headline, case i when 1 then 1 when 4 then 2 end as n from t""")
def reply_parse(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import parse_reply

    rows = spark.createDataFrame([(1, 'Reuters says: ```json {"headline": "A", "n": 1} ``` ok'), (2, "no object"), (3, '{"headline": "B"'), (4, '{"n": 2}')], "i int, t string")
    return rows.withColumn("r", parse_reply(F.col("t"), "headline string, n int")).select("i", "r.headline", "r.n")


@query(f"""with s as (select article_id, run_id, unnest({SPLIT.format("coalesce(clean_body, '')")}) as s from preprocessed_articles)
    select article_id, run_id, count(*) as sentences, count(*) filter (len(regexp_split_to_array(trim(s), '\\s+')) >= 6 and not regexp_full_match(s, '[\\d\\W]+')) as usable, sum(length(case when length(trim(s)) > 320 then regexp_replace(trim(s)[1:320], '\\s+\\S*$', '') || '…' else trim(s) end))::bigint as letters from s group by 1, 2""")
def sentence_usability(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each article that a summary may use, and their letters when long ones are cut."""
    from ..functions import text as T

    rows = _articles(spark, d).select("article_id", "run_id", F.explode(T.split_sentences(F.coalesce("clean_body", F.lit("")))).alias("s"))
    return rows.groupBy("article_id", "run_id").agg(F.count("*").alias("sentences"), F.count_if(T.is_usable(F.col("s"))).alias("usable"), F.sum(F.length(T.clean_sentence(F.col("s")))).cast("bigint").alias("letters"))


@query("""with w as (select source, unnest(['port strike', 'export levy', 'x']) as t, unnest([1, 2, 3]) as r from feed_sources) select source, 'Port Strike Export Levy X' as label from w group by 1""")
def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "feed_sources").select("source", F.posexplode(F.array(F.lit("port strike"), F.lit("export levy"), F.lit("x"), F.lit("never"))).alias("i", "term"))
    return TP.labels(words.withColumn("rank", F.col("i") + 1), by="source")


def analysis(spark: SparkSession, d: str):
    """The whole pipeline over the articles and all clients."""
    from ..operators.analyze import analyze

    rows = _articles(spark, d).select("article_id", "title", F.col("clean_body").alias("summary"), "url", F.col("fetched_at").cast("timestamp").alias("published_ts"), "source", "country", "trust_score")
    return analyze(rows, table(spark, d, "client_profiles"), D.tables(spark), _centroids(spark), "2025-06-01 00:00:00", dim=64)


@query()
def analyze_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Events of every client with scores, topics and briefs: the response of an analysis."""
    return analysis(spark, d).clusters.select("client_id", "cluster_id", "is_noise", "article_count", "impact_level", "risk_score", "composite", "severity", "topic_id", "topic_label", "brief.headline", "brief.what_happened")


@query()
def analyze_portfolio(spark: SparkSession, d: str) -> DataFrame:
    got = analysis(spark, d)
    return got.portfolio.join(got.funnel.withColumnRenamed("clusters", "events"), "client_id", "left")
