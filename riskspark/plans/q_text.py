"""Text cleaning, sentences, entities, keywords, corpus records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import INDUSTRIES, STOP_WORDS, any_of, EDGE_LEFT, EDGE_RIGHT
from ..operators import corpus as CO
from ..operators import summaries as S
from ..operators import topics as TP
from ..session import table
from .q_relevance import lit
from .base import query

SPLIT = r"string_split(regexp_replace({0}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
USABLE = "list_slice(list_filter(" + SPLIT.format("coalesce(clean_body, '')") + ", lambda s: length(s) >= 40), 1, 12)"


def _strip_sql(x: str) -> str:
    # RE2 has no look-ahead: a dot or the end after "via ..." is kept by a group.
    own = T.boilerplate_pattern([p.replace(r".*?(?=\.|$)", r"[^.\n]*") for p in T.BOILERPLATE])
    return f"trim(regexp_replace(regexp_replace(regexp_replace({x}, {lit(own)}, ' ', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))"


def _industry_sql(x: str) -> str:
    whens = []
    for name, words in INDUSTRIES.items():
        single, phrases = [w for w in words if " " not in w], [w for w in words if " " in w]
        hit = f"regexp_matches({x}, {lit(EDGE_LEFT + any_of(single) + EDGE_RIGHT)})"
        hit += f" or regexp_matches({x}, {lit(any_of(phrases))})" if phrases else ""
        whens.append(f"when {hit} then {lit(name)}")
    return f"case {' '.join(whens)} else 'general' end"


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "preprocessed_articles")


@query(f"select article_id, run_id, {_strip_sql('clean_body')} as body from preprocessed_articles where clean_body is not null")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """The part of the cleaning that has built-in functions; the whole is ``functions.text.clean_text``."""
    return _articles(spark, d).where(F.col("clean_body").isNotNull()).select("article_id", "run_id", T.collapse(T.strip_boilerplate(F.col("clean_body"))).alias("body"))


@query()
def clean_text_full(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_records").select("record_id", T.clean_text(F.col("title")).alias("title"))


@query(f"select article_id, run_id, len({USABLE})::integer as sentences, coalesce(list_extract({USABLE}, 1), '') as first from preprocessed_articles")
def sentence_split_filter(spark: SparkSession, d: str) -> DataFrame:
    s = T.usable_sentences(F.coalesce("clean_body", F.lit("")))
    return _articles(spark, d).withColumn("s", s).select("article_id", "run_id", F.size("s").alias("sentences"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"))


@query(f"""with b as (select article_id, run_id, coalesce(clean_title, '') as t, array_to_string({USABLE}, '  ') as b from preprocessed_articles),
    i as (select article_id, run_id, '[TITLE] ' || t || '  [BODY] ' || case when length(b) > 512 then regexp_replace(substring(b, 1, 512), ' [^ ]*$', '') || '...' else b end as input_text from b)
    select *, cast(floor(length(input_text) * 0.75e0) as integer) as tokens from i""")
def input_text_build(spark: SparkSession, d: str) -> DataFrame:
    text = T.input_text(F.coalesce("clean_title", F.lit("")), T.usable_sentences(F.coalesce("clean_body", F.lit(""))))
    return _articles(spark, d).select("article_id", "run_id", text.alias("input_text")).withColumn("tokens", T.token_estimate(F.col("input_text")))


@query("""with e as (select record_id, generate_subscripts(ner_tags, 1) as i, unnest(ner_tags) as x from corpus_records),
    n as (select record_id, i, x.label as label, trim(regexp_replace(regexp_replace(trim(x.text), '[''’]s$', ''), '(?i)^(?:the|an|a)\\s+', '')) as entity from e),
    f as (select record_id, lower(entity) as k, min_by(entity, ((label <> 'RULE')::integer, i)) as entity, min_by(label, ((label <> 'RULE')::integer, i)) as label from n where length(entity) >= 2 group by 1, 2)
    select record_id, entity, label from f""")
def entity_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Entities of rules before those of a tagger, each once without regard to case."""
    e = table(spark, d, "corpus_records").select("record_id", F.posexplode("ner_tags").alias("i", "x")).select("record_id", "i", F.col("x.label").alias("label"), T.normalise_entity(F.col("x.text")).alias("entity"))
    order = F.struct((F.col("label") != "RULE").cast("int"), "i")
    return e.where(F.length("entity") >= 2).groupBy("record_id", F.lower("entity").alias("k")).agg(F.min_by("entity", order).alias("entity"), F.min_by("label", order).alias("label")).drop("k")


@query("""with e as (select record_id, array_to_string(list_transform(list_slice(ner_tags, 1, 10), lambda x: x.text || ' (' || x.label || ')'), ' | ') as entities from corpus_records where ner_tags is not null) select * from e""")
def entity_string(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_records").where(F.col("ner_tags").isNotNull())
    return rows.select("record_id", F.array_join(F.transform(F.slice("ner_tags", 1, 10), lambda x: F.concat(x["text"], F.lit(" ("), x["label"], F.lit(")"))), " | ").alias("entities"))


@query("""with t as (select suite, item_id, unnest(regexp_extract_all(lower(coalesce(passage, '')), '[a-z]{3,}')) as term from eval_items), c as (select suite, item_id, term, count(*) as c from t group by all), n as (select suite, item_id, count(*) as t from t group by all),
    m as (select suite, count(*) as n from n group by 1), df as (select suite, term, count(*) as df from c group by all),
    w as (select suite, item_id, term, c.c / n.t * (ln((m.n + 1) / (df.df + 1)) + 1) as w from c join n using (suite, item_id) join m using (suite) join df using (suite, term)), l as (select suite, item_id, sqrt(sum(w * w)) as l from w group by all),
    u as (select suite, item_id, term, w / l as u from w join l using (suite, item_id))
    select x.suite, x.item_id as a, y.item_id as b, round(sum(x.u * y.u), 6) as sim from u x join u y on x.suite = y.suite and x.term = y.term and x.item_id < y.item_id group by all""")
def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_items").select("suite", "item_id", T.tokens(F.coalesce("passage", F.lit(""))).alias("words"))
    return S.tfidf_pairs(S.tfidf(rows, by="suite", doc="item_id", tokens="words"), by="suite", doc="item_id")


@query(f"""with t as (select coalesce(industry_label, 'general') as topic, record_id, unnest(regexp_extract_all(lower(title), '[a-z]{{4,}}')) as term from corpus_records where title is not null), s as (select * from t where term not in ({', '.join(lit(w) for w in STOP_WORDS)})),
    g as (select topic, term, count(*) as tf, count(distinct record_id) as df from s group by all), n as (select coalesce(industry_label, 'general') as topic, count(distinct record_id) as docs from corpus_records where title is not null group by 1),
    k as (select topic, term, round(tf * ln(docs / df), 6) as score from g join n using (topic))
    select topic, cast(row_number() over (partition by topic order by score desc, term) as integer) as rank, term, score from k qualify rank <= 5""")
def class_tfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_records").where(F.col("title").isNotNull()).select(F.coalesce("industry_label", F.lit("general")).alias("topic"), "record_id", T.tokens(F.col("title"), 4).alias("words"))
    return TP.keywords(rows, by="topic", doc="record_id", tokens="words")


@query(f"""with k as (select record_id, lower(concat_ws(' ', title, extractive_summary)) as t from corpus_records) select record_id, {_industry_sql("coalesce(t, '')")} as industry from k""")
def industry_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_records").select("record_id", T.industry(F.concat_ws(" ", "title", "extractive_summary")).alias("industry"))


@query("""with b as (select coalesce(industry_label, 'general') as ind, coalesce(disruption_domain, 'none') as dom, upper(impact_level) as lvl, is_relevant from corpus_records)
    select case grouping_id(ind, dom, lvl) when 3 then 'industry' when 5 then 'domain' when 6 then 'impact' else 'all' end as kind, coalesce(ind, dom, lvl, '') as value, count(*) as n, round(avg(is_relevant), 4) as relevant_ratio
    from b group by grouping sets ((ind), (dom), (lvl), ())""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return CO.corpus_stats(table(spark, d, "corpus_records"))


def _text_domains_sql() -> str:
    from .q_relevance import _domains_sql

    return f"(select article_id, run_id, coalesce(({_domains_sql()})[1], 'none') as dom from (select article_id, run_id, lower(concat_ws(' ', coalesce(clean_title, ''), coalesce(clean_body, ''))) as t from preprocessed_articles))"


@query(f"""with e as (select article_id, semantic_category from article_encodings), d as {_text_domains_sql()}, a as (select p.*, coalesce(clean_body, '') as b, e.semantic_category, d.dom from preprocessed_articles p left join e using (article_id) join d on d.article_id = p.article_id and d.run_id = p.run_id)
    select article_id, run_id, coalesce(title, '') as title, coalesce(url, '') as url, coalesce(published, '') as published, coalesce(source, '') as source, coalesce(nullif(trust_score, 0), 0.5) as trust_score, {_industry_sql("lower(concat_ws(' ', coalesce(title, ''), b))")} as industry_label, dom as disruption_domain,
      round(greatest(0e0, least(1e0, relevance_score / 100.0e0)), 6) as risk_score_norm, array_to_string(list_filter(list_slice({SPLIT.format('b')}, 1, 2), lambda s: trim(s) <> ''), ' ||| ') as extractive_summary,
      array_to_string(list_transform(coalesce(matched_entities, []), lambda m: m || '/RULE'), '|') as ner_tags, case when upper(impact_level) in ('HIGH', 'MEDIUM') then 1 else 0 end as is_relevant, upper(impact_level) as impact_level, coalesce(semantic_category, '') as semantic_category,
      relevance_score::integer as breakdown, -1 as cluster_id, case when trim(b) = '' then 0 else len(regexp_split_to_array(trim(b), '\\s+')) end::integer as word_count from a""")
def corpus_records(spark: SparkSession, d: str) -> DataFrame:
    """All sixteen fields; tags and the map as text, as results are compared by value."""
    from ..operators import relevance as R

    rows = _articles(spark, d)
    # The SQL takes the domain by article and run: rows of an article that a run holds more than once meet each other's.
    domains = rows.withColumn("_text", R.article_text()).select("article_id", "run_id", R.disruption_domains("_text").alias("disruption_domains"))
    rows = rows.join(domains, ["article_id", "run_id"])
    rows = rows.withColumn("entities", F.transform("matched_entities", lambda m: F.struct(m.alias("text"), F.lit("RULE").alias("label")))).withColumn("score_breakdown", F.create_map(F.lit("total"), F.col("relevance_score").cast("int")))
    got = CO.corpus_record(rows.join(table(spark, d, "article_encodings").select("article_id", "semantic_category"), "article_id", "left"))
    return got.withColumn("ner_tags", F.array_join(F.transform("ner_tags", lambda e: F.concat_ws("/", e["text"], e["label"])), "|")).withColumn("breakdown", F.col("score_breakdown")["total"]).drop("score_breakdown")


@query()
def lexrank_summary(spark: SparkSession, d: str) -> DataFrame:
    """Two central sentences of each article."""
    rows = _articles(spark, d).where(F.col("clean_body").isNotNull()).dropDuplicates(["article_id"]).select("article_id", T.usable_sentences(F.col("clean_body")).alias("sentences"))
    return S.lexrank_documents(rows, key="article_id", sentences="sentences", n=2)


@query()
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    """Four central sentences of each cluster, from the summaries of its records."""
    rows = table(spark, d, "corpus_records").where((F.col("cluster_id") >= 0) & (F.col("extractive_summary") != "")).select("cluster_id", "record_id", F.posexplode(F.split("extractive_summary", r" \|\|\| ")).alias("i", "sentence"))
    rows = rows.select("cluster_id", (F.col("record_id") * (1 << 20) + F.col("i")).alias("pos"), "sentence")
    return S.lexrank(rows, by="cluster_id", pos="pos", text="sentence", n=4)


@query("""with r as (select * from corpus_records where cluster_id >= 0), s as (select cluster_id, record_id, unnest(string_split(extractive_summary, ' ||| ')) as s, generate_subscripts(string_split(extractive_summary, ' ||| '), 1) as i from r),
    k as (select cluster_id, s, row_number() over (partition by cluster_id order by record_id, i) as n from s where trim(s) <> ''), w as (select cluster_id, string_agg(s, ' ' order by n) as what_happened from k where n <= 3 group by 1),
    t as (select distinct cluster_id, x.text as n from (select cluster_id, unnest(ner_tags) as x from r)), a as (select cluster_id, string_agg(n, ', ' order by n) as affected from t group by 1), h as (select cluster_id, min_by(title, record_id) as headline from r group by 1)
    select cluster_id, headline, coalesce(what_happened, '') as what_happened, coalesce(affected, '') as affected from h left join w using (cluster_id) left join a using (cluster_id)""")
def fallback_briefs(spark: SparkSession, d: str) -> DataFrame:
    nodes = F.coalesce(F.transform("ner_tags", lambda t: F.concat(t["label"], F.lit(":"), t["text"])), F.array().cast("array<string>"))
    rows = table(spark, d, "corpus_records").where(F.col("cluster_id") >= 0).select("cluster_id", F.col("record_id").alias("pos"), "title", F.split("extractive_summary", r" \|\|\| ").alias("sentences"), nodes.alias("nodes"))
    return S.briefs(rows)
