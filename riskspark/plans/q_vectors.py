"""Similarity, near-duplicates, event clusters, topics and search over the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import summaries as S
from ..operators import topics as TP
from ..operators import vectors as V
from ..session import table
from .base import query

PAIRS = "p as (select x.vec_id as a, y.vec_id as b, list_inner_product(x.embedding::double[], y.embedding::double[]) as sim from embeddings x join embeddings y on x.vec_id < y.vec_id where list_inner_product(x.embedding::double[], y.embedding::double[]) >= {0})"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query(f"with {PAIRS.format(0.35)} select a, b, round(sim, 6) as sim from p")
def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.similarity_pairs(_vectors(spark, d), 0.35).select("a", "b", F.round("sim", 6).alias("sim"))


PRIORITY = "(vec_id * 7919) % 1009"


@query(f"""with recursive {PAIRS.format(0.35)}, r as (select vec_id, row_number() over (order by {PRIORITY} desc, vec_id) as pos from embeddings),
    e as (select greatest(x.pos, y.pos) as p, least(x.pos, y.pos) as q from p join r x on x.vec_id = p.a join r y on y.vec_id = p.b), nb as (select p, list(q) as qs from e group by p),
    walk as (select 0::bigint as pos, []::bigint[] as kept union all select w.pos + 1, case when list_has_any(w.kept, coalesce(nb.qs, []::bigint[])) then w.kept else list_append(w.kept, w.pos + 1) end from walk w left join nb on nb.p = w.pos + 1 where w.pos < (select count(*) from r)),
    k as (select unnest(kept) as pos from walk where pos = (select count(*) from r)),
    ab as (select e.p, min(e.q) as q from e join k on k.pos = e.q where e.p not in (select pos from k) group by e.p)
    select r.vec_id, ab.q is null as kept, coalesce(o.vec_id, -1) as absorbed_by, (select count(*) from ab z where z.q = r.pos) as absorbed from r left join ab on ab.p = r.pos left join r o on o.pos = ab.q""")
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return V.greedy_dedup(rows.select("vec_id", F.expr(PRIORITY).alias("priority")), V.similarity_pairs(rows, 0.35)).withColumn("absorbed_by", F.coalesce("absorbed_by", F.lit(-1)).cast("bigint"))


@query(f"""with recursive {PAIRS.format(0.36)}, e as (select a, b from p union all select b, a from p), reach as (select a as id, a as r from e union select reach.id, e.b from reach join e on e.a = reach.r), l as (select id, min(r) as label from reach group by id),
    s as (select label, count(*) as cluster_size, row_number() over (order by label) - 1 as cluster_id from l group by label), nz as (select vec_id, (select count(*) from s) + row_number() over (order by vec_id) - 1 as cluster_id from embeddings where vec_id not in (select id from l))
    select l.id as vec_id, s.cluster_id, false as is_noise, s.cluster_size from l join s using (label) union all select vec_id, cluster_id, true, 1 from nz""")
def event_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return G.density_clusters(rows, V.similarity_pairs(rows, 0.36)).select("vec_id", "cluster_id", "is_noise", "cluster_size")


CENTROIDS = "c4 as (select label, embedding from embeddings where label < 6 qualify row_number() over (partition by label order by vec_id) <= 4), cl as (select label, i, avg(x) as m from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from c4) group by 1, 2), cc as (select label, list(m order by i) as c from cl group by label)"


@query(f"with {CENTROIDS}, s as (select vec_id, label as l, round(list_inner_product(embedding::double[], c), 4) + 0e0 as score from (select vec_id, embedding from embeddings), cc) select vec_id, cast(row_number() over (partition by vec_id order by score desc, l) as integer) as rank, 'archetype_' || l as category, score from s qualify rank <= 2")
def archetype_top2(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    first = V.rank_rows(rows.where(F.col("label") < 6), ["label"], [F.col("vec_id")], 4)
    centroids = V.mean_vectors(first, ["label"]).select(F.concat(F.lit("archetype_"), F.col("label")).alias("category"), F.col("label").alias("pos"), "centroid")
    return V.archetypes(rows, centroids)


@query("""with s as (select vec_id // 9 as doc, vec_id % 9 as pos, embedding::double[] as v from embeddings), m as (select doc, pos // 3 as para, i, avg(x) as m from (select doc, pos, unnest(v) as x, generate_subscripts(v, 1) as i from s) group by 1, 2, 3),
    q as (select doc, para, list(m order by i) as c from m group by 1, 2), u as (select doc, para, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) as c from q), k as (select u.doc, para, round(list_inner_product(s.v, u.c), 6) + 0e0 as score from u join s on s.doc = u.doc and s.pos = 0)
    select doc, cast(min_by(para, (-score, para)) as integer) as core, max(score) as score from k group by doc""")
def paragraph_core(spark: SparkSession, d: str) -> DataFrame:
    s = _vectors(spark, d).select(F.expr("vec_id div 9").alias("doc"), (F.col("vec_id") % 9).alias("pos"), "embedding")
    pooled = V.paragraphs(s, doc="doc", pos="pos", vector="embedding")
    return V.core_paragraph(s.where(F.col("pos") == 0), pooled, doc="doc", vector="embedding")


@query("with q as (select embedding as v from embeddings order by vec_id limit 1) select vec_id, round(list_inner_product(embedding::double[], q.v::double[]), 4) + 0e0 as score from embeddings, q order by score desc, vec_id limit 10")
def semantic_search_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    q = rows.orderBy("vec_id").select("embedding").first()
    return V.search(rows, list(q[0]) if q else [], 10)


ROUNDS, TOPICS = 30, 8
UNIT = "u as materialized (select vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as v from embeddings)"


def _kmeans_sql() -> str:
    parts = [UNIT, f"c0 as materialized (select cast(row_number() over (order by vec_id) - 1 as integer) as topic_id, v as c from u order by vec_id limit {TOPICS})"]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} as materialized (select vec_id, arg_min(topic_id, (-round(list_inner_product(v, c), 9), topic_id)) as topic_id from u cross join c{r} group by vec_id)")
        if r < ROUNDS:
            parts.append(f"m{r} as (select topic_id, i, avg(x) as x from (select topic_id, unnest(v) as x, generate_subscripts(v, 1) as i from a{r} join u using (vec_id)) group by 1, 2)")
            parts.append(f"l{r} as (select topic_id, list(x order by i) as c from m{r} group by 1)")
            parts.append(f"c{r + 1} as materialized (select o.topic_id, coalesce(list_transform(l.c, lambda x: x / sqrt(list_inner_product(l.c, l.c))), o.c) as c from c{r} o left join l{r} l using (topic_id))")
    return f"with {', '.join(parts)} select vec_id, topic_id from a{ROUNDS}"


@query(_kmeans_sql())
def topic_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Eight topics by at most 30 rounds, ended when no row moves; the SQL goes on, as nothing changes then."""
    return TP.spherical_kmeans(_vectors(spark, d), TOPICS, rounds=ROUNDS)


def _mmr_sql(n: int = 6, balance: float = 0.55) -> str:
    parts = [
        UNIT, "m as (select label, i, avg(x) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from u) group by 1, 2)", "ce as (select label, list(x order by i) as c from m group by 1)",
        "s0 as materialized (select vec_id, label, v, list_inner_product(v, c) / sqrt(list_inner_product(c, c)) as gain, null::double as near, false as taken from u join ce using (label))",
    ]
    for r in range(n):
        parts.append(f"p{r} as materialized (select label, {r + 1} as rank, arg_min(vec_id, (-round({balance} * gain - {1 - balance} * coalesce(near, 0), 9), vec_id)) as vec_id from s{r} where not taken group by label)")
        parts.append(f"s{r + 1} as materialized (select s.vec_id, s.label, s.v, s.gain, greatest(list_inner_product(s.v, b.v), s.near) as near, s.taken or s.vec_id = p.vec_id as taken from s{r} s left join p{r} p using (label) left join u b on b.vec_id = p.vec_id)")
    return f"with {', '.join(parts)} " + " union all ".join(f"select label, rank, vec_id as pos from p{r}" for r in range(n))


@query(_mmr_sql())
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    """Six rows of each label that are near its centre and far from one another."""
    return S.mmr(_vectors(spark, d), by="label", pos="vec_id", vector="embedding")


@query()
def hash_encoding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preprocessed_articles").dropDuplicates(["article_id"])
    return V.hash_encode(rows, key="article_id", text="clean_body")
