import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions import text as T
from riskspark.operators import filters as FL
from riskspark.operators import graph as G
from riskspark.operators import legacy_risk as L
from riskspark.operators import relevance as R
from riskspark.operators import risk as K
from riskspark.operators import summaries as S
from riskspark.operators import topics as TP
from riskspark.operators import vectors as V
from riskspark.sources import dims, feeds, runs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("t,want", [(0.65, 6), (0.75, 8), (0.85, 8), (0.95, 10), (None, 5)])
def test_trust_half_even(spark, t, want):
    assert one(spark, R.trust_points(F.lit(t).cast("double"))) == want


def test_density_and_impact(spark):
    words = ["port", "cargo", "vendor", "wafer", "lng"]
    assert [one(spark, R.keyword_density(F.lit(" ".join(words[:n])))) for n in range(6)] == [0, 6, 11, 16, 16, 20]
    cases = [(55, 7, 6), (54, 7, 6), (30, 7, 6), (29, 7, 6), (90, 0, 20)]
    assert [one(spark, R.impact_level(*map(F.lit, c))) for c in cases] == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_risk_tables(spark):
    assert [one(spark, K.corroboration(F.lit(n))) for n in range(7)] == [0, 10, 30, 50, 70, 90, 100]
    assert [one(spark, K.severity(F.lit(x))) for x in (75.0, 55.0, 35.0, 34.9)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    assert round(one(spark, K.cluster_size(F.lit(1))), 2) == 19.82 and one(spark, K.cluster_size(F.lit(32))) == 100
    assert [one(spark, L.velocity(F.lit(n))) for n in (1, 2, 3, 6, 11, 20)] == [1, 2, 4, 6.5, 8, 9.5]
    assert [one(spark, L.level(F.lit(x))) for x in (8.0, 6.0, 3.5, 3.4)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def test_plurality_prefers_topics(spark):
    votes = spark.createDataFrame([(1, -1, 0), (1, -1, 1), (1, -1, 2), (1, 2, 3), (2, -1, 0), (3, 5, 1), (3, 4, 0)], "cluster_id int, topic_id int, pos int")
    assert sorted(map(tuple, K.plurality(votes).collect())) == [(1, 2), (2, -1), (3, 4)]


def test_empty_tables(spark, data):
    articles = spark.read.parquet(f"{data}/preprocessed_articles.parquet").limit(0)
    assert R.score_articles(articles).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.similarity_pairs(empty, 0.5).count() == 0
    assert TP.spherical_kmeans(empty, 3).count() == 0
    assert G.density_clusters(empty, V.similarity_pairs(empty, 0.5)).count() == 0


def brute_pairs(x, t):
    s = x @ x.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= t}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 8))
    x[30:60] = x[:30] + 0.2 * rng.standard_normal((30, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [])], "vec_id long, embedding array<double>")


def test_similarity_pairs_in_blocks(spark, cloud):
    x, frame = cloud
    x = x.astype(np.float32).astype(np.float64)
    got = V.similarity_pairs(frame, 0.8, block_rows=40)
    assert {(r.a, r.b) for r in got.collect()} == brute_pairs(x, 0.8)


def test_greedy_dedup_is_the_sequential_pass(spark, cloud):
    x, frame = cloud
    pairs = brute_pairs(x, 0.7)
    near = {i: {j for p in pairs if i in p for j in p if j != i} for i in range(len(x))}
    priority = {i: (i * 7) % 13 for i in range(len(x))}
    kept, owner = [], {}
    for i in sorted(priority, key=lambda i: (-priority[i], i)):
        if i not in owner:
            kept.append(i)
            for j in near[i]:
                if j not in owner and j not in kept:
                    owner[j] = i
    items = spark.createDataFrame([(i, p) for i, p in priority.items()], "vec_id long, priority int")
    got = {r.vec_id: (r.kept, r.absorbed_by) for r in V.greedy_dedup(items, spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert got == {i: (i in kept, owner.get(i)) for i in priority}


def dbscan(n, near, least):
    core = {i for i in range(n) if len(near[i]) + 1 >= least}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label.setdefault(j, i) == i and j in core:
                todo += [k for k in near[j] & core if k not in label]
    for i in range(n):
        if i not in core and near[i] & core:
            label[i] = min(label[k] for k in near[i] & core)
    return label


@pytest.mark.parametrize("least", [2, 3])
def test_density_clusters(spark, cloud, least):
    x, frame = cloud
    pairs = brute_pairs(x, 0.7)
    near = {i: {j for p in pairs if i in p for j in p if j != i} for i in range(len(x))}
    want = dbscan(len(x), near, least)
    got = G.density_clusters(frame.where("vec_id < 900"), spark.createDataFrame(sorted(pairs), "a long, b long"), min_samples=least).collect()
    groups = lambda pairs: sorted(sorted(i for i, c in pairs if c == g) for g in {c for _, c in pairs})
    assert groups([(r.vec_id, r.cluster_id) for r in got if not r.is_noise]) == groups(list(want.items()))
    assert sorted(r.cluster_id for r in got if r.is_noise) == list(range(len(set(want.values())), len(set(want.values())) + len(x) - len(want)))


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.label for r in G.min_labels(links).collect()} == {0}


def test_kmeans_and_mmr(spark, cloud):
    x, frame = cloud
    got = TP.spherical_kmeans(frame, 4, rounds=3)
    assert got.count() == 90 and got.select("topic_id").distinct().count() <= 4
    picks = S.mmr(frame.withColumn("g", F.lit(1)), by="g", pos="vec_id", vector="embedding", n=3).orderBy("rank").collect()
    centre = x.mean(axis=0)
    assert picks[0]["pos"] == int((x @ centre).argmax()) and len({r["pos"] for r in picks}) == 3


def test_lexrank_keeps_text_order(spark):
    rows = [(1, i, t) for i, t in enumerate(["alpha beta gamma", "alpha beta delta", "zeta eta theta", "alpha beta epsilon"])] + [(2, 0, "alone")]
    got = {r.d: r.summary for r in S.lexrank(spark.createDataFrame(rows, "d int, p int, t string"), by="d", pos="p", text="t", n=2).collect()}
    assert got[2] == "alone" and "zeta" not in got[1] and got[1].count("  ") == 1


def test_large_groups_in_heats(spark):
    rows = spark.range(900).select(F.lit(1).alias("d"), F.col("id").alias("p"), F.concat(F.lit("common words here "), F.col("id") % 7).alias("t"))
    got = S.lexrank(rows, by="d", pos="p", text="t", n=3, most=50).collect()
    assert len(got) == 1 and got[0].summary.count("common") == 3
    vectors = rows.select("d", "p", F.array(F.sin("p"), F.cos("p")).alias("v"))
    assert S.mmr(vectors, by="d", pos="p", vector="v", n=4, most=60).count() == 4


def test_text_functions(spark):
    t = lambda c: one(spark, c)
    assert t(T.clean_text(F.lit("A&nbsp;“b”\n\n\n\nc  d <i>e</i> Read more: all that follows"))) == 'A "b"\n\nc d e'
    assert t(T.clean_sentence(F.lit("word " * 100))).endswith("…")
    assert t(T.normalise_entity(F.lit("The Port's"))) == "Port"
    assert t(T.word_count(F.lit("  "))) == 0 and t(T.word_count(F.lit("a b\nc"))) == 3
    assert t(T.parse_reply(F.lit('```json\n{"headline": "x"}\n```'), "headline string"))["headline"] == "x"
    assert t(T.parse_reply(F.lit("no object"), "headline string")) is None
    assert t(T.outlet_trust(F.lit("Reuters UK"))) == 0.9


def test_filters(spark):
    rows = spark.createDataFrame([("HIGH", "x", 0.9), ("low", None, 0.1), (None, "y", None)], "impact_level string, country string, trust_score double")
    assert FL.apply_filters(rows, FL.Filters()).count() == 3
    assert FL.apply_filters(rows, FL.Filters(levels=["high", "LOW"])).count() == 2
    assert FL.apply_filters(rows, FL.Filters(levels=["HIGH"], countries=["X"], least_trust=0.85)).count() == 1
    assert FL.apply_filters(rows, FL.Filters(domains=["conflict"])).count() == 0


def test_feeds_and_runs(spark, tmp_path, data):
    (tmp_path / "a.xml").write_text("<rss><channel>" + "".join(f"<item><title>T{i}</title><link>http://h/{i % 3}</link><description>&lt;p&gt;d  x&lt;/p&gt;</description></item>" for i in range(20)) + "</channel></rss>")
    (tmp_path / "bad.xml").write_text("<rss><oops")
    (tmp_path / "n.json").write_text('{"articles": [{"title": "N", "url": "http://n/1", "source": {"id": "i", "name": null}}, {"title": "[Removed]", "url": "https://removed.com"}]}')
    raw = feeds.read_feeds(spark, [str(tmp_path / "a.xml"), str(tmp_path / "bad.xml"), str(tmp_path / "none.xml")])
    assert raw.count() == 15
    clean = feeds.normalise_entries(raw)
    assert clean.first()["summary"] == "d x" and feeds.dedup_addresses(clean, order=["feed", "pos"]).count() == 3
    news = feeds.normalise_entries(feeds.read_feeds(spark, [str(tmp_path / "n.json")], kind="newsapi")).collect()
    assert [(r.title, r.source) for r in news] == [("N", "i")]
    articles = spark.read.parquet(f"{data}/preprocessed_articles.parquet").drop("fetched_at")
    runs.save_run(articles, str(tmp_path / "runs"))
    run = articles.first()["run_id"]
    assert runs.load_run(spark, str(tmp_path / "runs"), run).count() == articles.where(F.col("run_id") == run).count()


def test_dims(spark, tmp_path):
    (tmp_path / "ports.json").write_text('{"ports": {"Port A": {"city": "A", "country": "X", "aliases": ["Alpha"]}, "Port B": {"city": "B", "country": "Y", "aliases": ["alpha"]}}}')
    from riskspark.operators.exposure import resolve_names

    names = spark.createDataFrame([("ALPHA ",), ("port b",), ("c",), (None,)], "name string")
    got = {r.name: r.resolved for r in resolve_names(names, dims.ports(spark, str(tmp_path)), name="name", key="port", aliases="aliases").collect()}
    assert got == {"ALPHA ": "Port A", "port b": "Port B", "c": None, None: None}
