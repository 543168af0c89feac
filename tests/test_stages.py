"""Hooks, fetch stages, and large groups against small ones."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import graph as G
from riskspark.operators import resolve as V
from riskspark.operators import stages as ST
from riskspark.operators import summaries as S
from riskspark.operators import topics as TP
from riskspark.operators import vectors as X
from riskspark.plans import sample_dims as D
from riskspark.session import materialize
from riskspark.sources import fetch as FE

PROFILE = "client_id string, tier1_suppliers array<struct<name:string,material:string,location:string,country:string,city:string>>, raw_materials array<struct<commodity:string,region:string>>, logistics_nodes array<struct<name:string,type:string,carrier:string>>, own_facilities array<struct<name:string,location:string>>"


def test_mmr_of_large_groups_is_the_same(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(i % 3), i, [float(v) for v in rng.standard_normal(8)]) for i in range(90)], "g int, pos long, v array<float>")
    want = {tuple(r) for r in S.mmr(rows, by="g", pos="pos", vector="v").collect()}
    assert {tuple(r) for r in S.mmr(rows, by="g", pos="pos", vector="v", most=10).collect()} == want and len(want) == 18


@pytest.mark.parametrize("threshold", [0.3, 0.75, 0.95])
def test_pairs_meet_around_pivots(spark, threshold):
    """All pairs and no more, whatever the pivots; copies fill one cell."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 6))
    x = centres[rng.integers(0, 12, 400)] + 0.25 * rng.standard_normal((400, 6))
    x[300:] = x[5]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    s = x.astype(float) @ x.astype(float).T
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] >= threshold - 1e-12}
    for pivots in (1, 16):
        got = X.similarity_pairs(rows, threshold, pivots=pivots, block_rows=60).select("a", "b").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pairs_without_clusters_are_not_copied_into_all_cells(spark, monkeypatch):
    """Where cells overlap all rows meet in packed blocks: what is written stays below the rows there are, and the pairs are all there."""
    x = np.random.default_rng(4).standard_normal((900, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    written = []
    monkeypatch.setattr(X, "materialize", lambda df, name, path=None: written.append(materialize(df, name, path)) or written[-1])
    got = X.similarity_pairs(rows, 0.75, pivots=30, block_rows=50).collect()
    s = x.astype(float) @ x.astype(float).T
    assert {(r.a, r.b) for r in got} == {(i, j) for i, j in zip(*np.nonzero(s >= 0.75 - 1e-12)) if i < j} and len(got) == len({(r.a, r.b) for r in got})
    assert np.allclose([r.sim for r in got], [s[r.a, r.b] for r in got]) and sum(w.count() for w in written) < 900


def test_clusters_make_the_pairs_once(spark):
    """Pairs that are costly to make are made once, however often the clusters read them."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for part in batches:
            made.add(len(part))
            yield part

    pairs = spark.createDataFrame([(0, 1), (1, 2), (5, 6)], "a long, b long").mapInPandas(count, "a long, b long")
    got = {r.vec_id: r.cluster_id for r in G.density_clusters(spark.range(8).withColumnRenamed("id", "vec_id"), pairs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 5: 1, 6: 1, 3: 2, 4: 3, 7: 4} and made.value == 3


def test_centrality_of_many_sentences_in_little_memory():
    """As by whole matrices, of which only one of all pairs is held."""
    rng = np.random.default_rng(5)
    words = [a + b + c for a in "bdfgl" for b in "aeiou" for c in "mnrst"]
    texts = [" ".join(["the port", *rng.choice(words, 12)]) if i % 97 else "1 2" for i in range(1500)]
    want = S.lexrank_scores(S._weights(texts).astype(np.float32))
    tracemalloc.start()
    got = S._many_scores(S._many_cosines(texts))
    assert np.abs(got - want).max() < 1e-9 and tracemalloc.get_traced_memory()[1] < 24 * 1500**2
    tracemalloc.stop()


def test_long_chain_of_near_duplicates(spark):
    """A chain that a few rounds leave undecided is decided or raises, and never comes out as kept."""
    items = spark.createDataFrame([(i, 10 - i) for i in range(9)], "vec_id long, priority int")
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(8)], "a long, b long, sim double")
    assert sorted(r.vec_id for r in X.greedy_dedup(items, pairs).where("kept").collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(RuntimeError):
        X.greedy_dedup(items, pairs, rounds=2)


def test_kmeans_ends_when_no_row_moves(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1]), (3, [0.1, 0.9]), (4, None), (5, [])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in TP.spherical_kmeans(rows, 2).collect()} == {(0, 0), (2, 0), (1, 1), (3, 1)}
    assert TP.spherical_kmeans(rows.limit(0), 2).count() == 0


def test_tagger_that_fails_spoils_its_row_alone(spark):
    def ner(rows):
        if rows["text"].str.contains("bad").any():
            raise ValueError("bad text")
        return rows["text"].map(lambda t: [{"text": "Oslo", "label": "GPE"}, {"text": "oslo", "label": "GPE"}, {"text": "5", "label": "CARDINAL"}])

    rows = spark.createDataFrame([(1, "all good", "x"), (2, "bad", "y"), (3, None, None)], "article_id long, title string, summary string").coalesce(1)
    got = {r.article_id: r for r in ST.preprocess(rows, ner=ner).collect()}
    assert [e.text for e in got[1].ner_entities] == ["Oslo"] and got[1].entity_string == "Oslo (GPE)" and got[1].preprocessing_ok
    assert got[2].ner_entities == [] and not got[2].preprocessing_ok and got[2].clean_title == "bad"
    assert got[3].clean_title == "" and ST.preprocess(rows.limit(0), ner=ner).count() == 0


def test_encoder_hook(spark):
    rows = spark.createDataFrame([(1, "One title", "A sentence that is long enough to be kept as it stands. Another sentence that is long enough to be kept too."), (2, "", "")], "article_id long, title string, summary string")
    made = ST.preprocess(rows.withColumns({"source": F.lit("s"), "impact_level": F.lit("LOW"), "relevance_score": F.lit(1)}))
    centroids = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0])], "category string, pos int, centroid array<double>")
    got = ST.encode(ST.encoder_payload(made), centroids, encoder=lambda p: [[0.0, 1.0]] * len(p)).collect()
    assert [(r.article_id, r.semantic_category, r.semantic_score, r.sbert_encoded) for r in got] == [(1, "b", 1.0, True)]


def test_brief_hook_and_fallback(spark):
    rows = spark.createDataFrame(
        [(1, False, 3, "H1", "sum", ["port:P", "x"], ["a.", "b."]), (2, False, 3, "H2", "sum", [], ["c."]), (3, True, 1, "H3", "sum", None, ["d."]), (4, False, 2, "H4", None, None, None)],
        "cluster_id long, is_noise boolean, article_count long, headline string, summary string, linked_nodes array<string>, mmr_sentences array<string>",
    )
    reply = lambda p: ['```{"headline": "New", "affected_nodes": ["P"]}```' if p["headline"].iloc[0] == "H1" else "no json"]
    got = {r.cluster_id: r.brief for r in ST.attach_briefs(rows, brief_fn=reply).collect()}
    assert (got[1].headline, got[1].source, got[1].mmr_sentence_count) == ("New", "llm", 2)
    assert (got[2].headline, got[2].what_happened, got[2].source) == ("H2", "c.", "fallback")
    assert (got[3].what_happened, got[3].mmr_sentence_count, got[4].what_happened) == ("sum", 0, "")
    assert ST.attach_briefs(rows).where("cluster_id = 1").first().brief.affected_nodes == ["P", "x"]


def test_topics_gate(spark):
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "article_id long, doc_embedding array<double>")
    assert ST.model_topics(few) is None
    members = spark.createDataFrame([(7, 1, 0)], "cluster_id int, article_id long, pos int")
    assert [tuple(r) for r in ST.attach_topics(members, None, None).collect()] == [(7, -1, "Uncategorised")]


def test_names_that_do_not_resolve(spark):
    """Other spellings stay unresolved; a port by alias; a node that is both goes to the port; an unknown country is left out."""
    who = spark.createDataFrame([("c", [("S", "m", "", "JAPAN ", "Raldaleno"), ("T", "m", "", "Western Australia", "X")], [("Copper Concentrate", ""), ("rare earths", "")], [("nornalwick", "port", None), ("Nornalwic", "port", None), ("CORULNESS", "route", None), (None, None, None)], None), ("empty", None, None, None, None)], PROFILE)
    dims = D.tables(spark)
    assert [r.country for r in V.exposure_countries(who, dims).orderBy("pos").collect()] == ["Japan", "Chile", "Germany"]
    assert [(r.name, r.port, r.route) for r in V.bind_nodes(who, dims).orderBy("pos").collect()] == [("nornalwick", "Port of Nornalwick", None), ("Nornalwic", None, None), ("CORULNESS", None, "Corulness")]
    assert [(r.commodity, r.material) for r in V.bind_materials(who, dims).orderBy("pos").collect()] == [("copper concentrate", "copper"), ("rare earths", None)]
    prongs = [r.prong for r in V.generate_queries(who, dims).orderBy("pos").collect()]
    assert prongs == sorted(prongs, key=["entity", "city", "port city", "commodity", "unknown material", "origin", "route"].index) or {"unknown material", "route", "port city"} <= set(prongs)
    articles = spark.createDataFrame([(1, "Refined copper from Nornalwick at a loss", None, 0.8, "own"), (2, None, None, None, None)], "article_id long, clean_title string, clean_body string, trust_score double, linked_nodes string")
    got = {(r.article_id, r.client_id): r for r in V.score_for_clients(articles, who, dims, keys=["article_id"]).collect()}
    assert len(got) == 4 and got[1, "c"].linked_nodes == ["material:copper", "port:Port of Nornalwick"] and got[1, "c"].entity == 6 + 5 + 3 and got[1, "empty"].entity == 0
    assert V.score_for_clients(articles.limit(0), who, dims, keys=["article_id"]).count() == 0 and V.generate_queries(who.limit(0), dims).count() == 0


def test_fetch_from_files(spark, tmp_path):
    feed = tmp_path / "f.xml"
    feed.write_text("<rss><channel>" + "".join(f"<item><title>T{i}</title><link>https://a.example/{i}</link><pubDate>Tue, 03 Jun 2025 08:0{i % 10}:00 +0200</pubDate></item>" for i in range(20)) + "</channel></rss>")
    plan = spark.createDataFrame([("https://feed.example/x", "A Wire", 0.7, "local"), ("https://feed.example/none", "B", 0.5, "local")], "url string, source string, trust_score double, category string")
    got = FE.fetch(spark, plan, "2025-06-04T00:00:00Z", locate=lambda u: str(feed) if u.endswith("/x") else str(tmp_path / "missing"))
    rows = got.collect()
    assert len(rows) == 15 and {r.source for r in rows} == {"A Wire"} and min(r.published for r in rows) == "2025-06-03T06:00:00Z"
    assert FE.recent(got, "2025-06-04 00:00:00").count() == 15 and FE.recent(got, "2025-06-14 00:00:00").count() == 0


def test_no_names_at_all(spark):
    hits = V.name_hits(spark.createDataFrame([(1, "a", "b")], "article_id long, clean_title string, clean_body string"), spark.createDataFrame([], "client_id string, node_type string, node string, pos int, names array<string>"), spark.createDataFrame([], "client_id string, kind string, name string"), keys=["article_id"])
    assert hits.count() == 0


def test_scores_do_not_hold_the_plan_of_the_exposure(spark, data):
    """The exposure is resolved once, not within the plan over the articles, which a driver must hold."""
    articles, profiles = spark.read.parquet(f"{data}/preprocessed_articles.parquet"), spark.read.parquet(f"{data}/client_profiles.parquet")
    scored = V.score_for_clients(articles.dropDuplicates(["article_id"]), profiles, D.tables(spark), keys=["article_id"])
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3


def test_portfolio_without_summaries_and_topics(spark, data, monkeypatch):
    """The portfolio rests on scores of events alone; summaries, topics and vectors of sentences are made when they are asked for, to the same scores."""
    from riskspark.operators.analyze import analyze
    from riskspark.plans import q_stages

    articles = spark.read.parquet(f"{data}/preprocessed_articles.parquet").select("article_id", "title", F.col("clean_body").alias("summary"), "url", F.col("fetched_at").cast("timestamp").alias("published_ts"), "source", "country", "trust_score")

    def unasked(*args, **options):
        raise AssertionError("not needed for the portfolio")

    with monkeypatch.context() as m:
        for where, name in ((S, "lexrank"), (S, "lexrank_documents"), (TP, "spherical_kmeans"), (ST, "with_core")):
            m.setattr(where, name, unasked)
        got = analyze(articles, spark.read.parquet(f"{data}/client_profiles.parquet"), D.tables(spark), q_stages._centroids(spark), "2025-06-01 00:00:00", dim=64, alike=0.4)
        portfolio = {r.client_id: r for r in got.portfolio.collect()}
        assert len(portfolio) == 8 and any(r.clusters > 0 for r in portfolio.values())
    events = [r for r in got.clusters.collect() if not r.is_noise]
    weight = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
    for client, r in portfolio.items():
        own = [(weight[e.severity], e.composite) for e in events if e.client_id == client]
        assert len(own) == r.clusters and abs(sum(w * c for w, c in own) / max(1, sum(w for w, _ in own)) - r.overall_score) <= 0.051
    assert got.articles.count() == got.clusters.agg(F.sum("article_count")).first()[0] and got.topics.count() >= 1 and got.encoded.where("core_paragraph_idx is not null").count() == got.encoded.count()
