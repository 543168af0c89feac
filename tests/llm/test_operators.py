"""Training-data operators against brute force, planted cases and edge cases."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import headlines, history, leakage, lines, neighbours, packing, spam, subjects, truncation

ARTICLE = "article_id long, run_id string, source string, clean_title string, clean_body string, fetched_at timestamp_ntz, line string, n int, site string, lines string, key int"


def read(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


@pytest.fixture(scope="module")
def odd_articles(spark):
    """Nulls, empties, a very long text, ties, repeated rows, clashing columns."""
    row = lambda i, s, t, b: (i, "r", s, t, b, None, "x", 1, "y", "z", 2)
    body = "The smelter of A stopped. Ore grades slid.\nAdvertisement"
    rows = [row(1, "s", "T", body), row(1, "s", "T", body), row(2, "s", None, "ADVERTISEMENT !\nA copper mine closed and"), row(3, "s", "T", "Own text ends here.\nadver​tisement 5"), row(4, None, "T", "Advertisement!"), row(5, "s", "T", None), row(6, "s", "T", ""), row(7, "s", "T", "  \n "), row(8, "s", "T", "word " * 60_000 + "\n" * 2_000 + "x" * 300_000)]
    return spark.createDataFrame(rows, ARTICLE)


def test_repeated_lines_edges(spark, odd_articles):
    got = {tuple(r) for r in lines.repeated_lines(odd_articles).collect()}
    assert got == {(1, 2), (2, 1), (3, 2)}
    assert lines.repeated_lines(odd_articles.limit(0)).count() == 0


def test_repeated_lines_brute_force(spark, data):
    """The same lines by sets in Python, and the same by any partition of the arrivals."""
    articles = read(spark, data, "preprocessed_articles")
    keyed = lines.article_lines(articles).where("source is not null").select("article_id", "line_no", "line_key").distinct().collect()
    by = defaultdict(set)
    for r in keyed:
        by[r.line_key].add(r.article_id)
    want = {(r.article_id, r.line_no) for r in keyed if len(by[r.line_key]) >= 3}
    for steps in ((), (0.5,), (0.2, 0.4, 0.9)):
        got = lines.repeated_lines(articles, steps=steps).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_line_counts_are_kept_and_opened_again(spark, data, tmp_path):
    """Two objects on one path, one partition each, give what one pass gives; a broken step leaves nothing."""
    articles = read(spark, data, "preprocessed_articles")
    half = F.pmod(F.xxhash64("article_id"), F.lit(2)) == 0
    at = f"file://{tmp_path}/lines"
    lines.LineCounts(spark, at).merge(articles.where(half))
    broken = lines.LineCounts(spark, at)
    broken.store.begin()
    broken.store.write(spark.createDataFrame([(1, 1)], "line_key long, n long"), "counts")
    again = lines.LineCounts(spark, at)
    assert again.store.steps == 1
    again.merge(articles)  # the first half comes again and is passed over
    got = [tuple(r) for r in lines.LineCounts(spark, at).found().collect()]
    want = {tuple(r) for r in lines.repeated_lines(articles, steps=()).collect()}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Published 13 November 2023 23:12 - 20 min read", "published 4 May 2024 01:02 – 3 MIN READ", True), ("Share: https://a.example/s/1", "share https://b.example/x?y=2", True), ("Updated on May 3, 2024", "Updated on 4 July 2025", True),
        ("© 2023 A. All rights reserved.", "© 2024 A. All  rights​ reserved", True), ("You are reading: Big news today here", "YOU ARE READING", True), ("By Ann Lee, editor", "By Bob Lee, editor", False),
    ],
)
def test_line_identity(spark, a, b, same):
    rows = spark.createDataFrame([(1, "s", "Big news today here", a), (2, "s", "Other", b)], "article_id long, source string, clean_title string, clean_body string")
    assert (lines.article_lines(rows).select("line_key").distinct().count() == 1) == same


def test_truncation_edges(spark, odd_articles):
    assert {r.article_id for r in truncation.truncated(odd_articles).collect()} == {2, 8}
    assert truncation.truncated(odd_articles.limit(0)).count() == 0
    assert truncation.truncation_by_source(odd_articles).where("source = 's'").first()["cut"] == 2


def test_censoring_finds_the_limit():
    rng = np.random.default_rng(1)
    full = np.exp(rng.normal(6, 0.6, 4000)).astype(int)
    seen = np.minimum(full, 500)
    x, n = np.unique(seen, return_counts=True)
    post = censored = truncation.censoring(x, n)
    assert post[x == 500][0] > 0.95 and (censored > 0).sum() == 1
    x, n = np.unique(full, return_counts=True)
    assert truncation.censoring(x, n).sum() == 0


def test_endings():
    for text, how in [("It ends.", "stop"), ('He said "no."', "stop"), ("It en", "open"), ("It goes on...", "dots"), ("Photo: A B / C", "note"), ("(with material from A)", "note"), ("(with mate", "open"), ("- Ann Lee, Town", "note")]:
        assert truncation.ending(text) == how


def test_subjects(spark, data, odd_articles):
    labels, areas = read(spark, data, "subject_labels"), read(spark, data, "subject_areas")
    articles = read(spark, data, "preprocessed_articles")
    got = defaultdict(set)
    for r in subjects.assign_subjects(articles, labels, areas).collect():
        got[r.article_id].add(r.subject)
    want = defaultdict(set)
    for r in labels.collect():
        want[r.article_id].add(r.subject.lower())
    known = [a for a in want if a in got]
    assert sum(got[a] == want[a] for a in known) >= 0.6 * len(known)  # labels of a few articles, some wrong
    odd = subjects.assign_subjects(odd_articles, labels, areas).collect()
    assert {r.article_id for r in odd} == {1, 2, 3, 4, 8} and {r.subject for r in odd if r.article_id == 4} == {"general"}
    assert subjects.assign_subjects(odd_articles.limit(0), labels, areas).count() == 0
    assert subjects.assign_subjects(odd_articles, labels.limit(0), areas).count() >= 5


def brute_neighbours(ids, x, k):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for i in range(len(ids)):
        others = np.delete(np.arange(len(ids)), i)
        best = others[np.lexsort((ids[others], -s[i, others]))][:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in best}
    return out


def test_neighbours_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 24))
    x = (centres[rng.integers(0, 60, 3000)] + 0.4 * rng.standard_normal((3000, 24))).astype(np.float32)
    x[2000:2900] = x[7]  # nearly a third are copies of one vector
    ids = rng.permutation(10_000)[:3000]
    frame = spark.createDataFrame([(int(i), [float(v) for v in r], 1, "a", b"") for i, r in zip(ids, x)], "article_id long, doc_embedding array<float>, id int, leaf string, v binary")
    odd = spark.createDataFrame([(20_001, None), (20_002, []), (20_003, [0.0] * 24), (None, [1.0] * 24), (20_004, [float("nan")] * 24), (20_005, [1.0])], "article_id long, doc_embedding array<float>")
    got = {tuple(r) for r in neighbours.nearest_pairs(frame.unionByName(odd, allowMissingColumns=True), leaf_rows=64, sample=1500).collect()}
    want = brute_neighbours(ids, x, 5)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    hot = {i for i in ids[2000:2900]}
    first = sorted(hot | {ids[7]})[:6]
    assert {p for p in got if p[0] in hot and p[1] in hot} <= {p for p in want} and all(min(p) in first for p in got if p[0] in hot and p[1] in hot)


def test_neighbours_of_one_direction(spark):
    """Vectors of one direction and many lengths tie at 1.000000, far more of them than are compared at first: the smallest ids win."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 12)).astype(np.float32)
    x[100:300] = x[7] * rng.uniform(0.3, 9, (200, 1)).astype(np.float32)
    ids = rng.permutation(1000)[:400]
    frame = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "article_id long, doc_embedding array<float>")
    got = {tuple(r) for r in neighbours.nearest(frame, leaf_rows=64, recall=1.0).collect()}
    hot = sorted([*ids[100:300], ids[7]])
    for i in hot:
        assert {b for a, b in got if a == i} == set([j for j in hot[:6] if j != i][:5])


def test_neighbours_small(spark):
    empty = spark.createDataFrame([], "article_id long, doc_embedding array<float>")
    assert neighbours.nearest_pairs(empty).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0])], "article_id long, doc_embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest_pairs(two).collect()] == [(1, 2)]
    assert neighbours.nearest_pairs(two.limit(1)).count() == 0


def test_tree_visits_all_leaves_best_first():
    rng = np.random.default_rng(0)
    x = neighbours._unit(rng.standard_normal((500, 6)).astype(np.float32))
    tree = neighbours.Tree.fit(x, 25)
    for order in tree.visits(x[:20], 10**6):
        assert sorted(order) == list(range(len(tree.leaves)))


def records(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, True) for r in rows], "record_id long, batch_id int, title string, url string, source string, words string, key int, cut boolean")


def test_history(spark):
    t = "Alvor Metals cuts copper exports after a fire near Port Bell"
    rows = [
        (1, 0, t, "https://a.example/x?id=1&sec=b", "A"), (2, 0, "Borin Foods halts rice intake amid flooding at Lund", "https://a.example/y", "A"), (3, 1, "AFTER FIRE NEAR PORT BELL, ALVOR METALS TRIMS COPPER EXPORTS | A", None, "A"),
        (4, 1, "Other words altogether here today", "http://WWW.a.example:80/x/?sec=b&id=1&utm_source=q#top", None), (5, 1, "Alvor Metals cuts zinc exports after a fire near Port Bell", "https://a.example/z", "A"), (6, 2, "UPDATE 1: Alvor Metlas cuts copper exports after a fire near Port Bell", "", "A"),
        (7, 2, "Alvor Metals cuts copper exports as a fire ne…", "https://b.example/q", None), (8, 2, None, None, None), (9, 2, "", " ", "A"), (10, 2, "Index week 31 of 2023: rates up 8 percent", None, "A"), (11, 2, "Index week 31 of 2024: rates up 8 percent", None, "A"),
        (12, None, "Borin&nbsp;Foods stops rice intake amid flooding at Lund", "https://c.example/1", None),
    ]
    want = {(1, 3), (1, 4), (1, 6), (1, 7)}
    got = {tuple(r) for r in history.first_reports(records(spark, rows)).collect()}
    assert got == want | {(2, 12)}
    assert {tuple(r) for r in history.first_reports(records(spark, [(r[0], 0, *r[2:]) for r in rows])).collect()} == got
    assert history.first_reports(records(spark, rows).limit(0)).count() == 0


def test_history_finds_every_slip(spark):
    """Short headlines with one slip, of a word, a verb, a joining word or between two words: bands alone miss many."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8))
    rows, want = [], set()
    for i in range(200):
        ws = [word() for _ in range(3 + i % 4)] + ["reduces"]
        at = i % (len(ws) - 1)
        slip = [list(ws), list(ws), list(ws), [*ws, "folowing"]][i % 4 if i % 8 else 0]
        if i % 4 == 1:
            slip[at] = slip[at][:3] + " " + slip[at][3:]
        elif i % 4 == 2:
            slip[-1] = "trmis"
        elif len(slip) == len(ws):
            slip[at] = slip[at][:2] + slip[at][3:]
        rows += [(2 * i, 0, " ".join(ws), None, "A"), (2 * i + 1, 1, " ".join(slip), None, "A")]
        if headlines.same_headline(headlines.headline(rows[-2][2], "A")[0], headlines.headline(rows[-1][2], "A")[0]):
            want.add((2 * i, 2 * i + 1))
    assert len(want) > 190
    assert {tuple(r) for r in history.first_reports(records(spark, rows)).collect()} == want


def test_history_is_kept_and_opened_again(spark, data, tmp_path):
    """One object a batch on one path gives what one object gives in one step."""
    rows = read(spark, data, "corpus_records").where("batch_id < 4")
    at = f"file://{tmp_path}/history"
    for n in range(4):
        history.History(spark, at).add(rows.where(F.col("batch_id") == n))
    again = history.History(spark, at)
    assert again.store.steps == 4
    want = {tuple(r) for r in history.first_reports(rows.withColumn("batch_id", F.lit(0))).collect()}
    assert {tuple(r) for r in again.reports().collect()} == want and want


def test_history_copies_and_long_titles(spark):
    rows = [(i, i % 3, "Same headline of one report again", "https://a.example/same", "A") for i in range(300)] + [(1000, 1, "word " * 20_000, "https://a.example/" + "p" * 100_000, "A")]
    got = history.first_reports(records(spark, rows + rows[:5])).collect()
    assert sorted((r[0], r[1]) for r in got) == [(0, i) for i in range(1, 300)]


def test_history_adds_with_few_jobs(spark, tmp_path):
    """Each job leaves plans, threads and broadcast tables with the driver; an add made some 30, which took it beyond its memory after some rounds of 21 batches."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3)) * 3
    rows = [(i, i % 3, f"{word(i % 40)} cuts {word(i % 40 + 100)} exports after a fire near {word(i % 40 + 200)}", f"https://a.example/{i % 90}", "A") for i in range(120)]
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    at, took = history.History(spark, f"file://{tmp_path}/few"), []
    for n in range(3):
        began = jobs()
        at.add(records(spark, rows).where(F.col("batch_id") == n))
        took.append(jobs() - began)
    assert max(took) <= 18
    assert {tuple(r) for r in at.reports().collect()} == {(i % 10, i) for i in range(10, 120)}


def test_headline_pairs():
    h = lambda t: headlines.headline(t, "A")[0]
    assert headlines.same_headline(h("X Foods reopens wheat loading at Y"), h("X Foods restarts wheat laoding at Y"))
    for other in ("X Foods reopens barley loading at Y", "X Foods halts wheat loading at Y", "Z Foods reopens wheat loading at Y", "X Foods reopens wheat loading at Q"):
        assert not headlines.same_headline(h("X Foods reopens wheat loading at Y"), h(other))
    assert headlines.address("https://a.example") is None and headlines.address("nonsense") is None and headlines.address(None) is None


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 600)], "a long, b long")
    assert {tuple(r) for r in history.components(links).select("id", "root").collect()} == {(i, 0) for i in range(1, 101)} | {(600, 500)}


def test_packing(spark, data):
    documents, capacities = read(spark, data, "documents"), read(spark, data, "pack_capacities")
    sizes = {r.doc_id: r.n_tokens for r in packing.token_sizes(documents).collect()}
    got = packing.pack(documents, capacities).toPandas()
    for (cap_id, cap), part in got.groupby(["capacity_id", "capacity_tokens"]):
        assert part.groupby("container").n_tokens.sum().max() <= cap
        assert part.groupby("doc_id").n_tokens.sum().to_dict() == sizes
        pieces = part.sort_values(["doc_id", "piece"]).groupby("doc_id")
        assert all((p.start_token.to_numpy() == np.r_[0, p.n_tokens.cumsum().to_numpy()[:-1]]).all() for _, p in pieces)
        assert not (part[part.doc_id.map(sizes) <= cap].groupby("doc_id").size() > 1).any()
        assert part.container.nunique() <= 1.1 * np.ceil(sum(sizes.values()) / cap) + 1
    assert packing.pack(documents.limit(0), capacities).count() == 0


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = np.sort(rng.integers(0, 101, rng.integers(1, 200)))[::-1]
        free, want = [], []
        for s in sizes:
            at = next((i for i, f in enumerate(free) if f >= s), len(free))
            if at == len(free):
                free.append(100)
            free[at] -= s
            want.append(at)
        assert packing.first_fit(sizes, 100).tolist() == want


def test_packing_edges(spark):
    rows = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "word " * 30_000, 3), (4, "a", 3), (5, "a", 3)], "doc_id long, text string, piece int")
    caps = spark.createDataFrame([(1, 512), (2, None), (3, 0)], "capacity_id int, capacity_tokens int")
    got = packing.pack(rows, caps).toPandas()
    assert set(got.doc_id) == {2, 3, 4, 5} and got.groupby("container").n_tokens.sum().max() <= 512


ITEM = "One hasty apprentice drains each steep auditor although that narrow sexton counts 20 patched parapets. Each torn anvil hoists Nalsel Foods under the bridge of Ulga whenever each painted chandler copies 22 crooked cartwrights on Tuesday."


def test_leaks(spark):
    filler = "The press office said on Monday that the talks would go on until the end of the week in the town hall. "
    w = ITEM.split()
    texts = {
        1: filler + ITEM, 2: filler + " ".join(w[5:18]), 3: filler + " ".join(w[5:14]), 4: "> " + "\n> ".join(re.findall(r".{1,40}(?:\s|$)", ITEM)) + filler, 5: ITEM.upper().replace(".", "").replace(",", ""),
        6: " ".join(x if i % 6 else "indeed" for i, x in enumerate(w)) + " " + filler, 7: filler * 40, 8: None, 9: "", 10: "<p>" + ITEM.replace("apprentice", "appren<b>tice</b>").replace("anvil", "an​vil") + "</p>", 11: filler * 3000 + " ".join(w[8:30]), 12: " ".join(w[:14]) + " " + filler * 3 + " ".join(w[20:]),
    }
    more = {100 + i: filler + f"Number {i} of the series was printed in the usual way." for i in range(300)}
    documents = spark.createDataFrame([(i, t, 7, "q") for i, t in (texts | more).items()], "doc_id long, text string, item_id int, words string")
    items = spark.createDataFrame([(1, "s", ITEM, "Who keeps the scale if Ulga never sees the anchor?"), (2, "s", None, None), (3, "s", "", "")], "item_id long, suite string, passage string, question string")
    got = {tuple(r) for r in leakage.find_leaks(documents, items).collect()}
    assert got == {(i, 1) for i in (1, 2, 4, 5, 6, 10, 11, 12)}
    assert leakage.find_leaks(documents.limit(0), items).count() == 0 and leakage.find_leaks(documents, items.limit(0)).count() == 0


def test_half_of_an_item_in_a_stretch_or_two():
    """Just half of the words in order are enough whichever words they are, less are not, and one stretch does not count twice."""
    rng = np.random.default_rng(7)
    item = [f"w{i}" for i in range(60)]
    table = leakage.Items([(1, item), (2, [f"v{i}" for i in range(60)])], {w: 0.1 if i % 2 else 9.0 for i, w in enumerate(item)}, 9.0)
    gap = [f"x{i}" for i in range(200)]

    def found(keep, between):
        texts = [w if i in keep else f"y{i}" for i, w in enumerate(item)]
        words = gap[:90] + texts[:30] + between + texts[30:] + gap[:90]
        return 0 in table.candidates(words).keys() | table.countable(words) and table.holds(0, words, set())

    for between in ([], gap):
        for _ in range(10):
            keep = rng.choice(60, 30, replace=False).tolist()
            assert found(keep, between) and not found(keep[:-1], between)
        assert found(range(1, 60, 2), between)  # the common half of the words
    twice = leakage.Items([(1, ["a", "b", "c", "d"] * 10)], {}, 9.0)
    assert not twice.holds(0, ["a", "b", "c", "d"] * 2 + ["a", "b", "c"], set())


def test_subsequence_length():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = [str(v) for v in rng.integers(0, 5, rng.integers(1, 30))], [str(v) for v in rng.integers(0, 5, rng.integers(0, 40))]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert leakage.in_order(a, b) == row[-1]


def test_hamming_blocks_find_all_within_radius():
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(6)
    items = [(i, [words[j] for j in rng.integers(0, 400, 40)]) for i in range(20)]
    table = leakage.Items(items, {}, 8.0)
    for i, ws in items:
        assert table.candidates(ws[10:30])[i] >= {0}


ODD_PAGES = [
    (900_001, "cheap copper buy copper best zinc top copper zinc deal order copper " * 20), (900_002, None), (900_003, ""), (900_004, "  \n"), (900_005, "\n".join(f"https://x.example/tag/{i}" for i in range(30))), (900_006, "#buyZinc #topZinc #zinc #zincNow " * 10),
    (900_007, "Buy zinc from Acme because zinc is the best zinc and zinc price is low zinc price. " * 6), (900_008, "\n".join(f"Vessel {i} | 0{i % 9} May 06:00 | berth {i} | {i * 37} TEU" for i in range(30))),
]


def test_spam(spark, data):
    documents = read(spark, data, "documents")
    more = spark.createDataFrame(ODD_PAGES, "doc_id long, text string")
    got = {r.doc_id for r in spam.spam_pages(documents.select("doc_id", "text").unionByName(more)).collect()}
    assert {i for i in got if i >= 900_000} == {900_001, 900_005, 900_006, 900_007}
    assert spam.spam_pages(documents.limit(0)).count() == 0
    clash = more.withColumns({"spam": F.lit(1), "words": F.lit(2), "kind": F.lit(3), "copies": F.lit(4), "h": F.lit("h")})
    assert spam.spam_share(clash).count() == 7


def salad_corpus(n):
    """``n`` coherent texts, some texts of the same words in random order without end or set as sentences, and a list that repeats."""
    rng = np.random.default_rng(3)
    chains = [[f"{a}{i}" for i in "abcdefgh"] for a in ("re", "lo", "mi", "fa", "so", "ut")]
    flow = lambda: " ".join(" ".join(["The", *chains[rng.integers(6)]]) + "." for _ in range(12))
    every = [w for c in chains for w in c]
    rows = [(i, flow()) for i in range(n)]
    rows += [(10_000 + i, " ".join(rng.choice(every, 90))) for i in range(5)]
    rows += [(20_000 + i, " ".join("The " + " ".join(rng.choice(every, 9)) + "." for _ in range(12))) for i in range(5)]
    rows += [(30_000, "fa a la carte " * 30), (30_001, " ".join(" ".join(c) for c in chains + chains[::-1]))]
    return rows


@pytest.mark.parametrize("n", [200, 2000])
def test_spam_by_coherence_at_any_size(spark, n):
    """Salad without any repeated keyword, loose or set as sentences, and a coherent text that repeats one line; the same at ten times the corpus."""
    rows = spark.createDataFrame(salad_corpus(n), "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in spam.spam_pages(rows).collect()}
    assert got == {10_000 + i for i in range(5)} | {20_000 + i for i in range(5)} | {30_000}
    # Without coherence only what repeats itself is left; without repetition the list is missed.
    assert {r.doc_id for r in spam.spam_pages(rows, salad=-9.0, hopeless=-9.0).collect()} == {30_000}
    assert 30_000 not in {r.doc_id for r in spam.spam_pages(rows, often=2.0).collect()}


def test_spam_with_few_known_pairs(spark, data):
    """The verdicts hardly move when an eighth of the pairs may be known, or the corpus is there twice under other words."""
    documents = read(spark, data.replace("0.001", "0.01"), "documents").select("doc_id", "text")
    want = {r.doc_id for r in spam.spam_pages(documents).collect()}
    few = {r.doc_id for r in spam.spam_pages(documents, most_pairs=1 << 16).collect()}
    twice = documents.unionByName(documents.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat("text", F.lit(" Ende.")).alias("text")))
    more = {r.doc_id for r in spam.spam_pages(twice).collect()}
    assert len(want) > 40 and len(want ^ few) <= 0.15 * len(want) and len(want ^ {i for i in more if i < 1_000_000}) <= 0.15 * len(want)


def test_spam_counts_are_whole(spark, data):
    """What a text is judged by is the same whether all counts are broadcast or most are asked for; copies and texts without words too."""
    documents = read(spark, data, "documents").select("doc_id", "text")
    rows = documents.unionByName(documents.limit(20).select((F.col("doc_id") + 700_000).alias("doc_id"), "text")).unionByName(spark.createDataFrame(ODD_PAGES, "doc_id long, text string"))
    whole = {r.doc_id: r for r in spam.text_stats(rows, most_pairs=1 << 40).collect()}
    for few in (1 << 10, 1):
        got = {r.doc_id: r for r in spam.text_stats(rows, most_pairs=few).collect()}
        assert got.keys() == whole.keys()
        for i, r in whole.items():
            assert np.allclose(tuple(r), tuple(got[i]), rtol=0, atol=1e-9)


def closing_corpus(odd_close):
    """Texts of two sources: one cuts at 400 letters, and whole texts of both may end in a word, not in a stop."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("bdfglmnprstvz"), rng.integers(2, 6))) + rng.choice(["on", "er", "al"])
    known = [word() for _ in range(300)]
    rows, cut, close, stops = [], set(), set(), set()
    for i in range(1500):
        text = ""
        want = int(np.exp(rng.normal(5.9, 0.35)))
        while len(text) < want:
            text += " ".join(rng.choice(known, 8)).capitalize() + " the end of it. "
        text = text.strip()
        if i % 2 and len(text) > 400:
            text = text[:400]
            (stops if truncation.ending(text) == "stop" else cut).add(i)
        elif rng.random() < odd_close:
            text += " " + " ".join(rng.choice(known, 3)).capitalize()
            if i % 2 and len(text) == 400:
                text += "x"
            close.add(i)
        rows.append((i, "a" if i % 2 else "b", "T", text, None))
    return rows, cut, close, stops


def test_length_and_ending_both_decide(spark):
    schema = "article_id long, source string, clean_title string, clean_body string, fetched_at timestamp_ntz"
    rows, cut, close, stops = closing_corpus(0.1)
    got = {r.article_id for r in truncation.truncated(spark.createDataFrame(rows, schema)).collect()}
    at_words = {i for i in cut if re.search(r"(?:on|er|al)$", rows[i][3])}
    assert at_words and close
    # The same ending, a common word without a stop: cut at the limit, whole elsewhere; a stop at the limit is whole.
    assert len(got & cut) >= 0.99 * len(cut) and len(got & close) <= 0.05 * len(close) and not got & stops
    # Where whole texts always end with a stop, the same endings are cuts in mid-transfer anywhere.
    rows, cut, _, stops = closing_corpus(0)
    moved = [(i, s, t, b[: len(b) - 7 - i % 20] if i % 50 == 0 else b, f) for i, s, t, b, f in rows]
    mid = {i for i in range(0, 1500, 50) if truncation.ending(moved[i][3]) == "open"}
    got = {r.article_id for r in truncation.truncated(spark.createDataFrame(moved, schema)).collect()}
    assert len(got & mid) >= 0.95 * len(mid) and len(got & cut) >= 0.99 * len(cut) and not got - cut - mid


def test_visits_hold_for_rows_outside_the_sample(spark):
    """With a few sample rows a leaf, as in large tables, leaves lie closer to these rows than to all others."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(60, 32))
    x = (centre[rng.integers(0, 60, 6000)] + 0.7 * rng.normal(size=(6000, 32))).astype(np.float32)
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "article_id bigint, doc_embedding array<float>")
    got = set(map(tuple, neighbours.nearest(rows, sample=400, leaf_rows=60).toPandas().to_numpy().tolist()))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -9)
    best = np.argsort(-score, axis=1)[:, :5]
    assert np.mean([(i, j) in got for i in range(len(x)) for j in best[i].tolist()]) >= 0.985


def test_words_of_headlines_are_hashed_once(monkeypatch):
    import itertools

    import pandas as pd

    calls, plain = [], history._hash
    monkeypatch.setattr(history, "_hash", lambda text: calls.append(text) or plain(text))
    texts = [" ".join(p) for p in itertools.islice(itertools.permutations("harbor strike shuts wheat terminal".split()), 100)]
    got = pd.concat(history._keys([pd.DataFrame({"key": range(100), "words": texts, "cut": False})]))
    assert len(got[got["role"] == history.BAND]) == 1600 and got["key"].dtype == "int64"
    assert len(calls) < 100 * 5  # a prefix and the numbers of each, and each word and pair of words once
