import math

import pytest
from pyspark.sql import functions as F

from corvidex.functions.query import Query, parse_query
from corvidex.operators import evaluate as ev
from corvidex.operators import feedback as fb
from corvidex.operators import index as ix
from corvidex.operators import knowledge as kn
from corvidex.operators import match, mining, rank, spelling
from corvidex.operators.ranks import ordinal_rank

DOCS = [(1, "web search engines rank pages"), (2, "search the web and search again"), (3, "web pages search"), (4, None), (5, ""), (6, "the web web web")]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").withColumn("name", F.col("doc_id"))
    ranks = spark.createDataFrame([(1, 0.5), (2, 1.5)], "name bigint, pr double")
    views = spark.createDataFrame([(2, 7), (3, 0)], "name bigint, views bigint")
    return ix.build(docs, page_rank=ranks, num_views=views)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_matching(index):
    assert ids(match.matches(index, parse_query("web search"))) == [1, 2, 3]
    assert ids(match.matches(index, parse_query('"web search"'))) == [1]
    assert ids(match.matches(index, parse_query('"web page" search'))) == [3]
    assert ids(match.matches(index, parse_query("web unknown"))) == []
    assert ids(match.matches(index, parse_query(""))) == []
    assert ids(match.matches(index, Query("", ("web web",)))) == [6]


def test_rankers(index):
    ql = {r["doc_id"]: r["score"] for r in rank.query_likelihood(index, parse_query("web search")).collect()}
    assert set(ql) == {1, 2, 3} and ql[3] > ql[1]
    twice = {r["doc_id"]: r["score"] for r in rank.query_likelihood(index, Query("", ("web", "search", "search"))).collect()}
    assert twice[3] < ql[3]
    full = {r["doc_id"]: r["score"] for r in rank.comprehensive(index, parse_query("web search")).collect()}
    assert full[2] == pytest.approx(0.65 * ql[2] + 0.2 * 2.5**0.5 + 0.15 * 3)
    assert [r["doc_id"] for r in rank.num_view(index, parse_query("web")).collect()] == [2]
    cos = {r["doc_id"]: r["score"] for r in rank.cosine(index, parse_query("rank")).collect()}
    assert set(cos) == {1} and 0 < cos[1] <= 1 + 1e-12
    with pytest.raises(ValueError):
        rank.ranker("phrase")
    with pytest.raises(ValueError):
        rank.ranker(None)


def test_pages_cover_the_ranking(index):
    scored = rank.query_likelihood(index, parse_query("web"))
    whole = [r["doc_id"] for r in rank.page(scored, 10).collect()]
    parts = [r["doc_id"] for n in (1, 2, 3) for r in rank.page(scored, 2, n).collect()]
    assert parts == whole and len(whole) == 4 and rank.page(scored, 2, 9).count() == 0


def test_batch_is_single(index, spark):
    queries = spark.createDataFrame([(1, "web search"), (2, "rank"), (3, None), (4, "the"), (5, "nosuch web")], "query_id bigint, query string")
    got = rank.query_likelihood_batch(index, rank.batch_terms(queries)).collect()
    one = {r["doc_id"]: r["score"] for r in rank.query_likelihood(index, parse_query("web search")).collect()}
    assert {r["doc_id"]: pytest.approx(r["score"]) for r in got if r["query_id"] == 1} == one
    assert {r["query_id"] for r in got} == {1, 2}


def test_log_is_single(index, spark):
    log = [(1, '"web search"', 10), (2, "web", 2), (3, "web", None), (4, "web", 40), (5, '"the web" search', 1), (6, '"web search"', 1), (7, None, 5), (8, "web search", 20), (9, '"web page" "page search"', None), (10, '"web', 3)]
    log += [(11, '"web search" web', 5), (12, '"nosuch web"', 5)]
    queries = spark.createDataFrame(log, "query_id bigint, query string, top int")
    terms, phrases = rank.batch_parsed(queries)
    got = {}
    for r in rank.query_likelihood_batch(index, terms, phrases=phrases, tops=queries.select("query_id", "top")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], round(r["score"], 9))
    for q, text, top in log:
        one = rank.page(rank.query_likelihood(index, parse_query(text)), top or 10).collect()
        assert got.get(q, {}) == {k + 1: (r["doc_id"], round(r["score"], 9)) for k, r in enumerate(one)}
    assert [len(got.get(q, {})) for q in (1, 2, 3, 8, 9)] == [1, 2, 4, 3, 1]


@pytest.fixture
def small_blocks(monkeypatch):
    from corvidex.operators import blocks

    for name, value in {"BLOCK_DOCS": 5, "PIECE_DOCS": 2, "PIECE_WORDS": 30, "KEPT": 7, "DENSE_SHARE": 0.5, "DENSE_TERMS": 2}.items():
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(rank, "LOG_PART", 3)


def test_log_over_blocks_is_single(spark, small_blocks):
    import random

    pick = random.Random(5)
    words = ["web", "Search", "pages!", "ranked", "the", "...", "http://x.y", "hmyyyyyyyyying", "ΣΑΣ", "İ", "a\u00a0b"]
    docs = [(i, " ".join(pick.choices(words, [6, 5, 4, 3, 3, 2, 2, 1, 1, 1, 1], k=pick.randint(1, 12)))) for i in pick.sample(range(100), 60)]
    docs += [(200 + i, "web search web") for i in range(15)]  # ties, over several blocks and tasks
    docs += [(300, None), (301, ""), (302, " \t\n"), (303, "http://only.links"), (304, "ranked " * 70)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    log = [(1, "web search", 10), (2, '"web search"', 40), (3, "search web", 3), (4, "web", None), (5, '"web search" "search web"', 20), (6, "ranked", 2), (7, "nosuch web", 5), (8, '"nosuch web"', 5)]
    log += [(9, None, 5), (10, "the", 5), (11, "hmyyyyyyyyying", 9), (12, "web web search", 10), (13, '"the ..." web', 9), (14, "σας", 9), (15, '"search"', 9), (16, "pages ranked web search", 40), (17, "web", 0), (18, '"web search', 12)]
    queries = spark.createDataFrame(log, "query_id bigint, query string, top int")
    index = ix.build(table)
    got = {}
    for r in rank.query_likelihood_log(table, *rank.batch_parsed(queries), queries.select("query_id", "top")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], round(r["score"], 9))
    for q, text, top in log:
        one = rank.page(rank.query_likelihood(index, parse_query(text)), 10 if top is None else top).collect() if top != 0 else []
        assert got.get(q, {}) == {k + 1: (r["doc_id"], round(r["score"], 9)) for k, r in enumerate(one)}
    assert min(len(got[q]) for q in (1, 2, 3, 4, 5, 6, 12, 16)) > 0 and len(got[2]) > 15


def test_log_counts_documents_without_id(spark):
    docs = spark.createDataFrame([(1, "web page"), (None, "web web search"), (2, "web")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "web", 5), (None, "web", 5)], "query_id bigint, query string, top int")
    got = rank.query_likelihood_log(docs, *rank.batch_parsed(queries), queries.select("query_id", "top")).collect()
    share = 0.5 * 4 / 6
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 1), (1, 1, 2)]
    assert {r["doc_id"]: r["score"] for r in got} == {1: pytest.approx(math.log2(0.25 + share)), 2: pytest.approx(math.log2(0.5 + share))}


def test_log_without_queries_or_documents(spark):
    docs = spark.createDataFrame([(1, "web page")], "doc_id bigint, text string")
    log = spark.createDataFrame([(1, "web", 5), (2, '"web page"', 5)], "query_id bigint, query string, top int")
    for d, q in ((docs, log.limit(0)), (docs.limit(0), log), (docs, log.where("query_id = 1").withColumn("query", F.lit("the")))):
        assert rank.query_likelihood_log(d, *rank.batch_parsed(q), q.select("query_id", "top")).count() == 0


def test_log_shuffles_no_row_for_each_query_and_document(spark, tmp_path):
    """Rows of a join for each pair of them are what a log can't be ranked with in time on large tables."""
    from corvidex.plans.retrieval_queries import QUERIES

    words = [f"w{i}x" for i in range(12)]
    spark.createDataFrame([(i, " ".join(words) + " more" * (i % 9)) for i in range(500)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = [(12 * i + j, f"{a} {b}", 10) for i, a in enumerate(words) for j, b in enumerate(words) if i < j]
    spark.createDataFrame(pairs, "query_id bigint, query string, numdocs int").write.parquet(str(tmp_path / "search_query.parquet"))
    sc = spark.sparkContext
    sc.setJobGroup("pairs", "")
    rows = QUERIES["rank_ql_log"](spark, str(tmp_path)).collect()
    sc.setJobGroup("", "")
    assert len(rows) == 10 * len(pairs)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("pairs") for s in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 500 * len(pairs)


def test_log_gives_as_many_as_asked(spark, tmp_path):
    from corvidex.plans.retrieval_queries import QUERIES

    spark.createDataFrame([(i, "word word" + " more" * i) for i in range(1, 31)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "word", 20), (2, "word", None), (3, '"word word"', 40)], "query_id bigint, query string, numdocs int").write.parquet(str(tmp_path / "search_query.parquet"))
    got = QUERIES["rank_ql_log"](spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {1: 20, 2: 10, 3: 30}


def test_index_round_trip(index, spark, tmp_path):
    ix.write(index, str(tmp_path), 2)
    back = ix.load(spark, str(tmp_path))
    assert sorted(map(tuple, back.postings.collect())) == sorted(map(tuple, index.postings.collect()))
    assert back.scalars().first() == index.scalars().first()
    assert ids(match.matches(back, parse_query('"web search"'))) == [1]
    assert back.doc(99).count() == 0 and back.has_term("web").count() == 1


def test_empty_collection(spark):
    empty = ix.build(spark.createDataFrame([], "doc_id bigint, text string"))
    assert empty.postings.count() == 0 and tuple(empty.scalars().first()) == (0, 0)
    assert rank.query_likelihood(empty, parse_query("web")).count() == 0
    assert fb.expansion_terms(empty, parse_query("web")).count() == 0


def test_page_rank_leaks_what_ends(spark):
    pages = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("A", "B")], "src string, dst string")
    first = {r["name"]: round(r["pr"], 6) for r in mining.page_rank(pages, edges, 1).collect()}
    second = {r["name"]: round(r["pr"], 6) for r in mining.page_rank(pages, edges).collect()}
    assert first == {"A": 0.1, "B": 0.55, "C": 1.45} and second == {"A": 0.1, "B": 0.145, "C": 0.64}
    assert mining.page_rank(pages, edges, 10).count() == 3


def test_views(spark):
    names = spark.createDataFrame([("Web_server",), ("Other",), ("R",), ("R.html",)], "name string")
    lines = spark.createDataFrame([(x,) for x in ["en Web_server 3", "de Web_server 2 ", "en Web_server x", "en Web server 3", "en Unknown 9", "en R 4", "", None]], "line string")
    assert {r["name"]: r["views"] for r in mining.num_views(lines, names).collect()} == {"Web_server": 5, "Other": 0, "R.html": 4}


def test_links(spark):
    pages = spark.createDataFrame([("a", '<a class="x" href="B">b</a> <a href="c/d">\n<A href="C"><a href="x y"><a href="D#e">'), ("b", None)], "name string, html string")
    assert sorted(r["dst"] for r in mining.links(pages).collect()) == ["B", "C"]


def test_metrics(spark):
    grades = {10: "Perfect", 5: "Good", 1: "Fair", 7: "Excellent"}
    gains = [10, 0, 5, 1, 0, 7, 0, 0, 0, 0]
    run = spark.createDataFrame([("q", i + 1, i) for i in range(10)] + [("unjudged", 1, 1)] + [("short", 1, 0)], "query string, rank bigint, doc_id bigint")
    qrels = spark.createDataFrame([("q", i, grades[g]) for i, g in enumerate(gains) if g] + [("short", 5, "Bad")], "query string, doc_id bigint, grade string")
    m = {r["query"]: r for r in ev.metrics(run, qrels).collect()}
    assert set(m) == {"q", "short"}
    r = m["q"]
    assert (r["p_1"], r["p_5"], r["p_10"]) == (1, 0.4, pytest.approx(0.3))
    assert (r["r_1"], r["r_5"], r["r_10"]) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 1)
    assert r["rr"] == 1 and r["ap"] == pytest.approx((1 + 2 / 3 + 3 / 6) / 3)
    assert all(0 <= r[f"ndcg_{k}"] <= 1 for k in (1, 5, 10)) and r["ndcg_1"] == 1
    assert [r[f"pr_{i}"] for i in (0, 3, 4, 10)] == [0, 0, 1, 0.5]
    assert m["short"]["ap"] == 0 and m["short"]["ndcg_10"] == 0 and m["short"]["f_1"] == 0


def test_feedback(index):
    rows = {r["term"]: r["prob"] for r in fb.expansion_terms(index, parse_query("web search"), num_terms=3).collect()}
    assert sum(rows.values()) == pytest.approx(1) and list(rows)[0] == "search"
    assert not {"web", "search"} & {r["term"] for r in fb.expansion_terms(index, parse_query("web search"), include_query=False).collect()}


def test_likeness(spark):
    runs = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0), (3, "z", 1.0)], "run_id bigint, term string, prob double")
    got = {(r["q1"], r["q2"]): r["coefficient"] for r in fb.bhattacharyya(runs, runs).collect()}
    assert got == {(1, 2): pytest.approx(0.5**0.5), (2, 1): pytest.approx(0.5**0.5)}
    more = spark.createDataFrame([(i, "a", 1.0 / i) for i in range(1, 6)], "run_id bigint, term string, prob double")
    assert [(r["q2"], r["place"]) for r in fb.most_alike(more.where("run_id = 3"), more, 2).orderBy("place").collect()] == [(1, 1), (2, 2)]


def test_likeness_keeps_every_pair(spark, tmp_path):
    from corvidex.plans.retrieval_queries import QUERIES

    rows = [(i, 0, "a", 1.0 / i) for i in range(1, 31)] + [(31, 0, "z", 1.0)]
    spark.createDataFrame(rows, "run_id bigint, pos_in_run int, c0 string, c1 double").write.parquet(str(tmp_path / "prf.parquet"))
    got = QUERIES["prf_similarity_all"](spark, str(tmp_path)).collect()
    assert sorted((r["q1"], r["q2"]) for r in got) == [(20, i) for i in range(1, 31) if i != 20]


def test_rank_correlation(spark):
    up = spark.createDataFrame([(str(i), float(i), i * i) for i in range(20)], "name string, a double, b bigint")
    assert fb.spearman(up, "name", "a", "b").first()["rho"] == pytest.approx(1)
    assert fb.spearman(up.limit(1), "name", "a", "b").first()["rho"] == 0
    ranked = ordinal_rank(up, [F.desc("a")], "r").orderBy("r").collect()
    assert [r["name"] for r in ranked] == [str(i) for i in range(19, -1, -1)] and [r["r"] for r in ranked] == list(range(1, 21))


def test_spelling(spark):
    dic = spark.createDataFrame([("search", 5), ("sea", 9), ("the", 100), ("each", 2), ("café", 7), ("sex", 1)], "word string, cnt bigint")
    words = spark.createDataFrame([("serch",), ("saerhc",), ("search",), ("zzzzzz",), ("cafe",), ("caf",), ("sae",)], "word string")
    one = {(r["word"], r["candidate"]) for r in spelling.candidates1(words, dic).collect()}
    assert one == {("serch", "search"), ("sae", "sea")}
    two = {(r["word"], r["candidate"]) for r in spelling.candidates2(words, dic).collect()}
    assert ("saerhc", "search") in two and not any(c == "café" for _, c in two)
    fixed = {r["word"]: r["correction"] for r in spelling.correct(words, dic).collect()}
    assert fixed["serch"] == "search" and fixed["search"] == "search" and fixed["zzzzzz"] == "zzzzzz" and fixed["saerhc"] == "search"


def test_edits_of_edits_by_brute_force(spark):
    import itertools

    def edits(w):
        a = "abcdefghijklmnopqrstuvwxyz"
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {x + y[1:] for x, y in cuts if y} | {x + y[1] + y[0] + y[2:] for x, y in cuts if len(y) > 1} | {x + c + y[1:] for x, y in cuts if y for c in a} | {x + c + y for x, y in cuts for c in a}

    vocabulary = ["".join(p) for n in (1, 2, 3) for p in itertools.product("abé", repeat=n)] + ["abcd", "dcba", "bacd"]
    dic = spark.createDataFrame([(w, 1) for w in vocabulary], "word string, cnt bigint")
    asked = ["abz", "zba", "q", "cabd", "éz"]
    got = {(r["word"], r["candidate"]) for r in spelling.candidates2(spark.createDataFrame([(w,) for w in asked], "word string"), dic).collect()}
    want = {(w, c) for w in asked for c in {e for m in edits(w) for e in edits(m)} & set(vocabulary) if c != "a"}  # a is a stop word
    assert got == want


def test_knowledge(spark):
    rows = spark.createDataFrame([(1, "sort a list", "how", "use sorted", 3, 10, 0.5), (2, "sort files", "how", None, -1, None, float("nan"))], "doc_id bigint, title string, question string, answer string, vote int, num_views bigint, page_rank double")
    qa = kn.qa_index(rows)
    assert rank.best_answer(qa, parse_query("sort list"), "comprehensive").first()["answer"] == "use sorted"
    assert rank.best_answer(qa, parse_query("sort"), "cosine").count() == 0
    assert rank.knowledge_score(qa, parse_query("sort"), "comprehensive").count() == 2
    tags = spark.createDataFrame([("c",), ("java",)], "tag string")
    assert [r["tag"] for r in kn.opens_gate("C# lists", tags).collect()] == ["c"] and kn.opens_gate("", tags).count() == 0
