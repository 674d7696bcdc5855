import json

import pytest
from pyspark.sql import functions as F

from corvidex.operators import index as ix
from corvidex.operators import mining
from corvidex.serve import Engine, Request
from corvidex.sources import readers, writers
from corvidex.streaming.views import current, start, streaming_views, windowed_views


def test_html_directory(spark, tmp_path):
    for name, body in {"A": "<title>T</title><p>x <a href=\"B\">b</a></p>", ".hidden": "no", "B.html": "no", "B": "<body>y</body>"}.items():
        (tmp_path / name).write_text(body)
    pages = readers.html_pages(spark, str(tmp_path))
    docs = {r["name"]: (r["title"], r["text"], r["url"]) for r in readers.html_documents(pages, "http://w.example/").collect()}
    assert docs == {"A": ("T", "T x b", "http://w.example/A"), "B": ("", "y", "http://w.example/B")}
    assert [tuple(r) for r in mining.links(pages).collect()] == [("A", "B")]


def test_question_pages(spark):
    page = '<title>Q</title><div class="vote-count-post">12</div><div class="post-text">ask <b>me</b></div><div class="post-text">answer</div>' + "".join(f'<p class="label-key">{x}</p>' for x in ("a", "b", "c", "34 times"))
    rows = spark.createDataFrame([("1", page), ("2", "<p>x</p>"), ("3", page.replace("34", "1,234").replace("12<", "many<"))], "name string, html string")
    got = [tuple(r) for r in readers.qa_pages(rows).orderBy("name").collect()]
    assert got[0] == ("1", "Q", "ask me", "answer", 12, 34) and got[1][4:] == (0, 0) and got[2][4:] == (0, 0)


def test_question_pages_of_many_elements(spark):
    page = '<title>Q</title><div class="post-text"><p>Para one.</p><p>Para <b>tw</b>o.</p><pre><code>if a &lt; b:\n  x</code></pre><ul><li>i<li>j</ul><div>in</div></div><td class="post-text" id="b"><div>ans<br>wer</div><p>more &frac12;</p><script>no</script></td><p>out</p>'
    r = readers.qa_pages(spark.createDataFrame([("1", page), ("2", None), ("3", "")], "name string, html string")).orderBy("name").collect()
    assert r[0]["question"] == "Para one. Para two. if a < b: x i j in" and r[0]["answer"] == "ans wer more ½"
    assert [x["question"] for x in r[1:]] == ["", ""]


def test_link_graph(spark, tmp_path):
    pairs = spark.createDataFrame([("A", "C"), ("A", "B"), ("A", "B"), ("B", "A")], "src string, dst string")
    writers.write_links(pairs, str(tmp_path / "g"))
    assert sorted(tuple(r) for r in readers.links(spark, str(tmp_path / "g")).collect()) == [("A", "B"), ("A", "C"), ("B", "A")]


def test_flat_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('a "b\tbody here\t7\nx\ty\n')
    assert [tuple(r) for r in readers.tsv_corpus(spark, str(tmp_path / "c.tsv")).collect()] == [('a "b', "body here", 7), ("x", "y", 0)]
    (tmp_path / "j.tsv").write_text("q\t1\tGood\nq\t1\tBad\nq\t2\tPerfect\n")
    assert sorted(tuple(r) for r in readers.judgments(spark, str(tmp_path / "j.tsv")).collect()) == [("q", 1, "Bad"), ("q", 2, "Perfect")]
    (tmp_path / "r.tsv").write_text("q\t5\tt\t0.1\nq\t4\tt\t0.2\n")
    assert sorted(tuple(r) for r in readers.run(spark, str(tmp_path / "r.tsv")).collect()) == [("q", 1, 5), ("q", 2, 4)]
    (tmp_path / "tags").write_text("C#\n c# \n\nJava\n")
    assert sorted(r["tag"] for r in readers.tags(spark, str(tmp_path / "tags")).collect()) == ["c#", "java"]
    (tmp_path / "p1").write_text("a\t0.5\nb\t0.5\n")
    (tmp_path / "m").write_text(f"web search:{tmp_path}/p1\nno line\n")
    assert sorted(tuple(r) for r in readers.feedback_runs(spark, str(tmp_path / "m")).collect()) == [("web search", "a", 0.5), ("web search", "b", 0.5)]
    (tmp_path / "o").write_text("# note\nindex: a:b\n\nmode: x\n")
    assert readers.options(str(tmp_path / "o"), ("index",))["index"] == "a:b"
    with pytest.raises(ValueError):
        readers.options(str(tmp_path / "o"), ("absent",))


def test_lines(spark):
    row = spark.createDataFrame([(1, "a b", "u", "f", 0.5, 0.1, 3, "s&t")], "doc_id bigint, title string, url string, file_path string, score double, page_rank double, num_views bigint, snippet string")
    r = row.select(writers.text_line().alias("l"), writers.json_object().alias("j")).first()
    assert r["l"] == "1\ta b\t0.5\tPR:0.1\tNV:3\t" and json.loads(r["j"]) == {"id": 1, "title": "a+b", "url": "u", "filePath": "f", "score": 0.5, "pagerank": 0.1, "numviews": 3, "snippet": "s%26t"}


def test_requests(spark):
    r = Request.parse("Query=web+search&NUM=3&numdocs=4&page=x&know=FALSE&ranker=ql&format=html&other=1")
    assert r == Request(query="web search", num=4, know=False, ranker="ql", format="html")
    docs = spark.createDataFrame([(1, "web search", "T one"), (2, "web pages", None)], "doc_id bigint, text string, title string")
    dic = spark.createDataFrame([("web", 3), ("search", 2)], "word string, cnt bigint")
    engine = Engine(ix.build(docs), dictionary=dic)
    assert engine.search(Request(query="web", ranker="ql")).startswith("2\t") or engine.search(Request(query="web", ranker="ql")).startswith("1\t")
    assert engine.search(Request(query="web saerch", ranker="ql")) == "Did you mean:web search"
    assert engine.search(Request(query="nosuchword", ranker="ql", spellcheck=False)) == "No results retrieved!"
    out = json.loads(engine.search(Request(query="search", ranker="conjunctive", format="html")))
    assert [x["id"] for x in out["results"]] == [1] and out["results"][0]["title"] == "T+one" and out["knowledge"] is None
    with pytest.raises(ValueError):
        engine.search(Request(query="web"))
    assert [x["id"] for x in json.loads(engine.search(Request(query="T", ranker="fullscan", format="html", num=1)))["results"]] == [1]
    assert json.loads(Engine(ix.build(docs), texts=docs).search(Request(query="pages", ranker="ql", format="html")))["results"][0]["snippet"] == "...pages..."
    assert engine.search(Request(query="web", ranker="ql", num=-5, spellcheck=False)) == "No results retrieved!"


@pytest.mark.parametrize("options", ["num=--5", "num=²", "num=1e3", "num=", "page=99999999999", "ranker=other", "format=xml", "know=1"])
def test_bad_options_are_ignored(options):
    assert Request.parse("query=web&" + options) == Request(query="web")


def test_answers_and_expansion(spark):
    from corvidex.operators.knowledge import qa_index

    rows = [(1, "sort list", "how to sort", "use sorted", 3, 10, 0.5, "u/1", "f/1"), (2, "open file", "how to open", "use open", None, None, None, "u/2", "f/2")]
    questions = qa_index(spark.createDataFrame(rows, "doc_id bigint, title string, question string, answer string, vote int, num_views int, page_rank double, url string, file_path string"))
    engine = Engine(questions, questions)
    assert engine.know_response(Request(query="sort", ranker="ql")).startswith("1\tsort list\t") and "use sorted" in engine.know_response(Request(query="sort", ranker="ql"))
    best = json.loads(engine.know_response(Request(query="sort", ranker="ql", format="html")))
    assert best["results"] == [] and {k: best["knowledge"][k] for k in ("id", "url", "filePath", "knowledge", "numviews", "vote", "pagerank")} == {"id": 1, "url": "u/1", "filePath": "f/1", "knowledge": "use+sorted", "numviews": 10, "vote": 3, "pagerank": 0.5}
    assert engine.know_response(Request(query="nosuch", ranker="ql")) == "No results retrieved!"
    lines = engine.prf_response(Request(query="sort", ranker="ql", numterms=2)).splitlines()
    assert len(lines) == 2 and lines[0].startswith("sort\t")


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("en A 3\nen A 4\nbad\n")
    running = start(streaming_views(spark.readStream.text(str(tmp_path / "in")).select(F.col("value").alias("line"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    running.processAllAvailable()
    (tmp_path / "in/b").write_text("de A 1\nde B 2\n")
    running.processAllAvailable()
    running.stop()
    assert {r["name"]: r["views"] for r in current(spark, str(tmp_path / "out")).collect()} == {"A": 8, "B": 2}
    events = spark.createDataFrame([("2015-01-01 00:10:00", "A", 1), ("2015-01-01 00:50:00", "A", 2), ("2015-01-01 01:10:00", "A", 4)], "t string, name string, n int").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted(r["views"] for r in windowed_views(events).collect()) == [3, 4]


def test_one_to_one(spark):
    from corvidex.operators.feedback import one_to_one

    a, b = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "name string, pr double"), spark.createDataFrame([("x", 3), ("y", 4)], "name string, views int")
    assert sorted(tuple(r) for r in one_to_one(a, b, "name").collect()) == [("x", 1.0, 3), ("y", 2.0, 4)]
    for first, second in ((a.limit(1), b), (a, b.where("name = 'x'"))):
        with pytest.raises(Exception, match="not in both tables"):
            one_to_one(first, second, "name").collect()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from corvidex import session

    conf = SimpleNamespace(get=lambda *_: None, contains=lambda _: True)
    sc = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=sc))


def test_registry():
    from corvidex.registry import INDEXES, RANKERS, find

    assert find(INDEXES, "Inverted-Compressed") is ix.build and "ql" in RANKERS
    with pytest.raises(ValueError):
        find(INDEXES, "other")


def test_written_scores_and_contents(spark, tmp_path):
    from corvidex.operators import match

    rows = spark.createDataFrame([("A", 0.5)], "name string, pr double")
    writers.write_scores(rows, str(tmp_path / "pr"))
    assert readers.scores(spark, str(tmp_path / "pr")).collect() == rows.collect()
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in match.same_content(docs, docs.where("doc_id in (1, 3)")).collect()) == [1, 2]
    assert match.distinct_contents(docs).first()["n"] == 2
    (tmp_path / "t").write_text("a\tb\n")
    assert tuple(readers.tsv_documents(spark, str(tmp_path / "t")).first()) == ("a", "a b")
