import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvidex.functions import text as tx
from corvidex.functions.query import Query, original_terms, parse_query, shape, stem
from corvidex.operators.stemmer import full_stem

STEMS = dict(
    caresses="caress", ponies="poni", ties="ti", caress="caress", cats="cat", feed="feed", agreed="agree", disabled="disable", matting="mat", mating="mate", meeting="meet", milling="mill", messing="mess", meetings="meet", this="thi", sky="sky", hoping="hope", hopping="hop", sing="sing", ing="ing",
) | {"is": "is", "": "", "a": "a"}


def test_stems_of_columns_and_words(spark):
    words = spark.createDataFrame([(w,) for w in STEMS] + [(None,)], "w string")
    got = {r["w"]: r["s"] for r in tx.with_stem(words, "w", "s").collect()}
    assert got.pop(None) is None
    assert got == STEMS
    assert {w: stem(w) for w in STEMS} == STEMS


def test_stem_of_columns_is_stem_of_words_on_many_words(spark):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("aeiouybdlnrstzwx") for _ in range(rng.randint(0, 7))) + rng.choice(["", "s", "es", "ies", "sses", "ed", "eed", "ing", "ings", "ating", "bled", "izing"]) for _ in range(4000)]
    got = tx.with_stem(spark.createDataFrame([(w,) for w in words], "w string"), "w", "s").collect()
    assert [(r["w"], r["s"]) for r in got if r["s"] != stem(r["w"])] == []


def test_terms_of_documents_are_those_of_columns(spark):
    import random

    from corvidex.functions.query import document_term

    rng = random.Random(6)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) + rng.choice(["", "s", "ed", "eed", "ing", "!", "'s"]) for alphabet in ("aeioybdlnrst.-", "yya", "éß中😀ay\u00a0") for _ in range(1500)]
    got = tx.positions(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id bigint, text string")).collect()
    assert len(got) > 4000 and [(words[r["doc_id"]], r["term"]) for r in got if r["term"] != document_term(words[r["doc_id"]])] == []


@given(st.text("abcdefghijklmnopqrstuvwxyz", max_size=12))
@settings(max_examples=200, deadline=None)
def test_stem_keeps_the_beginning(word):
    s = stem(word)
    assert len(s) <= len(word) + 1 and (s[:-1] == word[: len(s) - 1])
    assert set(shape(word)) <= {"v", "c"}


def test_full_stems():
    given = "relational conditional digitizer vietnamization hopefulness electrical adjustment adoption probate rate controll happy".split()
    assert [full_stem(w) for w in given] == "relat condit digit vietnam hope electr adjust adopt probat rate control happi".split()


def test_positions(spark):
    rows = [(1, "The  CATS, http://x.example ... ran"), (2, ""), (3, None), (4, "   \t\n"), (5, "x" * 100_000 + " b")]
    got = tx.positions(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id", "pos").collect()
    assert [(r["doc_id"], r["term"], r["pos"]) for r in got] == [(1, "the", 0), (1, "cat", 1), (1, "", 2), (1, "ran", 3), (5, "x" * 100_000, 0), (5, "b", 1)]


@pytest.mark.parametrize(
    ("raw", "tokens"),
    [
        ("web search", ("web", "search")),
        ('"new york city" hotels', ("new york city", "hotel")),
        ('"Running"', ("Running",)),
        ("the web", ("web",)),
        ('"unclosed words', ("unclos", "word")),
        ("", ()),
        (None, ()),
        ('a "the cats" b', ("the cat", "b")),
    ],
)
def test_queries(raw, tokens):
    assert parse_query(raw).tokens == tokens


def test_query_parts():
    q = Query("", ("a b", "c", "c"))
    assert q.terms == ["a", "b", "c", "c"] and q.phrases == [["a", "b"]] and q.counts() == {"a": 1, "b": 1, "c": 2} and str(q) == "a b c c"
    assert original_terms("C# and  ASP.net!") == ["c", "and", "aspnet"]


def test_html(spark):
    page = "<HTML><title> A\n b </title><script>if (a</b>) x</script><!-- <p>no</p> --><body>x &lt;y&gt; <b>z</b>&nbsp;&amp;amp;</body>"
    r = spark.createDataFrame([(page,), ("",), (None,)], "h string").select(tx.html_title(F.col("h")).alias("t"), tx.html_text(F.col("h")).alias("x")).collect()
    assert r[0]["t"] == "A b" and r[0]["x"] == "A b x <y> z &amp;"
    assert (r[1]["t"], r[1]["x"]) == ("", "") and (r[2]["t"], r[2]["x"]) == (None, None)


def test_snippets(spark):
    df = spark.createDataFrame([("One two three " * 30,), ("nothing",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.query_snippet(F.col("t"), ["two", "one"], 20)).collect()]
    assert got[0] == "...two three ...one two th..." and got[1] == "nothing..." and got[2] is None
    assert df.select(tx.query_snippet(F.col("t"), [])).first()[0].endswith("...")


def test_edits(spark):
    got = spark.createDataFrame([("",), ("a",), ("ab",)], "w string").select("w", tx.edits1(F.col("w")).alias("e")).collect()
    assert [(r["w"], len(r["e"])) for r in got] == [("", 26), ("a", 79), ("ab", 133)]
    assert {"b", "a", "ba", "aab", "cb"} <= set(got[2]["e"])


def test_entities(spark):
    """All names and numbers; what is none stays; each is read once."""
    cases = {"a &frac12; &#8364; &#x1F600; &rarr;": "a ½ € 😀 →", "&amp;lt; R&D &bogus; &amp": "&lt; R&D &bogus; &amp", "&#0;&#xD800;&#1114112;": "&#0;&#xD800;&#1114112;", "x&nbsp;y": "x y", "": "", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.html_text(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in rows} == cases
