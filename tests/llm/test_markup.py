import numpy as np
import pytest
from pyspark.sql import functions as F

from corvidex.llm import markup
from corvidex.llm.trees import train_boosted

PLAIN = [
    "We ran 2 * 3 * 4 tests with max_router_size and min_router_size.",
    "It costs $5 today and $12 next year.",
    "Declare it as List<String> and not as Map<String, Integer>.",
    "If a < b and b > c then the key is fine.",
    "Take rows[0][1] and cols[i] from {1, 2, 3}.",
    "As [note]: says, rows[0][1] hold <a and {{{b}}}.",
    "Compare with x == y, never with x = y.",
    "AT&X and R&D share the variable. C# and F# both fail here, issue #1 is still open.",
    "The file sits in C:\\temp\\new\\section on the old box.",
    "Write a|b or a||b in the menu rule. The value of token__id is about ~60 % lower.",
    "Home | Tags | Tour\nKnown limits\n\nA line.",
    "def f(rows):\n    total = 3\n    return [r for r in rows if r.x > total]",
    "",
]
MARKED = [
    ("<p>One <b>word</b> &amp; more</p>", ["inline"], "One word & more"),
    ("<H2 class='x'>Setup</H2><ul><li>a</li><li>b</ul>", ["heading", "list"], "## Setup\n- a\n- b"),
    ("<pre><code>for (i = 0; i &lt; 3) { *p* }</code></pre>", ["code"], "```\nfor (i = 0; i < 3) { *p* }\n```"),
    ("&lt;h4&gt;Setup&lt;/h4&gt; x", ["heading"], "#### Setup\n x"),
    ("# Title\n\nA **bold** and *it* [link](http://x.example) ![pic](a.png)", ["heading"], "# Title\n\nA bold and it link pic"),
    ("Setup\n-----\ntext", ["heading"], "## Setup\ntext"),
    ("* one\n* two\n\n1. a\n2. b", ["list"], "- one\n- two\n\n1. a\n2. b"),
    ("Call `x = y` now.", ["code"], "Call `x = y` now."),
    ("```sql\nSELECT * FROM t\n* no list\n```\nx", ["code"], "```sql\nSELECT * FROM t\n* no list\n```\nx"),
    ("==Notes==\nSee [[Page|it]] and ''this''.{{Citation needed|date=May}}", ["heading"], "## Notes\nSee it and this."),
    ("# one\n# two", ["list"], "1. one\n2. two"),
    ("<math>a_{i}^2</math> and $x = \\frac{a}{b}$ and $$y$$", ["formula"], "$a_{i}^2$ and $x = \\frac{a}{b}$ and $$y$$"),
    ("\\section{Setup}\nAn \\emph{odd} {\\bf case} \\cite{x}\n\\begin{itemize}\n\\item a\n\\end{itemize}", ["heading", "list"], "## Setup\nAn odd case \n\n- a"),
    ("\\begin{verbatim}\nx = $1\n\\end{verbatim}", ["code"], "```\nx = $1\n```"),
    ("Let \\(a_b\\) be \\[ c^2 \\]", ["formula"], "Let $a_b$ be $$ c^2 $$"),
    ("text\n\n    x.run(3)\n    y.run(4)\n\nmore", ["code"], None),
    ("Done.&nbsp;<!-- ad -->", ["inline"], None),
    ("<math><mi>x</mi><mo>=</mo><mfrac><mi>a</mi><mn>3</mn></mfrac><msup><mi>b</mi><mn>2</mn></msup></math>", ["formula"], "$x=\\frac{a}{3}b^{2}$"),
    ("<math><mfrac><mfrac><mi>a</mi><mi>b</mi></mfrac><msqrt><mi>c</mi></msqrt></mfrac></math>", ["formula"], "$\\frac{\\frac{a}{b}}{\\sqrt{c}}$"),
    ("<ul>\n<li>a</li>\n<li>b</li>\n</ul>\nend", ["list"], "- a\n- b\n\nend"),
    ("See it.~\\ref{sec:one} Now.", ["inline"], "See it. Now."),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>", ["inline"], "a\tb\nc\td"),
    ("{{lang|fr|{{nowrap|b c}}}} is [[X|it]]", ["inline"], "b c is it"),
    ("{{Infobox\n| name = {{PAGENAME}}\n| x = 1\n}}\ntext", ["inline"], "text"),
    ('{| class="wikitable"\n! H !! I\n|-\n| a || b\n|-\n| style="x" | c || d\n|}\nend', ["inline"], "H\tI\na\tb\nc\td\nend"),
    ("1 &frac12; cup &rarr; x &sup2;", ["inline"], "1 ½ cup → x ²"),
    ("See [x][1] and [y](http://a.example/b_(c)).\n\n[1]: http://a.example/", ["inline"], "See x and y."),
    ("<ol><li>a</li><li>b</li></ol>", ["list"], "1. a\n2. b"),
    ('<img src="data:image/png;base64,' + "A" * 5000 + '"> x', ["inline"], " x"),
    ('<div class="a"\n id="b">x</div>', ["inline"], "x"),
]


@pytest.fixture(scope="module")
def model():
    return markup.fit(([m for m, _, _ in MARKED] + PLAIN) * 6)


@pytest.mark.parametrize("text", PLAIN)
def test_what_only_looks_like_markup(model, text):
    (chosen,) = markup.read([text], model)
    assert markup.kinds(chosen) == [] and markup.clean(text, chosen) == text


@pytest.mark.parametrize(("text", "kinds", "clean"), MARKED)
def test_markup(model, text, kinds, clean):
    (chosen,) = markup.read([text], model)
    assert markup.kinds(chosen) == kinds
    if clean is not None:
        assert markup.clean(text, chosen) == clean


def test_held_out_accuracy(spark, sf):
    frames = [(spark.read.parquet(f"{sf}/knowledge.parquet"), "knowledge_id", "knowledge"), (spark.read.parquet(f"{sf}/scored_document.parquet"), "result_id", "snippet")]
    report = markup.fit(markup.training_texts(frames)).report
    assert report["held_accuracy"] > 0.97


def test_the_trees_and_the_decoding_decide(spark, sf):
    """On texts that were not fitted on: the trees decide nodes without evidence, the decoding undoes choices within code and formulas."""
    frames = [(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet"), k, c) for t, k, c in (("knowledge", "knowledge_id", "knowledge"), ("scored_document", "result_id", "snippet"))]
    texts = markup.training_texts(frames)
    model = markup.fit(texts[: len(texts) // 2])
    undecided = both = undone = 0
    shares = {"li": 0.5, "p": 0.9}
    for t in texts[len(texts) // 2 :]:
        nodes = markup.nodes_of(t)
        if not nodes:
            continue
        roots = markup.link(nodes)
        odds = model.trees.log_odds(np.array(markup.features(t, roots, nodes), float))
        certain = markup.certain_languages(t, nodes)
        doubt = [o > 0 for n, o in zip(nodes, odds) if markup.evidence_label(t, n, certain, shares) is None]
        undecided, both = undecided + len(doubt), both | (any(doubt)) | 2 * (not all(doubt))
        undone += len({id(n) for n, o in zip(nodes, odds) if o > 0} ^ {id(n) for n in markup.decode(roots, {id(n): float(o) for n, o in zip(nodes, odds)})})
    assert undecided > 50 and both == 3 and undone > 0


def test_no_choice_contradicts_another(model):
    text = "`a *b* c` <pre>**x** $y_1$ [l](u)</pre> **real**"
    (chosen,) = markup.read([text], model)
    spans = [(n.start, n.end) for n in chosen if n.kind == "code"]
    for n in chosen:
        assert n.kind == "code" or n.family == markup.TAG or not any(a <= n.start and n.end <= b for a, b in spans)
    assert any(n.family == markup.STRONG for n in chosen)


def test_cleaning_again_changes_no_words(model):
    for text, _, _ in MARKED:
        once = markup.clean(text, markup.read([text], model)[0])
        assert [w for w in once.split() if w.isalpha()] == [w for w in markup.clean(once, markup.read([once], model)[0]).split() if w.isalpha()]


def test_tables(spark, model):
    rows = [(1, "<p>x</p>"), (1, "<p>x</p>"), (2, None), (3, ""), (None, "`c` <b>y</b>"), (4, "plain"), (5, "<p>" + "word " * 60_000 + "</p>")]
    df = spark.createDataFrame(rows, "id bigint, t string").withColumn("kind", F.lit(0)).withColumn("text", F.lit(0)).withColumn("id_", F.lit(0))
    assert sorted((str(r["id"]), r["kind"]) for r in markup.structures(df, "id", "t", model).collect()) == [("1", "inline"), ("5", "inline"), ("None", "code")]
    clean = markup.cleaned(df, "id", "t", model).collect()
    assert len(clean) == len(rows) and {r["text"] for r in clean if r["id"] == 1} == {"x"} and [r["text"] for r in clean if r["id"] in (2, 3)] == [None, ""]
    assert markup.structures(df.limit(0), "id", "t").count() == 0 and markup.cleaned(df.limit(0), "id", "t").count() == 0
    assert markup.structures(df.where("id in (2, 3, 4)"), "id", "t").count() == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = train_boosted(x[:2000], y[:2000])
    assert ((trees.log_odds(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.97
