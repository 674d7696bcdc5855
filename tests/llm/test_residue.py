import pytest
from pyspark.sql import functions as F

from corvidex.llm import residue

CASES = [
    "Please enable JavaScript to view this page.",
    "Home | Tags | Tour | Log in | Forum | Blog\n404 Not Found\nThe page you asked for was not found on this server.\nBack to top",
    "How to sort a list\n\nService temporarily unavailable. The server is down for maintenance.",
    "Lorem ipsum dolor sit amet velit. Sed tempor vitae urna quam.",
    "Your text goes here. Content coming soon. Your text goes here.",
    "Most trees are flat by default. The answer depends on how it stores its trees.\nPosted by {{author}} in {{title}} - {{count}} views.\nWe measured 3 ms for a cold tree.",
    "Dear undefined, your question undefined was answered by undefined on undefined.",
    "Bonjour %%AUTEUR%%, votre question %%TITRE%% a reçu une réponse de %%NOM%%.",
    "Zugriff verweigert. Sie dürfen diese Seite nicht öffnen.",
]
TALK = [
    'The browser shows "404 Not Found" although the template exists. We measured 3 ms for a cold tree. Most trees are flat by default.',
    "Why does my page print `{{answer.text}}` instead of the value? We measured 3 ms for a cold tree. Most trees in it are flat by default.",
    'Set the limit to 3 and store the tree once per query.\necho "Hello ${title}";\nWe measured 3 ms for a cold tree.\n<h1><%= title %></h1>',
    "Undefined variables print as NaN or undefined in Zenvomin. Most trees in it are flat by default. We measured 3 ms for a cold tree.",
    "Access denied usually means that the logger is owned by another account. Most trees are flat by default. We measured 3 ms for it. Set the limit to 3.",
    "Most trees in Delix are flat by default.",
    "naïve café été",
]


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet")
    return residue.fit(residue.training_rows(docs, "doc_id", "text", "source"))


def decide(model, text):
    return model.decide([residue.segments(text)])[0]


@pytest.mark.parametrize("text", CASES)
def test_residue(model, text):
    assert decide(model, text)


@pytest.mark.parametrize("text", TALK)
def test_talk_about_it(model, text):
    assert not decide(model, text)


def test_unseen_hosts(model):
    r = model.report
    assert r["unseen_accuracy"] > 0.98 and min(v for k, v in r.items() if k.startswith("unseen_recall")) > 0.9
    assert {f"unseen_recall_{c}" for c in range(5)} | {"unseen_recall_masked_notice"} <= set(r)
    assert r["unseen_document_accuracy"] > 0.98 and r["unseen_document_recall"] > 0.9


PROBES = [
    "404 Not Found\nThe page you asked for could not be found.",
    "Dear {{ customer_name }}, your order is on its way. Thank you for buying from us.",
    "Sorry, you have been blocked.",
    "Pagina non trovata. La pagina richiesta non esiste.",
    "Ative o JavaScript para ver esta página.",
    "Hello [your name], welcome to ${site}.",
    "Lorem ipsum dolor sit amet consectetur.",
    "TODO: write this section. TBD.",
]
KEPT = [
    "Water is wet. Fire is hot. Ice is cold. 404 Not Found means no route.",
    "Use `{{ name }}` in your template and pass a context with that key.",
    "The server returned 503 because the pool was empty, so we doubled its size and the errors went away.",
    "__init__ is called when an object is made, and [first, second] are its arguments.",
    "x\n\n y",
    "日本語の検索エンジン 한국어 색인",
]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_the_table_fitted_on_does_not_decide(spark, sf, size):
    """What is plainly a notice, filler or field is found whatever the table the model is fitted on."""
    rows = residue.training_rows(spark.read.parquet(f"{sf.replace('sf0.001', size)}/documents.parquet"), "doc_id", "text", "source")
    model = residue.fit(rows)
    assert [decide(model, t) for t in PROBES] == [True] * len(PROBES)
    assert [decide(model, t) for t in KEPT] == [False] * len(KEPT)


@pytest.mark.parametrize("text", PROBES)
def test_probes(model, text):
    assert decide(model, text)


@pytest.mark.parametrize("text", KEPT)
def test_probes_kept(model, text):
    assert not decide(model, text)


def test_seeds_are_always_the_same():
    assert residue.seed_documents() == residue.seed_documents()


@pytest.mark.parametrize(
    ("text", "n"),
    [("Posted by {{x}} in ${y}", 2), ("`{{x}}` stays", 0), ('echo "${x}";', 0), ("{%a b%} %%A%% <<a>> [your name] [[+x]] *|x|* @@x@@ __X__ #{x} <%= x %> ???x??? {0} %s (null)", 14), ("rows[0] and {1, 2}", 0), ("f(x) {\n", 0)],
)
def test_placeholders(text, n):
    assert residue.placeholders(text) == n


LONG = "author_name | default of the profile | trim | capitalise_first_letters | shorten_to_sixty"


@pytest.mark.parametrize("field", ["{{ %s }}", "${%s}", "#{%s}", "{%% %s %%}", "<%% %s %%>", "[[%s]]"])
def test_long_placeholders(model, field):
    text = f"Posted by {field % LONG} on a Monday."
    assert len(LONG) > 60 and residue.placeholders(text) == 1
    assert decide(model, f"Most trees are flat by default. The answer depends on how it stores its trees.\n{text}\nWe measured 3 ms for a cold tree.")


def test_tables(spark, model):
    rows = [(1, CASES[0], "a"), (1, CASES[0], "a"), (2, TALK[0], None), (3, None, "b"), (4, "", "b"), (5, " \n\t", "b"), (None, CASES[3], "b"), (6, "Most trees in it are flat by default. " * 4000 + "Posted by {{x}} in {{y}} - {{z}} views.", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("residue", F.lit("x")).withColumn("id_", F.lit(0))
    got = sorted((str(r["doc_id"]), r["residue"]) for r in residue.detect(docs, model=model).collect())
    assert got == [("1", True), ("1", True), ("2", False), ("3", False), ("4", False), ("5", False), ("6", True), ("None", True)]
    kept = residue.exclude(docs, model=model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]
    assert residue.detect(docs.limit(0)).count() == 0 and residue.exclude(docs.limit(0)).count() == 0
    assert residue.detect(docs.where("doc_id in (3, 4, 5)")).where("residue").count() == 0
