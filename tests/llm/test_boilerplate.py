import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvidex.llm import boilerplate as bp
from corvidex.llm.features import BUCKETS, Softmax

PAGE = """Home | Tags | Tour | Log in
We use cookies to improve your visit. Accept all | Decline
Known limits
The answer depends on how the site stores its trees. Most trees in it are flat by default.
Search and sign up share one form, which confused our tests.

* Why is my index silent after append()?
for (int i = 0; i < 4; i++) {
Related: How to open a file in Moskigri / Why is my socket cold after open()?
© 2012 Moskigri. All rights reserved.
Back to top"""


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/scored_document.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return bp.fitted(pages)


def test_held_out_accuracy(model):
    """Sites that were not fitted on; the labels rest on counts over all pages, which the features don't hold."""
    assert model.report["unseen_accuracy"] > 0.98
    assert model.report["unseen_recall_body"] > 0.95 and model.report["unseen_recall_frame"] > 0.95


def test_a_page(model):
    p = bp.Pages([(PAGE, "data/corpus/moskigri/x")])
    body = bp.body_probability(p, model) >= 0.5
    assert [n for n, b in zip(p.numbers, body) if not b] == [0, 1, 8, 9, 10]


def test_messages_decide(model, pages):
    """Without the messages other lines come out, and lines of pages that were not fitted on come out worse."""
    rows = [(r["snippet"], r["filePath"]) for r in pages.where("snippet IS NOT NULL AND result_id % 7 = 3").select("snippet", "filePath").collect()]
    p = bp.Pages(rows)
    full, alone = bp.body_probability(p, model) >= 0.5, bp.body_probability(p, model, False) >= 0.5
    assert (full != alone).sum() >= len(full) / 2000
    # a line of one word goes with its neighbours: a heading over text, an entry among entries
    low = "zzword"
    text = bp.Pages([(f"Setup\n{low}\nThe answer depends on how it stores its trees. Most trees are flat.", None), (f"Tags\nHelp\n{low}\nUsers\nHome\nLog in\nSign up\nArchive", None)])
    p_line = bp.body_probability(text, model)
    assert p_line[1] > p_line[5]
    alone = bp.body_probability(text, model, False)
    assert alone[1] == pytest.approx(alone[5])


def test_labels_need_no_phrases():
    """What recurs over pages is frame, unless it also stands in paragraphs or is marked up as a heading."""
    rows = [(f"Menu here\nSetup\n{w} one is slow. The same note. And {w} is here.\nThe same note.\nSponsor of the day {w}", "x/corpus/a/b", None) for w in ("ab", "cd", "ef", "gh", "ij", "kl")]
    rows.append(("<h2>Setup</h2>\nx y is fine.", "x/corpus/a/c", None))
    keys = set().union(*(bp.page_keys(t, bp.site_of(p), bp.wanted_keys(rows), {}) for t, p, _ in rows))
    counts: dict = {k: sum(k in bp.page_keys(t, bp.site_of(p), {k}, {}) for t, p, _ in rows) for k in keys}
    p = bp.Pages([r[:2] for r in rows[:1]])
    label, weight, why = bp.labels(p, counts, len(rows))
    assert why == ["recurs", "within", "single", "within", "opening"] and list(label) == [1, 0, 0, 0, 1]


def test_messages_are_exact():
    rng = np.random.default_rng(4)
    half = lambda: (lambda t: t / t.sum(axis=1, keepdims=True))(rng.random((2, 2)) + 0.1)
    many = lambda n: np.stack([half() for _ in range(n)])
    model = bp.BodyModel(Softmax(np.zeros((BUCKETS, 2), np.float32), np.zeros((bp.DENSE + 1, 2), np.float32)), np.array([0.4, 0.6]), many(4), many(7), many(bp.KINDS), np.array([0.3, 0.7]))
    p = bp.Pages([("Home | Tags | Help\nOne label", None), ("", None), ("x = 1;\nIt is so. It is not.", None)])
    evidence = np.log(rng.random((len(p.segments), 2)) + 0.05)
    got = bp.marginals(evidence, p, model)
    lines, blocks, pages = len(p.lines), len(p.kinds), 3
    assert (lines, blocks) == (4, 4)
    own = np.zeros((lines, 2))  # segments summed out by hand
    for i in range(lines):
        for s in (0, 1):
            own[i, s] = np.prod([sum(model.segment_given_line[min(p.sizes[i], 3)][s, k] * np.exp(evidence[j, k]) for k in (0, 1)) for j in np.flatnonzero(p.owner == i)])
    weight = np.zeros((lines, 2))
    for root in itertools.product((0, 1), repeat=pages):
        for block in itertools.product((0, 1), repeat=blocks):
            for line in itertools.product((0, 1), repeat=lines):
                v = np.prod([model.page[r] for r in root]) * np.prod([model.block_given_page[p.kinds[b]][root[p.pages[b]], block[b]] for b in range(blocks)])
                v *= np.prod([model.line_given_block[p.shapes[i]][block[p.blocks[i]], line[i]] * own[i, line[i]] for i in range(lines)])
                for i in range(lines):
                    weight[i, line[i]] += v
    assert got == pytest.approx(weight[:, 0] / weight.sum(axis=1))


def test_tables(spark, model):
    rows = [(1, PAGE, "./data/stack//Moskigri/9"), (1, PAGE, "./data/stack//Moskigri/9"), (2, None, None), (3, "", None), (4, " \n\t\n", None), (None, "Back to top", None), (5, "x " * 100_000, None), (6, "Tags\n" * 500, None)]
    df = spark.createDataFrame(rows, "result_id bigint, snippet string, filePath string").withColumn("line_no", F.lit("a")).withColumn("body", F.lit(0)).withColumn("id_", F.lit(0)).withColumn("page_", F.lit(0))
    got = bp.frame_lines(df, model=model).collect()
    assert sorted(r["line_no"] for r in got if r["result_id"] == 1) == [0, 1, 8, 9, 10]
    assert [r["line_no"] for r in got if r["result_id"] is None] == [0] and not [r for r in got if r["result_id"] in (2, 3, 4)]
    assert len([r for r in got if r["result_id"] == 6]) == 500
    bodies = bp.main_body(df, model=model).collect()
    assert len(bodies) == len(rows) and [r["body"] for r in bodies if r["result_id"] in (2, 3, 4)] == [None, "", ""]
    assert next(r["body"] for r in bodies if r["result_id"] == 1).startswith("Known limits\nThe answer")
    # without a model one is fitted on the table itself, however little there is
    assert bp.frame_lines(df.limit(0)).count() == 0 and bp.main_body(df.limit(0)).count() == 0
    assert bp.frame_lines(df.where("result_id in (2, 3, 4)")).count() == 0
    assert bp.main_body(df).count() == len(rows)


@pytest.mark.parametrize(("path", "site"), [("data/corpus/kasolmo/x", "kasolmo"), ("./data//stack//Ixost/1", "ixost"), ("x", ""), (None, "")])
def test_sites(path, site):
    assert bp.site_of(path) == site
