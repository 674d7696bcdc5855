import numpy as np

from corvidex.llm import markup, models, residue


def test_a_saved_model_decides_alike(spark, tmp_path):
    fitted = residue.fit([("Most trees in Delix are flat by default. We measured 3 ms for a cold tree.", "a")])
    models.save(spark, fitted, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    docs = [residue.segments(t) for t in ("404 Not Found", "Water boils at 100 degrees. It has two modes.", "")]
    assert again.decide(docs) == fitted.decide(docs) and again.report == fitted.report
    frame = spark.createDataFrame([(1, "404 Not Found", None)], "doc_id bigint, text string, source string")
    assert [r["residue"] for r in residue.detect(frame, model=again).collect()] == [True]
    trees = markup.fit(["<b>x</b> &amp; `y` and List<String> z", "plain <T> a"] * 8)
    models.save(spark, trees, str(tmp_path / "m"))
    x = np.zeros((3, markup.FEATURES))
    assert (models.load(spark, str(tmp_path / "m")).trees.log_odds(x) == trees.trees.log_odds(x)).all()
