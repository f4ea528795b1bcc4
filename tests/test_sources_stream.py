"""File formats and streaming = batch."""

import os

from polytag.sources import formats as IO

HERE = os.path.dirname(os.path.abspath(__file__))


def test_arff_dense_sparse_and_xml(spark):
    names, edges = IO.read_label_xml(spark, os.path.join(HERE, "data/labels.xml"))
    assert names == ["L1", "L2", "L3"] and ("L2", "L1") in edges
    m = IO.read_arff(spark, os.path.join(HERE, "data/tiny.arff"), labels=names)
    rows = sorted((r["f1"], r["f2"], tuple(r["y"])) for r in m.df.collect())
    # a {1,0} declaration decides by value, and an omitted sparse cell takes the first declared
    # value ('1' for L2)
    assert rows == [(0.5, "red", (1, 0, 1)), (1.5, "blue", (0, 1, 0)), (2.5, "blue", (0, 1, 1))]


def test_libsvm_multilabel(spark):
    m = IO.read_libsvm_ml(spark, os.path.join(HERE, "data/tiny.svm"))
    rows = sorted((tuple(r["y"]), r["x1"], r["x2"], r["x3"]) for r in m.df.collect())
    assert m.L == 3
    assert rows == [((0, 0, 0), 0.0, 0.0, 4.0), ((0, 1, 0), 0.0, 2.0, 0.0), ((1, 0, 1), 0.5, 0.0, 1.0)]


def test_hier_cell_sets_ancestors(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("id,class\n1,a/b@c\n")
    df, names = IO.read_hier_csv(spark, str(p))
    assert sorted(df.first()["labels"]) == ["a", "a/b", "c"]


def test_stream_scoring_equals_batch(spark, tmp_path):
    from polytag.frame import MLFrame
    from polytag.operators import learners as LN
    from polytag.streaming import stream as STM

    rows = [(i, "a" if i % 3 else "b", [i % 2, int(i % 3 == 0)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, f string, y array<int>")
    m = MLFrame(df, ("p", "q"), ("f",))
    model = LN.fit_br(m)
    src = str(tmp_path / "in")
    STM.stage_files(df.select("id", "f"), src, parts=3)
    out = STM.score_stream(spark, src, df.select("id", "f").schema, lambda b: LN.predict_br(model, b), str(tmp_path / "out"))
    batch = LN.predict_br(model, df.select("id", "f"))
    key = lambda d: sorted((r["id"], r["j"], round(r["conf"], 9), r["bip"]) for r in d.collect())
    assert key(out) == key(batch)


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0 and set(E.oracle_sql()) <= set(E.queries())
    assert "score" in df.columns
