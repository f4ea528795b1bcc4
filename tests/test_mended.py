"""Cases that once lost data: large label sets, deep trees, quoted ARFF cells, odd ids, many labels, a plain master."""

import pytest
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS
from polytag.operators import features as FS
from polytag.operators import learners as LN
from polytag.operators import split as SP
from polytag.operators import transform as TR
from polytag.sources import formats as IO


def test_subsets_of_large_sets_are_all_listed(spark):
    df = spark.createDataFrame([(1, [1] * 17), (2, [0, 1, 1, 0, 1]), (3, [0, 0, 0]), (4, [1])], "id int, y array<int>")
    got = LS.explode_subsets(df, "y")
    assert {r["id"]: r["count"] for r in got.groupBy("id").count().collect()} == {1: 2**17 - 2, 2: 6}
    assert got.filter("id = 1").select("sub").distinct().count() == 2**17 - 2
    assert sorted(r.sub for r in got.filter("id = 2").collect()) == sorted([0, a, b, 0, c] for a in (0, 1) for b in (0, 1) for c in (0, 1) if 0 < a + b + c < 3)
    with pytest.raises(Exception, match="too many subsets"):
        LS.explode_subsets(spark.createDataFrame([([1] * 49,)], "y array<int>"), "y").limit(1).collect()


def test_three_level_tree(spark):
    # leaves a b c d (0-3); m = {a, b}, n = {c}, root = {m, n}; d stands alone
    tree = spark.createDataFrame(
        [("a", 0, "m", 4), ("b", 1, "m", 4), ("c", 2, "n", 5), ("d", 3, None, None), ("m", 4, "root", 6), ("n", 5, "root", 6), ("root", 6, None, None)],
        "label string, idx int, parent string, parent_idx int")
    df = spark.createDataFrame([(1, [0, 1, 0, 0]), (2, [0, 0, 1, 1]), (3, [0, 0, 0, 1])], "id long, y array<int>")
    out = TR.hierarchical(MLFrame(df, ("a", "b", "c", "d"), tree=tree))
    assert out.labels == ("a", "b", "c", "d", "m", "n", "root")
    assert {r.id: r.y[4:] for r in out.df.collect()} == {1: [1, 0, 1], 2: [0, 1, 1], 3: [0, 0, 0]}


ARFF = """% a comment
@relation r
@attribute s {'@x','a,b','%y',foo,'two words'}
@attribute x numeric
@attribute l1 {0,1}
@attribute l2 {0,1}
@data
'a,b', 1.5,1,0
@x,2,0,1
foo,3,?,1
{0 'two words',1 4,3 1}
{2 1}
"%y",?,1,1
"""


def test_arff_rows_with_quotes_signs_and_spaces(spark, tmp_path):
    (tmp_path / "a.arff").write_text(ARFF)
    m = IO.read_arff(spark, str(tmp_path / "a.arff"), n_labels=2)
    got = sorted((r.s, r.x, r.y) for r in m.df.collect() if r.x is not None)
    assert got == sorted([("a,b", 1.5, [1, 0]), ("@x", 2.0, [0, 1]), ("foo", 3.0, [None, 1]), ("two words", 4.0, [0, 1]), ("@x", 0.0, [1, 0])])
    assert m.df.filter("x is null").first().s == "%y" and m.df.select("id").distinct().count() == 6
    # the same ids however the file is cut
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    again = IO.read_arff(spark, str(tmp_path / "a.arff"), n_labels=2)
    assert {tuple(map(str, r)) for r in again.df.collect()} == {tuple(map(str, r)) for r in m.df.collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ids_survive_the_single_model_learner(spark):
    ids = [-5, 9000000000000003, 2**62, 7]
    df = spark.createDataFrame([(i, "u" if k % 2 else "v", [k % 2, 1]) for k, i in enumerate(ids)], "id long, f string, y array<int>")
    m = MLFrame(df, ("a", "b"), ("f",))
    p = LN.predict_include_labels(LN.fit_include_labels(m, df), m, df).collect()
    assert sorted((r.id, r.j) for r in p) == sorted((i, j) for i in ids for j in (0, 1))


def test_pruning_beyond_62_labels_equals_the_mask_path(spark):
    sets = [([0, 1], 5), ([2], 5), ([0], 6), ([3, 4], 5), ([0, 1, 2], 1), ([0, 2, 3, 4], 1), ([1, 3], 1)]

    def frame(L):
        rows, i = [], 0
        for labels, n in sets:
            for _ in range(n):
                rows.append((i, [1 if j in labels else 0 for j in range(L)]))
                i += 1
        return MLFrame(spark.createDataFrame(rows, "id long, y array<int>"), tuple(f"l{j}" for j in range(L)))

    cut = lambda L: sorted((r.bits[:5], r.new_bits[:5], r["count"]) for r in TR.prune_ppt(frame(L), p=3).collect())
    assert cut(70) == cut(5)


def test_bag_weights_have_no_ceiling_and_kinds_are_checked(spark):
    t = SP.poisson1_thresholds()
    assert len(t) > 15 and abs(t[-1] - 1) < 1e-15
    m = MLFrame(spark.createDataFrame([(1, "u", [1, 0]), (2, "v", [0, 1])], "id long, f string, y array<int>"), ("a", "b"), ("f",))
    assert FS.score_multiclass(m, "select_random").count() == 1
    with pytest.raises(ValueError):
        FS.score_multiclass(m, "select_rndom")


def test_labelset_draws_follow_one_rule():
    for L in (4, 6, 30):
        s = LN.rakel_subsets(L, 3)
        assert len({tuple(x) for x in s}) == len(s) and all(len(x) == 3 for x in s)


def test_an_unknown_label_raises(spark):
    from polytag.plans.views import known

    df = spark.createDataFrame([("click",), ("tap",)], "event_type string")
    with pytest.raises(Exception, match="outside its labels"):
        df.select(known("event_type", ("click",))).filter(F.col("event_type") != "").collect()
