"""Measures on the hand-worked fixture F1 (values worked out by hand from the definitions)."""

import pytest

from polytag.operators import evaluate as EV

F1_EXPECTED = {
    "hamming_loss": 0.2, "subset_accuracy": 0.4, "ex_precision": 0.8, "ex_recall": 0.933333,
    "ex_fmeasure": 0.826667, "ex_specificity": 0.6, "ex_accuracy": 0.733333,
    "micro_precision": 0.75, "micro_recall": 0.857143, "micro_fmeasure": 0.8, "micro_specificity": 0.75,
    "macro_precision": 0.777778, "macro_recall": 0.888889, "macro_fmeasure": 0.822222, "macro_specificity": 0.722222,
    "average_precision": 0.875, "one_minus_ap": 0.3, "coverage": 0.8, "one_error": 0.4, "is_error": 0.2,
    "error_set_size": 0.2, "ranking_loss": 0.1, "log_loss": 1.409240, "mse": 0.472, "rmse": 0.687023,
    "map": 0.879630, "gmap": 0.875598, "miap": 0.894444, "gmiap": 0.891414, "macro_auc": 0.833333, "micro_auc": 0.848214,
}


def test_f1_all_measures(f1):
    got = {r["measure"]: r["value"] for r in EV.evaluate(EV.with_predictions(f1)).collect()}
    for k, v in F1_EXPECTED.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k


def test_f1_ranks_tie_to_larger_index(f1):
    r = {row["id"]: row["rank"] for row in EV.with_predictions(f1).select("id", "rank").collect()}
    assert r[2] == [1, 3, 2] and r[3] == [3, 2, 1] and r[4] == [2, 1, 3]


def test_f1_label_confusion(f1):
    c = {r["j"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in EV.label_confusion(EV.with_predictions(f1)).collect()}
    assert c == {0: (2, 1, 1, 1), 1: (2, 1, 0, 2), 2: (2, 0, 0, 3)}


def test_f1_label_ap_auc(f1):
    p = EV.with_predictions(f1)
    ap = {r["j"]: r["ap"] for r in EV.label_ap_curves(p).collect()}
    auc = {r["j"]: r["auc"] for r in EV.label_auc(p).collect()}
    assert [round(ap[j], 6) for j in range(3)] == [0.805556, 0.833333, 1.0]
    assert [round(auc[j], 6) for j in range(3)] == [0.666667, 0.833333, 1.0]


def test_f3_missing_label_row_left_out(spark, f1):
    from pyspark.sql import functions as F

    f3 = f1.withColumn("y", F.when(F.col("id") == 3, F.array(F.lit(1), F.lit(None).cast("int"), F.lit(1))).otherwise(F.col("y")))
    got = {r["measure"]: r["value"] for r in EV.evaluate(EV.with_predictions(f3)).collect()}
    # four complete rows remain; subset accuracy: rows 2 and 5? row 2 right, row 5 wrong, row 1 right, row 4 wrong
    assert got["subset_accuracy"] == pytest.approx(0.5)
