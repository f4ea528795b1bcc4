"""Containment of label sets: one number per set up to 62 labels, arrays beyond; both give the same pairs."""

from polytag.operators import transform as TR


def test_sets_are_compared_as_numbers_or_arrays(spark):
    sets = [(f"{x:06b}", [int(c) for c in f"{x:06b}"], 1 + x % 5) for x in range(64)]
    df = spark.createDataFrame(sets, "bits string, y array<int>, count long")
    freq, rare = df.filter("count > 3"), df.filter("count <= 3")
    want = sorted((r, f, sum(fy), n) for r, ry, m in sets if m <= 3 for f, fy, n in sets if n > 3 and 0 < sum(fy) < sum(ry) and all(v >= u for u, v in zip(fy, ry, strict=True)))
    for labels in (6, 63):
        got = TR._frequent_subsets(rare, freq, labels)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert ("forall" in got._jdf.queryExecution().optimizedPlan().toString()) == (labels > 62)
