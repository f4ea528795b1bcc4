"""Label statistics and label dependence.

Design for scale:
* per-label totals are one aggregation with L partial sums (map-side combine);
* pair counts come from exploding only the *positive* pairs of each row and a
  ``groupBy(i, j)`` with partial aggregation, so the shuffle is proportional to
  co-occurrences, not to rows x L^2;
* the L x L grid is generated from the single totals row by two explodes
  (label-sized), never from a join of row-sized data;
* only label-sized results are ever brought to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS


def labelset_counts(mlf: MLFrame) -> DataFrame:
    """(y, bits, n_labels, count): rows per distinct label set."""
    g = mlf.df.groupBy(mlf.y_col).agg(F.count(F.lit(1)).alias("count"))
    return g.select(
        F.col(mlf.y_col).alias("y"), LS.bits(mlf.y_col).alias("bits"), LS.size(mlf.y_col).alias("n_labels"), "count"
    )


def label_totals(mlf: MLFrame) -> DataFrame:
    """One row: N and n1 ARRAY<BIGINT> (rows having label j; missing counts as 0)."""
    y = F.col(mlf.y_col)
    return mlf.df.agg(
        F.count(F.lit(1)).alias("N"),
        F.array(*[F.sum(F.coalesce(y[j], F.lit(0))).cast("bigint") for j in range(mlf.L)]).alias("n1"),
    )


def label_priors(mlf: MLFrame) -> DataFrame:
    """(j, label, n, prior)."""
    names = F.array(*[F.lit(n) for n in mlf.labels])
    t = label_totals(mlf)
    return t.select(F.col("N").alias("total"), names.alias("names"), F.posexplode("n1").alias("j", "n")).select(
        F.col("j").cast("int").alias("j"), F.get("names", F.col("j")).alias("label"), "n",
        (F.col("n") / F.col("total")).alias("prior"),
    )


def label_cardinality(mlf: MLFrame) -> DataFrame:
    """(n_examples, cardinality, density)."""
    c = mlf.df.agg(F.count(F.lit(1)).alias("n_examples"), F.avg(LS.size(mlf.y_col)).alias("cardinality"))
    return c.select("n_examples", "cardinality", (F.col("cardinality") / F.lit(mlf.L)).alias("density"))


def cardinality_histogram(mlf: MLFrame) -> DataFrame:
    """(c, n): rows with exactly c labels, c = 0..L, zeros kept."""
    counts = mlf.df.groupBy(LS.size(mlf.y_col).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    grid = mlf.df.sparkSession.range(mlf.L + 1).select(F.col("id").cast("int").alias("c"))
    return F.broadcast(grid).join(counts, "c", "left").select("c", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def pair_counts(mlf: MLFrame) -> DataFrame:
    """(i, j, n11) for i < j with both labels set; pairs that never co-occur are absent."""
    pos = mlf.df.select(LS.positives(mlf.y_col).alias("p"))
    pairs = pos.select("p", F.explode("p").alias("i")).select(
        "i", F.explode(F.filter("p", lambda x: x > F.col("i"))).alias("j")
    )
    return pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n11"))


def pair_table(mlf: MLFrame, upper_only: bool = False, n11: DataFrame | None = None) -> DataFrame:
    """(i, j, N, n1i, n1j, n11) for every label pair; grid built by exploding the one totals row."""
    t = label_totals(mlf)
    g = t.select("N", "n1", F.posexplode("n1").alias("i", "n1i")).select(
        "N", "i", "n1i", F.posexplode("n1").alias("j", "n1j")
    )
    g = g.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "N", "n1i", "n1j")
    if upper_only:
        g = g.filter(F.col("i") < F.col("j"))
    pc = pair_counts(mlf) if n11 is None else n11
    # symmetric lookup: the pair table stores i < j only
    sym = pc.unionByName(pc.select(F.col("j").alias("i"), F.col("i").alias("j"), "n11"))
    out = g.join(sym, ["i", "j"], "left")
    return out.select(
        "i", "j", "N", "n1i", "n1j",
        F.when(F.col("i") == F.col("j"), F.col("n1i")).otherwise(F.coalesce("n11", F.lit(0))).cast("bigint").alias("n11"),
    )


def label_cooccurrence(mlf: MLFrame) -> DataFrame:
    """(i, j, n) upper-triangular pair counts, zeros kept."""
    return pair_table(mlf, upper_only=True).select("i", "j", F.col("n11").alias("n"))


def _phi_expr() -> F.Column:
    n, a1, b1, d = F.col("N"), F.col("n1i"), F.col("n1j"), F.col("n11")
    # a: both 0, b: i=1 & j=0, c: i=0 & j=1, d: both 1
    b = a1 - d
    c = b1 - d
    a = n - a1 - b1 + d
    num = a.cast("double") * d.cast("double") - b.cast("double") * c.cast("double")
    den = F.sqrt((a + b).cast("double") * (c + d).cast("double") * (a + c).cast("double") * (b + d).cast("double"))
    # a constant label makes the denominator 0: phi undefined (NULL)
    return F.when(den != 0, num / den)


def label_phi(mlf: MLFrame) -> DataFrame:
    """(i, j, phi) full L x L matrix; NULL where a label is constant."""
    return pair_table(mlf).select("i", "j", "N", _phi_expr().alias("phi"))


def phi_histogram(mlf: MLFrame, bins: int = 20) -> DataFrame:
    """(bin, n): upper-triangle phi values in equal bins over [-1, 1]."""
    p = label_phi(mlf).filter(F.col("i") < F.col("j")).filter(F.col("phi").isNotNull())
    b = F.least(F.floor((F.col("phi") + 1) * (bins / 2.0)), F.lit(bins - 1)).cast("int")
    return p.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def uncorrelated_labels(mlf: MLFrame, bound: float = 0.1) -> DataFrame:
    """(i, j) with |phi(i, j)| <= bound."""
    return label_phi(mlf).filter(F.abs("phi") <= F.lit(bound)).select("i", "j")


def top_correlated_labels(mlf: MLFrame, k: int = 3) -> DataFrame:
    """(i, pos, j): the k largest |phi| per label (itself included), ties to the larger index,
    then the meta-class index L in position k + 1."""
    p = label_phi(mlf)
    w = Window.partitionBy("i").orderBy(F.abs("phi").desc_nulls_last(), F.col("j").desc())
    top = p.select("i", "j", F.row_number().over(w).alias("pos")).filter(F.col("pos") <= k)
    meta = mlf.df.sparkSession.range(mlf.L).select(
        F.col("id").cast("int").alias("i"), F.lit(mlf.L).cast("int").alias("j"), F.lit(k + 1).alias("pos")
    )
    return top.select("i", F.col("pos").cast("int").alias("pos"), "j").unionByName(
        meta.select("i", F.col("pos").cast("int").alias("pos"), "j")
    )


def phi_diagram(mlf: MLFrame, step: float = 0.05) -> DataFrame:
    """(step_idx, bound, avg_correlated): mean number of labels with |phi| > bound.

    Bounds are k * step for integer k (no float accumulation); NULL phi counts as correlated.
    """
    n_steps = int(math.floor(1.0 / step + 1e-9))
    p = label_phi(mlf).select(F.abs("phi").alias("a"))
    steps = F.sequence(F.lit(0), F.lit(n_steps))
    x = p.select("a", F.explode(steps).alias("k"))
    bound = F.col("k") * F.lit(step)
    g = x.groupBy("k").agg(F.count(F.when(F.col("a") <= bound, 1)).alias("unc"))
    L = mlf.L
    return g.select(
        F.col("k").cast("int").alias("step_idx"), (F.col("k") * F.lit(step)).alias("bound"),
        ((F.lit(L * L) - F.col("unc")) / F.lit(L)).alias("avg_correlated"),
    )


def chi2_pairs(mlf: MLFrame, critical: float = 6.635) -> DataFrame:
    """(i, j, score, dependent) for i < j: score = phi^2 * N, undefined -> 0.0001."""
    p = label_phi(mlf).filter(F.col("i") < F.col("j"))
    score = F.coalesce(F.col("phi") * F.col("phi") * F.col("N"), F.lit(0.0001))
    return p.select("i", "j", score.alias("score"), (score > F.lit(critical)).alias("dependent"))


def label_mutual_information(mlf: MLFrame) -> DataFrame:
    """(i, j, mi) for i < j; natural log over the observed cells, rounded half-up to 3 places."""
    t = pair_table(mlf, upper_only=True)
    n = F.col("N").cast("double")
    n11 = F.col("n11")
    n10 = F.col("n1i") - n11
    n01 = F.col("n1j") - n11
    n00 = F.col("N") - F.col("n1i") - F.col("n1j") + n11
    px1, py1 = F.col("n1i") / n, F.col("n1j") / n
    px0, py0 = 1 - px1, 1 - py1

    def term(c, px, py):
        pxy = c / n
        return F.when(c > 0, pxy * F.log(pxy / (px * py))).otherwise(F.lit(0.0))

    mi = term(n11, px1, py1) + term(n10, px1, py0) + term(n01, px0, py1) + term(n00, px0, py0)
    return t.select("i", "j", F.round(mi, 3).alias("mi"))


def label_cosine_distance(mlf: MLFrame) -> DataFrame:
    """(i, j, d, cos) on +-1 label columns: cos = 1 - 2*hamming/N, d = -ln|cos| (cos 0 -> smallest double)."""
    t = pair_table(mlf)
    ham = F.col("n1i") + F.col("n1j") - 2 * F.col("n11")
    cos = F.lit(1.0) - F.lit(2.0) * ham / F.col("N")
    cos0 = F.when(cos == 0, F.lit(4.9e-324)).otherwise(cos)
    return t.select("i", "j", (-F.log(F.abs(cos0))).alias("d"), cos0.alias("cos"))


def ml_summary(mlf: MLFrame) -> DataFrame:
    """One row: examples, predictors (nominal / numeric), labels, cardinality, density, distinct label sets."""
    schema = {f.name: f.dataType.simpleString() for f in mlf.df.schema.fields}
    nominal = sum(1 for f in mlf.features if schema.get(f) == "string")
    numeric = len(mlf.features) - nominal
    c = mlf.df.agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.avg(LS.size(mlf.y_col)).alias("cardinality"),
        F.count_distinct(F.col(mlf.y_col)).alias("n_labelsets"),
    )
    return c.select(
        "n_examples", F.lit(len(mlf.features)).alias("n_predictors"), F.lit(nominal).alias("n_nominal"),
        F.lit(numeric).alias("n_numeric"), F.lit(mlf.L).alias("n_labels"), "cardinality",
        (F.col("cardinality") / F.lit(mlf.L)).alias("density"), "n_labelsets",
    )
