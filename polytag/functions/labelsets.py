"""Column expressions over label sets (``y ARRAY<INT>``) and score arrays.

All functions return ``Column`` objects built from Spark built-ins and
higher-order array functions, so they stay inside whole-stage codegen and work
the same in batch and streaming plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Park-Miller "minimal standard" generator constants (fixed values): a stable,
# partition-independent pseudo-random hash of integer keys that any SQL engine
# can evaluate exactly with 64-bit integers (no overflow: < 2^31 * 48271).
MINSTD_M = 2147483647
MINSTD_A = 48271


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_hash(key, seed: int = 0) -> Column:
    """Integer in [0, 2^31-1) from a non-negative integer key and a seed; two generator steps."""
    k = F.pmod(_c(key).cast("bigint") + F.lit(seed * 7919 + 1), F.lit(MINSTD_M))
    h1 = F.pmod(k * F.lit(MINSTD_A), F.lit(MINSTD_M))
    return F.pmod(h1 * F.lit(MINSTD_A), F.lit(MINSTD_M))


def stable_hash2(key, j, seed: int = 0) -> Column:
    """Hash of a (key, j) pair: hash the key, fold in j, hash again."""
    h = stable_hash(key, seed)
    return stable_hash(F.pmod(h + _c(j).cast("bigint") * F.lit(104729), F.lit(MINSTD_M)), seed)


def bits(y) -> Column:
    """Label set -> bit string ('1','0', '?' for a missing label)."""
    return F.array_join(F.transform(_c(y), lambda x: F.coalesce(x.cast("string"), F.lit("?"))), "")


def from_bits(s) -> Column:
    """Bit string -> label set."""
    return F.transform(F.split(_c(s), ""), lambda c: c.cast("int"))


def size(y) -> Column:
    """Number of set labels (missing counts as not set)."""
    return F.aggregate(_c(y), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def positives(y) -> Column:
    """Indices of set labels, ascending."""
    return F.filter(F.transform(_c(y), lambda x, i: F.when(x == 1, i)), lambda v: v.isNotNull())


def hamming(a, b) -> Column:
    """Positions that differ (arrays of equal length)."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda acc, v: acc + v
    )


def intersection(a, b) -> Column:
    """Elementwise AND; NULL when lengths differ."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), F.zip_with(_c(a), _c(b), lambda x, y: x * y))


SUBSET_STEP, MOST_SUBSET_LABELS = 12, 48


def explode_subsets(df: DataFrame, y: str, out: str = "sub") -> DataFrame:
    """One row per proper non-empty subset (2^s - 2) of the label set in array column ``y``, as a 0/1 array.

    Subset m (1 <= m <= 2^s - 2) keeps the k-th set label iff bit k of m is set.  The masks are 64-bit and made lazily,
    ``SUBSET_STEP`` bits a generator, so no row holds an array of them all; a set of more than
    ``MOST_SUBSET_LABELS`` labels, whose subsets nobody can list, raises."""
    s = F.size(positives(y))
    too_many = F.raise_error(F.format_string("a set of %s labels has too many subsets to list", s.cast("string")))
    x = df.withColumn("_s", F.when(s <= MOST_SUBSET_LABELS, s).otherwise(too_many.cast("int"))).withColumn("_m", F.lit(0).cast("long"))
    for low in range(0, MOST_SUBSET_LABELS, SUBSET_STEP):
        part = F.expr(f"sequence(0L, shiftleft(1L, least(greatest(_s - {low}, 0), {SUBSET_STEP})) - 1)")
        x = x.withColumn("_p", F.explode(part)).withColumn("_m", F.col("_m").bitwiseOR(F.shiftleft("_p", low)))
    x = x.filter("_m > 0 and _m < shiftleft(1L, _s) - 1")
    bit = lambda i: F.call_function("shiftright", F.col("_m"), (F.array_position(positives(y), i) - 1).cast("int")).bitwiseAND(F.lit(1))
    return x.withColumn(out, F.transform(_c(y), lambda v, i: F.when(v == 1, bit(i)).otherwise(0).cast("int"))).drop("_s", "_m", "_p")


def ranks(scores) -> Column:
    """Rank per label (1 = highest score); ties go to the larger label index."""
    s = _c(scores)
    srt = F.array_sort(
        F.transform(s, lambda x, i: F.struct(x.alias("v"), i.alias("j"))),
        lambda a, b: F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1).when(a["j"] > b["j"], -1)
        .when(a["j"] < b["j"], 1).otherwise(0),
    )
    order = F.transform(srt, lambda st: st["j"])
    return F.transform(s, lambda x, i: F.array_position(order, i).cast("int"))


def bipartition(scores, t: float = 0.5, strict: bool = False) -> Column:
    """0/1 per label: score >= t (or > t when ``strict``)."""
    if strict:
        return F.transform(_c(scores), lambda x: (x > F.lit(t)).cast("int"))
    return F.transform(_c(scores), lambda x: (x >= F.lit(t)).cast("int"))


def argmax_hash_tie(scores, key, seed: int = 0) -> Column:
    """Index of the max score; ties broken by a seeded stable hash of (key, j)."""
    s = _c(scores)
    mx = F.array_max(s)
    cand = F.filter(F.transform(s, lambda x, i: F.when(x == mx, i)), lambda v: v.isNotNull())
    best = F.array_min(F.transform(cand, lambda j: F.struct(stable_hash2(key, j, seed).alias("h"), j.alias("j"))))
    return best["j"]


def synthetic_scores(id_col, L: int) -> Column:
    """Deterministic test scores with ties: ((id*31 + j*17) mod 10) / 10."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(L - 1)),
        lambda j: (F.pmod(_c(id_col) * 31 + j * 17, F.lit(10)) / F.lit(10.0)),
    )
