"""Multi-target regression.

The base regressor is ordinary least squares.  Single targets, chains, ensembles of chains, stacks and target combinations
come from the cross-products of one scan (``gram``), keyed by fold and member, however many links, folds or members
there are.  Predictions are column expressions with literal coefficients, so scoring is a projection with no shuffle.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytag.functions.labelsets import MINSTD_M, stable_hash, stable_hash2
from polytag.operators import gram as GR
from polytag.operators.split import poisson1_thresholds


def _targets(target: str, n: int) -> list[Column]:
    return [F.col(target)[j] for j in range(n)]


def poisson_weight(member: int, seed: int, id_col: str = "id") -> Column:
    """Poisson(1) weight of a row in a member's bag, from a hash of (row, member): no row moves."""
    u = stable_hash2(id_col, F.lit(member), seed) / F.lit(float(MINSTD_M))
    return sum(F.when(u >= F.lit(t), 1).otherwise(0) for t in poisson1_thresholds()).cast("double")


def part_weight(member: int, seed: int, pct: float, id_col: str = "id") -> Column:
    """1 for the rows of a member's ``pct`` % part (without replacement), else 0."""
    u = stable_hash2(id_col, F.lit(member), seed) / F.lit(float(MINSTD_M))
    return (u * 100 < F.lit(pct)).cast("double")


def family_grams(train: DataFrame, features: list[str], n_targets: int, mode: str = "true", folds: int = 3, seed: int = 1,
                 target: str = "target", members: tuple[Column, ...] = (), id_col: str = "id") -> tuple[GR.Grams, list[int]]:
    """The cross-products that a mode needs, and the members that draw its samples: folds for ``cv``, a Poisson(1) bag per link or target for ``sample``."""
    fold = F.pmod(stable_hash(id_col, seed), F.lit(folds)) if mode == "cv" else None
    main = list(members) or [F.lit(1.0)]
    bags = [poisson_weight(len(main) + k, seed, id_col) for k in range(n_targets)] if mode == "sample" else []
    g = GR.grams(train, features, _targets(target, n_targets), fold, [*main, *bags])
    return g, list(range(len(main), len(main) + len(bags)))


def single_target(df: DataFrame, features: list[str], n_targets: int, train: DataFrame, target: str = "target") -> tuple[np.ndarray, DataFrame]:
    """One regressor per target; returns (coefficients, df + pred ARRAY<DOUBLE>)."""
    g = GR.grams(train, features, _targets(target, n_targets))
    coef = GR.combinations(g, np.eye(n_targets))
    return coef, df.withColumn("pred", GR.predicted(coef, features))


def regressor_chain(df: DataFrame, features: list[str], chain: list[int], train: DataFrame, mode: str = "true", folds: int = 3,
                    seed: int = 1, target: str = "target") -> DataFrame:
    """Regressor chain: target chain[k] is fitted on the features and the earlier targets, which enter at training time as ``mode`` says
    (their true values, their training predictions, out-of-fold predictions of ``folds`` folds, or predictions of a model fitted on a
    bootstrap sample) and at prediction time as predicted."""
    g, bags = family_grams(train, features, len(chain), mode, folds, seed, target)
    return df.withColumn("pred", GR.predicted(GR.chain(g, chain, mode, samples=bags), features))


def chain_simple(df: DataFrame, features: list[str], chain: list[int], train: DataFrame, target: str = "target") -> DataFrame:
    """Regressor chain on the *true* earlier targets."""
    return regressor_chain(df, features, chain, train, "true", target=target)


def chain_cv(df: DataFrame, features: list[str], chain: list[int], train: DataFrame, folds: int = 3, seed: int = 1,
             target: str = "target") -> DataFrame:
    """Regressor chain on out-of-fold predictions of the earlier targets (CV meta mode)."""
    return regressor_chain(df, features, chain, train, "cv", folds, seed, target)


def random_chains(n_targets: int, m: int, seed: int = 1) -> list[list[int]]:
    """m distinct random target orders (at most n!)."""
    import math

    rnd = random.Random(seed)
    m = min(m, math.factorial(n_targets))
    seen, out = set(), []
    while len(out) < m:
        c = list(range(n_targets))
        rnd.shuffle(c)
        if tuple(c) not in seen:
            seen.add(tuple(c))
            out.append(c)
    return out


def ensemble_of_chains(df: DataFrame, features: list[str], n_targets: int, train: DataFrame, m: int = 5, seed: int = 1,
                       target: str = "target", sampling: str = "bag", pct: float = 67.0, mode: str = "true", folds: int = 3) -> DataFrame:
    """Mean of m regressor chains with random orders (at most n!), each on its own sample of the training rows: a Poisson(1)
    ``bag``, a ``part`` of ``pct`` % without replacement, or ``all`` rows.  All members come from one scan."""
    chains = random_chains(n_targets, m, seed)
    draw = {"bag": lambda i: poisson_weight(i, seed), "part": lambda i: part_weight(i, seed, pct), "all": lambda i: F.lit(1.0)}[sampling]
    g, bags = family_grams(train, features, n_targets, mode, folds, seed, target, tuple(draw(i) for i in range(len(chains))))
    coef = sum(GR.chain(g, c, mode, member=i, samples=bags) for i, c in enumerate(chains)) / len(chains)
    return df.withColumn("pred", GR.predicted(coef, features))


def stacking(df: DataFrame, features: list[str], n_targets: int, train: DataFrame, target: str = "target", mode: str = "train",
             folds: int = 3, seed: int = 1, attributes: bool = True) -> DataFrame:
    """Two-stage stacking: stage 1 per target on the features; stage 2 per target on the features (unless ``attributes`` is off) and
    every other target's stage-1 value, which enters at training time as ``mode`` says (see ``regressor_chain``)."""
    g, bags = family_grams(train, features, n_targets, mode, folds, seed, target)
    return df.withColumn("pred", GR.predicted(GR.stack(g, mode, samples=bags, attributes=attributes), features))


def target_mixes(r: int, n_targets: int, non_zero: int = 2, seed: int = 1) -> np.ndarray:
    """r sparse target mixes: each target used as evenly as possible, weights in [0, 1)."""
    rnd = random.Random(seed)
    M = np.zeros((r, n_targets))
    use = [0] * n_targets
    for i in range(r):
        picks = sorted(range(n_targets), key=lambda j: (use[j], rnd.random()))[:non_zero]
        for j in picks:
            use[j] += 1
            M[i, j] = rnd.random()
    return M


def random_linear_combinations(df: DataFrame, features: list[str], n_targets: int, train: DataFrame, r: int = 6,
                               non_zero: int = 2, seed: int = 1, target: str = "target") -> DataFrame:
    """Fit r random sparse target mixes, then recover the targets from the predicted mixes by least squares (pseudo-inverse)."""
    M = target_mixes(r, n_targets, non_zero, seed)
    g = GR.grams(train, features, _targets(target, n_targets))
    return df.withColumn("pred", GR.predicted(np.linalg.pinv(M) @ GR.combinations(g, M), features))


def compare(df: DataFrame, features: list[str], n_targets: int, train: DataFrame, chain: list[int], target: str = "target") -> dict[str, DataFrame]:
    """Predictions of single targets, a chain on true targets and a stack on training predictions, from one scan of the training rows."""
    g = GR.grams(train, features, _targets(target, n_targets))
    runs = {"single_target": GR.combinations(g, np.eye(n_targets)), "chain": GR.chain(g, chain), "stacking": GR.stack(g)}
    return {name: df.withColumn("pred", GR.predicted(coef, features)) for name, coef in runs.items()}


def random_forest(df: DataFrame, features: list[str], n_targets: int, train: DataFrame, trees: int = 10, seed: int = 1,
                  target: str = "target") -> DataFrame:
    """Random forest per target (pyspark.ml), all fitted on one assembled training frame."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    va = VectorAssembler(inputCols=list(features), outputCol="_x")
    tr = va.transform(train)
    out = va.transform(df)
    for j in range(n_targets):
        rf = RandomForestRegressor(featuresCol="_x", labelCol=f"_t{j}", predictionCol=f"_p{j}", numTrees=trees, seed=seed, maxDepth=5)
        model = rf.fit(tr.withColumn(f"_t{j}", F.col(target)[j]).filter(F.col(f"_t{j}").isNotNull()))
        out = model.transform(out)
    return out.withColumn("pred", F.array(*[F.col(f"_p{j}") for j in range(n_targets)])).drop("_x", *[f"_p{j}" for j in range(n_targets)])
