"""Label hierarchy helpers: depth, descendants and validation.

The tree is an edge table (label, parent); it is label-sized.  Transitive
walks use Spark SQL's recursive CTE, so there is no driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.functions import labelsets as LS


def label_depth(tree: DataFrame) -> DataFrame:
    """(label, depth): roots have depth 1."""
    spark = tree.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE d(label, depth) AS (
          SELECT label, 1 FROM {tree} WHERE parent IS NULL
          UNION ALL
          SELECT t.label, d.depth + 1 FROM {tree} t JOIN d ON t.parent = d.label
        )
        SELECT label, CAST(depth AS INT) AS depth FROM d
        """,
        tree=tree.select("label", "parent"),
    )


def label_descendants(tree: DataFrame) -> DataFrame:
    """(label, descendant): every label below a node, at any depth."""
    spark = tree.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE r(label, descendant) AS (
          SELECT parent, label FROM {tree} WHERE parent IS NOT NULL
          UNION ALL
          SELECT r.label, t.label FROM r JOIN {tree} t ON t.parent = r.descendant
        )
        SELECT label, descendant FROM r
        """,
        tree=tree.select("label", "parent"),
    )


def validate(mlf: MLFrame, required_labels=None) -> DataFrame:
    """(rule, n): number of violations per rule.

    Rules: fewer than two labels; a required label absent from the data; a label value
    outside {0, 1} (missing is allowed); a child label set while its parent is not.
    """
    spark = mlf.df.sparkSession
    y = F.col(mlf.y_col)
    bad_value = F.exists(y, lambda x: x.isNotNull() & ~x.isin(0, 1))
    rules = [F.count(F.when(bad_value, 1)).alias("bad_value")]
    if mlf.tree is not None:
        edges = mlf.tree.filter(F.col("parent_idx").isNotNull()).select("idx", "parent_idx").collect()
        orphan = F.lit(False)
        for e in edges:
            if e["parent_idx"] < mlf.L:
                orphan = orphan | ((F.get(y, F.lit(e["idx"])) == 1) & (F.coalesce(F.get(y, F.lit(e["parent_idx"])), F.lit(0)) == 0))
        rules.append(F.count(F.when(orphan, 1)).alias("child_without_parent"))
    else:
        rules.append(F.lit(0).cast("bigint").alias("child_without_parent"))
    agg = mlf.df.agg(*rules)
    missing = [lab for lab in (required_labels or []) if lab not in mlf.labels]
    return agg.select(
        F.explode(
            F.array(
                F.struct(F.lit("too_few_labels").alias("rule"), F.lit(1 if mlf.L < 2 else 0).cast("bigint").alias("n")),
                F.struct(F.lit("label_not_in_data").alias("rule"), F.lit(len(missing)).cast("bigint").alias("n")),
                F.struct(F.lit("bad_value").alias("rule"), F.col("bad_value").cast("bigint").alias("n")),
                F.struct(F.lit("child_without_parent").alias("rule"), F.col("child_without_parent").cast("bigint").alias("n")),
            )
        ).alias("v")
    ).select("v.rule", "v.n")


def rows_missing_labels(mlf: MLFrame) -> DataFrame:
    """(id, n_missing) for rows with at least one missing label."""
    y = F.col(mlf.y_col)
    nm = F.size(F.filter(y, lambda x: x.isNull()))
    return mlf.df.filter(F.exists(y, lambda x: x.isNull())).select(mlf.id_col, nm.alias("n_missing"))


__all__ = ["label_depth", "label_descendants", "validate", "rows_missing_labels", "LS"]
