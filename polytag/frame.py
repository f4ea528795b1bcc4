"""The multi-label table: a DataFrame plus the names of its label and feature columns.

Rows stay rows.  Labels live in one ``y ARRAY<INT>`` column (position = label
index, NULL element = missing label).  The wide form (one 0/1 column per label)
and the long form (one row per row and label) are projections of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MLFrame:
    df: DataFrame
    labels: tuple[str, ...]
    features: tuple[str, ...] = ()
    id_col: str = "id"
    y_col: str = "y"
    # optional label hierarchy: DataFrame(label STRING, idx INT, parent STRING, parent_idx INT, depth INT)
    tree: DataFrame | None = field(default=None, compare=False)

    @property
    def L(self) -> int:
        return len(self.labels)

    @property
    def y(self) -> Column:
        return F.col(self.y_col)

    def with_df(self, df: DataFrame, **kw) -> "MLFrame":
        return replace(self, df=df, **kw)

    def label_index(self, name: str) -> int:
        return self.labels.index(name)

    def long(self, *extra: str) -> DataFrame:
        """(id, j, t) — one row per row and label; ``extra`` columns ride along."""
        return self.df.select(self.id_col, *extra, F.posexplode(self.y_col).alias("j", "t"))

    def wide(self) -> DataFrame:
        """One INT column per label, named after the label."""
        return self.df.select(
            self.id_col, *self.features, *[F.col(self.y_col)[j].alias(n) for j, n in enumerate(self.labels)]
        )

    @staticmethod
    def from_wide(df: DataFrame, label_cols, feature_cols=(), id_col: str = "id", y_col: str = "y") -> "MLFrame":
        label_cols = tuple(label_cols)
        out = df.select(
            id_col, *feature_cols, F.array(*[F.col(c).cast("int") for c in label_cols]).alias(y_col)
        )
        return MLFrame(out, label_cols, tuple(feature_cols), id_col, y_col)

    @staticmethod
    def labels_by_position(df: DataFrame, n: int, labels_first: bool = False, id_col: str = "id") -> "MLFrame":
        """Last ``n`` (or first ``n``) non-id columns are the labels."""
        cols = [c for c in df.columns if c != id_col]
        labs = cols[:n] if labels_first else cols[-n:]
        feats = cols[n:] if labels_first else cols[:-n]
        return MLFrame.from_wide(df, labs, feats, id_col)
