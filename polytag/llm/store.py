"""Tables of an operator's intermediate results, in the folder named by ``spark.checkpoint.dir``.

A written table cuts the lineage: later stages read files that outlive any executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polytag.session import scratch_path


class Scratch:
    """Written tables of one operator run; ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, name)
        self.made = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def with_row_numbers(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` as a written table with a number of its own for every row, and that column's name."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return scratch.write(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_rest(column, modulus: int):
    """crc32 of an id's text, modulo ``modulus`` (null ids: null)."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
