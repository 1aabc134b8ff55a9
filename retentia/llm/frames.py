"""Small helpers of the training-data operators: held tables and column names that never clash."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staging_path


def hold(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: lineage ends there.

    ``options`` go to the writer.  A lost executor then costs a reread of these files, never a recomputation.
    """
    spark = df.sparkSession
    path = staging_path(spark, f"llm/{uuid.uuid4().hex}")
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._held_path = path
    return out


def release(*held: DataFrame) -> None:
    """Delete tables made by ``hold`` that no later plan reads."""
    for df in held:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._held_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` would, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "retentia.zip")  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and the old name's new name: helper columns beside them cannot clash."""
    new = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), new


def pieces(df: DataFrame, column: str, target_bytes: int) -> int:
    """How many groups of about ``target_bytes`` the column's values make (one small aggregate)."""
    total = df.agg(F.sum(F.octet_length(F.col(column)).cast("long") + 16)).first()[0] or 0
    return max(1, -(-int(total) // target_bytes))
