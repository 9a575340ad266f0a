"""What the operators share: reading tables, one row per document, folders all machines see, and shipping the code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Bytes of one Arrow batch sent to Python; a row alone may be larger.
BATCH_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once, and bound the batches they get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if not getattr(context, "_glycoflow_shipped", False):
        target = os.path.join(tempfile.mkdtemp(prefix="glycoflow-"), "glycoflow_package.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for folder, _, names in os.walk(PACKAGE):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.join("glycoflow", os.path.relpath(path, PACKAGE)))
        context.addPyFile(target)
        context._glycoflow_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master, as in tests, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = getattr(spark.sparkContext, "_glycoflow_folder", None) or "file://" + tempfile.mkdtemp(prefix="glycoflow-")
        spark.sparkContext._glycoflow_folder = root
    return f"{root.rstrip('/')}/glycoflow-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are kept inside, but for lasting ones, are removed at the end."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept_table(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write the rows as a table in the shared folder and read them from there: the lineage ends.

    What was shuffled on the way is removed at once rather than when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    if _scratch and not lasting:
        _scratch[-1].append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def by_document(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, text): one row per document, dealt by doc_id.

    Rows without doc_id are no documents. Of several rows with one doc_id, the greatest text counts, a null text
    being the least.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("text") if text is None else text).cast("string").alias("text")
    )
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").desc_nulls_last()))
    return rows.withColumn("place", place).where("place = 1").drop("place")
