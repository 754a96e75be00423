"""Intermediate tables in the shared folder that the session names.

Lineage is cut by writing a table and reading it back: an executor that is
lost later costs no recomputation, and the files can be read by all.
"""

from __future__ import annotations

import gc
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


_SHIPPED: set[str] = set()
#: Rows of an Arrow batch, where the session has Spark's own default: texts are long, and a batch is held several times over.
BATCH_ROWS = 1000


def ship_code(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, as ``--py-files``
    does, once per application: workers need not have it installed. Also
    bounds the rows of an Arrow batch."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join(name, os.path.relpath(path, top)))
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-code-"), f"{name}-{uuid.uuid4().hex}.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and broadcasts of what ran before.
    Its cleaner follows the collection of plans that nothing refers to any
    more, which a driver with little to do leaves for half an hour: meanwhile
    they fill executors' disks and the driver's memory."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """A fresh folder under ``spark.checkpoint.dir`` for one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        tidy(spark)
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        ship_code(spark)

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` written once (compressed well, as disk is what such tables
        cost) and read back; the shuffle files behind it are of no use then."""
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        tidy(self.spark)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that :meth:`save` returned and that nothing reads any
        more, and what Spark keeps of plans that are done."""
        for df in tables:
            self._remove(df._scratch_path)
        tidy(self.spark)

    def clear(self) -> None:
        """Remove all tables saved so far, once nothing reads any of them."""
        self._remove(self.path)
        tidy(self.spark)

    def _remove(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` as a broadcast side if it has at most ``most`` (narrow) rows;
    larger ones are left for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
