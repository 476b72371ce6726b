"""What the training-data operators share: inputs, stored tables, batch sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.session import need_local, ship

#: Rows without an id sort first and take this key internally.
NULL_ID = -(2**63)


def tune(spark: SparkSession) -> None:
    """Make the package known to Python workers, and bound the Arrow batches that they get, as texts may be very long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


#: What operators remember in a Python worker from task to task, by name, and how to forget it.
REMEMBERED: dict[str, Callable[[], object]] = {}


def remember_only(*names: str) -> None:
    """Forget what other operators have left in this worker, which serves one stage after the other."""
    for name, forget in REMEMBERED.items():
        if name not in names:
            forget()
    give_back()


def give_back() -> None:
    """Return what is free in this process to the system: workers live through many stages, and each leaves its own holes."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): only what the operators read; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset in a local session (tests), an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        need_local(spark)
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Store:
    """Tables written to the shared folder. They cut lineage, survive lost executors and are read by column.

    keep=False tables can be dropped as soon as later tables are written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def forget_shuffles(self) -> None:
        """Shuffle files of finished jobs go when the driver's JVM collects what refers to them; ask for that between large steps."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()
