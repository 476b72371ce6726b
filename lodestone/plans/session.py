"""Sessions: configuration, and the package itself on the executors."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's configuration; underscores in names of `conf` stand for dots."""
    builder = SparkSession.builder.appName(app).config(map=CONF | {k.replace("_", "."): v for k, v in conf.items()})
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lodestone", os.path.relpath(full, package)))
    context.addPyFile(path)
    context._lodestone_shipped = True


def need_local(spark: SparkSession) -> None:
    """An error on a cluster that names no shared folder: one of this machine's own would not be seen by the others."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


def checkpoint(df):
    """The rows of df without its lineage, in the session's checkpoint folder (an own one only where none is set, in a local session)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            need_local(spark)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return df.checkpoint()


def stored(df):
    """The same, by column and compressed: for tables of many rows that are read several times."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        need_local(spark)
        folder = tempfile.mkdtemp(prefix="lodestone-stored-")
    path = f"{folder.rstrip('/')}/stored-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver's JVM collects what refers to them; ask for that between large steps."""
    gc.collect()
    spark._jvm.System.gc()
