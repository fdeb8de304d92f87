"""Session factory, and shipping of this package to executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: str = "8", app: str = "ledgerloom", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([str(ROOT), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """In local mode, put the package on the workers' path once, unless it is there. A cluster gets it by --py-files or PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", False) or not sc.master.startswith("local"):
        return
    sc._ledgerloom_shipped = True
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "ledgerloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
        for p in ("corpus_pipeline.py",):
            if (ROOT / p).exists():
                z.write(ROOT / p, p)
    sc.addPyFile(str(archive))


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder's URI under spark.checkpoint.dir, seen by driver and executors alike; it goes when the driver's JVM ends.

    Without that setting, a temporary one in local mode and an error on a cluster.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
        base = _LOCAL[0]
    folder = f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table in a shared folder: its lineage is cut, and it outlives a lost executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
