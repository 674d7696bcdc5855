"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent on one machine (tests) a temporary folder is
    made and set; it is removed when the process ends. On a cluster the setting
    is needed: RuntimeError without it, as executors would write to different
    disks. Checkpoints that nothing refers to any more are removed by Spark.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    clean = "spark.cleaner.referenceTracking.cleanCheckpoints"
    if not sc.getConf().contains(clean):
        sc._jsc.sc().conf().set(clean, "true")  # read whenever a checkpoint is made
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="corvidex-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
        sc.setCheckpointDir(current)
    return current


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there is removed when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, with its lineage cut.

    Lost executors don't matter: the rows are files that every executor reads.
    The files go when the frame does.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Makes this package known to the Python workers of the session, once, wherever it is installed.

    Workers unpickle functions and models by the names of their modules; without
    this an executor needs the package on its own path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_corvidex_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(sc._temp_dir, "corvidex_package.zip")  # the context's own folder on the driver; Spark hands the file out
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), os.path.dirname(home)))
    sc.addPyFile(name)
    sc._corvidex_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_session(app: str = "corvidex", master: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
