"""Session building and the few settings the library reads from it."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "siltstone", cores: int | None = None, shuffle: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SILTSTONE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master gets a temporary one; elsewhere that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        at = sc._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
        if at is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="siltstone-")
            sc.setCheckpointDir(at)
    return at.rstrip("/")


def on_workers(spark: SparkSession) -> None:
    """Puts this package on the path of Python workers, where functions of it run."""
    here = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what uses it twice computes it once."""
    path = f"{shared_dir(df.sparkSession)}/stored/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Changes with the layout of what is kept, so that nothing of an older one is read.
LAYOUT = 4


def place_of(spark: SparkSession, sf_dir: str, name: str, what: str) -> str:
    """A folder in the shared one for what is made of a table's present files: another one as soon as they change."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    state = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return f"{shared_dir(spark)}/kept/{what}-{hashlib.sha256(repr((LAYOUT, state)).encode()).hexdigest()[:24]}"
