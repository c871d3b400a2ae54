"""Session builder and cluster-safe scratch space."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_OWN_FOLDERS: set[str] = set()


def build_session(app: str = "chelarium", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings this package relies on; anything already set by the launcher wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent on a single machine (tests) is a local folder made and set; on a cluster that is an error, as
    executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        local = tempfile.mkdtemp(prefix="chelarium-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.sparkContext.setCheckpointDir(base)
    own = f"{base.rstrip('/')}/chelarium-{spark.sparkContext.applicationId}"
    if own not in _OWN_FOLDERS:
        _OWN_FOLDERS.add(own)
        atexit.register(_drop, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def _drop(spark: SparkSession, path: str) -> None:
    """What an application has settled is removed when it ends; results may be read until then."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has been stopped before: nothing can be reached any more
        pass


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is executed within are removed as it ends; otherwise they stay until the driver happens to collect its garbage twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder in the file system that the path belongs to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_settled(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files behind a settled frame that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_chelarium_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="chelarium-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "chelarium.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._chelarium_shipped = True
