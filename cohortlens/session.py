"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder that driver and executors share; the one setting that names it.
SHARED_KEY = "spark.checkpoint.dir"

#: What the plans rely on; pass it to the builder (``SparkSession.builder.config(map=SETTINGS)``).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lets small inputs be read by all cores; large ones are cut at maxPartitionBytes
    # whatever this is.
    "spark.sql.files.openCostInBytes": str(1 << 20),
}

_LOCAL: dict[str, str] = {}


def strict(spark: SparkSession) -> SparkSession:
    """``spark`` with :data:`SETTINGS` applied; for sessions that this code creates."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint directory.
    In a single-process session (``local[...]``) that names neither, a folder of its own
    that goes when the process ends; on a cluster that is an error."""
    folder = spark.conf.get(SHARED_KEY, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {SHARED_KEY} to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="cohortlens-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that later
    stages see one fixed copy whichever executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame | None) -> None:
    """Delete tables of :func:`cut_lineage` that nothing reads any more: all that was made
    of them is itself written."""
    for df in written:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()} if df is not None else ():
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    context = spark.sparkContext
    name = context._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(context._jsc.hadoopConfiguration()).exists(name)
