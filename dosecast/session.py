"""Session settings and durable scratch storage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

TASK_BYTES = 128 << 20  # what a scan gives one task by default

_shipped: set[str] = set()
_scratch: list[str] = []


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dosecast")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="dosecast-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that intermediate tables go to.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    go without one; it gets a fresh temporary folder.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="dosecast-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has used before."""
    folder = f"{scratch_root(spark)}/dosecast-{uuid.uuid4().hex}"
    _scratch.append(folder)
    return f"{folder}/{name}"


def scratch_folders() -> list[str]:
    """The folders of this process's intermediate tables, oldest first."""
    return list(_scratch)


def drop_scratch(spark: SparkSession, folders: list[str] | None = None) -> int:
    """Delete intermediate tables (all of this process by default), once the results built on them are written."""
    jvm = spark.sparkContext._jvm
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    for folder in scratch_folders() if folders is None else folders:
        if folder not in _scratch:
            continue
        _scratch.remove(folder)
        path = jvm.org.apache.hadoop.fs.Path(folder)
        dropped += bool(path.getFileSystem(configuration).delete(path, True))
    return dropped


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the jobs of a ``with`` block, as it was afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input to all cores before row work that is dear; leave a large one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * TASK_BYTES else df


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage (a lost executor costs a re-read, not a re-run) and gives
    the planner true sizes, so it can choose broadcast joins by itself.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
