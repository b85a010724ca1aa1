"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: int | str = "*", name: str = "vigilume", memory: str = "8g", shared: str | None = None
) -> SparkSession:
    """A single-machine session for tests and benchmarks; on a cluster bring your own."""
    partitions = "8" if cpus == "*" else str(cpus)
    builder = SparkSession.builder if shared is None else SparkSession.builder.config("spark.checkpoint.dir", shared)
    return (
        builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # call sites of column expressions are not recorded: plans here are wide, and each costs round trips
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_local_roots: dict[str, str] = {}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application; ``--py-files`` does the same at its start.

    Functions that run inside workers refer to its modules, which workers otherwise find only where the package is
    installed or the driver's folder is on their path.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = f"{tempfile.mkdtemp(prefix='vigilume-')}/vigilume-package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; where that is unset a local one, in local mode only.

    On several machines each executor would write to a disk of its own, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="vigilume-")
        root = _local_roots[app]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: an intermediate result that
    several later steps use, and that survives the loss of executors. See :func:`discard`."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more.

    It does so when the driver's garbage collector finds them, which a driver with little to do may not run for long.
    """
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` whose last reader has run, and the shuffle files behind them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0].sparkSession)
