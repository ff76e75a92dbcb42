"""Session construction and the shared-folder helpers every plan uses."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "fathom", shuffle_partitions: int = 8, driver_memory: str = "4g") -> SparkSession:
    """A session with the settings the plans are written for.

    On a cluster the caller's own settings win: only what is not set yet is set.
    """
    builder = SparkSession.builder.appName(app).master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def exact_unions(spark: SparkSession) -> None:
    """Turns off the planning of unions as if both sides were partitioned alike.

    With it, Spark 4.1 leaves out the exchange after a union of two hash-partitioned sides although adaptive
    execution may have joined their partitions differently: aggregates and windows over the union then come out wrong
    (seen with reciprocal rank fusion below a self join). Older versions do not have the setting.
    """
    key = "spark.sql.unionOutputPartitioning"
    if spark.conf.get(key, None) == "true":
        spark.conf.set(key, "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset a folder is made, but only for a local master: a machine's own
    folder would not survive the loss of that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="fathom-shared-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


_passing: list[str] = []


def shared_path(spark: SparkSession, label: str, suffix: str = "", lasting: bool = False) -> str:
    """A new path below the shared folder, deleted when the driver ends, or before, at the end of ``intermediates``, unless it is ``lasting``."""
    path = f"{shared_dir(spark)}/fathom/{label}-{uuid.uuid4().hex}{suffix}"
    atexit.register(_drop, spark, path)
    if not lasting:
        _passing.append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that plans made inside it wrote to the shared folder; what they gave must be written by then."""
    mark = len(_passing)
    try:
        yield
    finally:
        for path in _passing[mark:]:
            _drop(spark, path)
        del _passing[mark:]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the context may be gone already
        if path.startswith("file://") and os.path.isdir(path[7:]):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


def write_shared_file(spark: SparkSession, label: str, content: bytes, suffix: str = "", lasting: bool = False) -> str:
    """Writes bytes to a file in the shared folder and returns its path."""
    path = shared_path(spark, label, suffix, lasting)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for at in range(0, len(content), 1 << 20):
            stream.write(bytearray(content[at : at + (1 << 20)]))
    finally:
        stream.close()
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as a table in the shared folder and reads it again.

    The table survives the loss of any executor, is read with column pruning and gives
    the next plan real sizes to choose its joins by.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least_bytes: int = 8 << 20) -> DataFrame:
    """Deals the rows of a small input out to all cores, before work that costs far more than reading it.

    A small table may lie in one row group, which one task reads and works on alone. Inputs of more than
    ``least_bytes`` a core have splits enough and are left as they are; filters and column pruning still
    reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < least_bytes * cores else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application; the file lies in the shared folder."""
    import io
    import pathlib
    import zipfile

    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent).as_posix())
    path = write_shared_file(spark, "package", held.getvalue(), ".zip", lasting=True)
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)
