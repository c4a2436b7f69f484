"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the operators rely on; everything else is left to the deployment.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("glyphweir")
    settings = REQUIRED | {
        "spark.sql.shuffle.partitions": str(partitions or cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in (settings | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> None:
    """Applies the runtime settings in REQUIRED to a session made elsewhere."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or of the context where that has one.

    Only where neither is set: a temporary folder in local mode, as in tests, else a folder in the warehouse, which all
    executors reach."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not named:
        local = context.master.split("[")[0] == "local"
        named = os.path.join(tempfile.gettempdir(), "glyphweir-checkpoints") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/glyphweir-checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that goes when the program ends."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            remove(spark, path)

    atexit.register(clean)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so that a lost executor costs no recomputation of the past."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """Number of tasks of a repartition before CPU-heavy Python work: adaptive coalescing by bytes would leave too few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def block_count(df: DataFrame, block_bytes: int) -> int:
    """Number of blocks for hashing the rows of ``df``, at least one a task: follows the size of its input as the optimizer
    estimates it, so that a block stays in bounds whatever the number of shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_width(df.sparkSession), min(size // block_bytes, 1 << 30))


def checked_broadcast(df: DataFrame, bound: int) -> DataFrame:
    """``df`` marked for broadcast if it has ``bound`` rows at most, else as it is: then joins shuffle both sides."""
    rows = df.limit(bound + 1).collect()
    return df if len(rows) > bound else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def unfolded(df: DataFrame) -> DataFrame:
    """``df``, whose rows were unfolded from few, marked so that joins shuffle it: Spark takes it to be as large as before
    it was unfolded and would hand it to all tasks through the driver."""
    return df.hint("merge")


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, which grows with the tables, marked so that joins shuffle it: adaptive execution knows its compressed bytes only
    and would hand to all tasks, through the driver, what takes several times as much memory there."""
    return df.hint("merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in as many parts as tasks run at once, before its few rows are unfolded into many."""
    return df.repartition(shuffle_width(df.sparkSession), key)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each Spark context, unless their PYTHONPATH already names its folder."""
    home = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(home) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_glyphweir_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="glyphweir-")) / "glyphweir.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for path in sorted((home / "glyphweir").rglob("*.py")):
            packed.write(path, path.relative_to(home))
    context.addPyFile(str(archive))
    context._glyphweir_shipped = True  # type: ignore[attr-defined]
