"""Session helpers: tables, lineage cuts and spread of small inputs."""

from __future__ import annotations

import gc
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group as files have them by default.
ROW_GROUP = 128 << 20


def session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", checkpoint_dir: str | None = None) -> SparkSession:
    """A session with the settings the engine is written for: AQE with skew
    joins, UTC, Arrow. checkpoint_dir: a folder that all executors share; a
    local master gets a temporary one."""
    if checkpoint_dir is None and master.startswith("local["):
        checkpoint_dir = tempfile.mkdtemp(prefix="citeflow-checkpoint-")
    builder = SparkSession.builder.master(master)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = (
        builder.appName("citeflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once a context, so
    that they can import it wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_citeflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # else the package itself comes from an archive that is shipped already
        with zipfile.ZipFile(path := f"{tempfile.mkdtemp(prefix='citeflow-code-')}/citeflow.zip", "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"citeflow/{f.relative_to(root)}")
        sc.addPyFile(path)
    sc._citeflow_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder of the context, if it has none: the one that
    the session names in ``spark.checkpoint.dir``. Where that is unset a
    temporary folder serves a local master alone; on a cluster, where no other
    machine could read it, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="citeflow-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, see ``checkpoints``."""
    ship(df.sparkSession)
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers
    to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def splits(df: DataFrame) -> int:
    """Tasks among which the rows of a plan come divided; 0 for one with
    shuffles. A split of a file counts if a row group of the usual size can lie
    in it."""
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return 0
    parts, files = df._jdf.rdd().getNumPartitions(), len(df.inputFiles())
    return min(parts, max(files, _bytes(df) // ROW_GROUP)) if files else parts


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Rows divided among as many tasks as the session has cores, at least, for
    stages that do much work for each row. With cols, rows of equal values meet.

    Without cols, only a plan that comes in fewer splits than there are cores is
    shuffled; that moves at most two row groups for each core, whatever the
    input. A larger one has splits enough and is left as it is."""
    spark = df.sparkSession
    ship(spark)
    cores = spark.sparkContext.defaultParallelism
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores)
    if cols:
        return df.repartition(n, *cols)
    return df if _bytes(df) >= 2 * cores * ROW_GROUP or splits(df) >= cores else df.repartition(n)
