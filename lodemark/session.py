"""Session helpers: a tuned session for local use and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the engine assumes (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


SMALL_INPUT, SPREAD_FROM = 256 << 20, 1 << 20
#: Bytes of a file's table that a task gets where tables are dealt anew.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame, size: int) -> DataFrame:
    """``df``, read from ``size`` bytes of files, dealt anew where a few of its tasks would have most of the rows.

    A row group is not split, so a large file in one row group is one task, whatever the number of its
    splits. Counting rows by partition reads no column. Tables whose largest task has no more than a core's
    share, or what is in ``SPREAD_BYTES``, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if not rows["all"]:
        return df
    most = size * rows["most"] / rows["all"]
    if most <= SPREAD_BYTES or rows["most"] * cores <= 1.5 * rows["all"]:
        return df
    return df.repartition(max(cores, -(-size // SPREAD_BYTES)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder. One that is small and in fewer files than there are cores is dealt
    over the cores, since a row group is not split; a larger one if it lies in a few large row groups (``spread``)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= SPREAD_FROM:
        return df
    if size >= SMALL_INPUT:
        return spread(df, size)
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (single-machine use, tests) a temporary
    folder is made and set as the checkpoint folder; on a cluster executors would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if not have:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodemark-"))
        have = sc.getCheckpointDir()
    return have.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/lodemark-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    A lost executor then costs no more than a read. Unlike a checkpoint, the new plan knows the true
    size of its rows; sizes estimated through repeated joins grow without bound and stall the planner.
    """
    spark = df.sparkSession
    path = work_dir(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodemark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; nothing may read it later."""
    path = getattr(df, "_lodemark_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, so that they can import it from anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lodemark-zip-")) / "lodemark_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
