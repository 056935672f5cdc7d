"""Session construction and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

# Settings the library wants when nobody else has chosen them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "citeloom") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter owns these settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CITELOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings every operator relies on; call it once on a session made elsewhere.

    A union of equally partitioned inputs keeps their partitioning since Spark 4.1, and adaptive coalescing may
    then change one input but not the other, which fails at run time. Unions here never need that property.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    _ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="citeloom-code-"), "citeloom")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root_dir=root, base_dir="citeloom"))
        _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, else (local tests only) a fresh one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="citeloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other job uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of many MB: parquet looks at its size after every row, not after a hundred, and ends a row group, which readers and
#: writers hold in memory, at 16 MB or after one longer row.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of jobs that nothing refers to any more; by itself it does when the driver runs out of heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """``rows``, marked for broadcast if a count shows at most ``most`` of them; a longer table is joined as usual."""
    return broadcast(rows) if rows.count() <= most else rows


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a table that arrives in fewer splits than there are workers; larger inputs pass unchanged.

    A file with one row group is read by one task, which would then do all the text work alone.
    """
    workers = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(workers) if df.rdd.getNumPartitions() < workers else df
