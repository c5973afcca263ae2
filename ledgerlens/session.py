"""Session helpers: a configured local session for tests and benches, and the
shared scratch folder (``spark.checkpoint.dir``) used for staging writes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


JIT_FLAGS = "-XX:-DontCompileHugeMethods"

# Settings for a large cluster (100 TB of journal lines).  Shuffles carry
# partial aggregates only, so many small shuffle partitions that AQE
# coalesces at run time are the right default; larger file splits keep the
# ingest's offsets sidecar (one row per split) small.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.executor.extraJavaOptions": JIT_FLAGS,
    # spark.checkpoint.dir must point at shared storage (HDFS / object store).
}


def _driver_memory() -> str:
    """Local driver heap: 60% of physical memory, between 1 and 8 GiB."""
    if os.environ.get("LEDGERLENS_DRIVER_MEMORY"):
        return os.environ["LEDGERLENS_DRIVER_MEMORY"]
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    mib = int(total * 0.6) // (1 << 20)
    return f"{max(1024, min(8192, mib))}m"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens") -> SparkSession:
    """Local session with the settings the library is tuned for (tests/bench only)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", _driver_memory())
        # Wide validation/transform projections generate methods above HotSpot's
        # 8000-byte JIT limit; without this they run interpreted (2-3x slower).
        # On a cluster set the same flag in spark.executor.extraJavaOptions.
        .config("spark.driver.extraJavaOptions", JIT_FLAGS)
        .config("spark.executor.extraJavaOptions", JIT_FLAGS)
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for staging data: the cluster's checkpoint dir.

    On a cluster ``spark.checkpoint.dir`` must name a shared file system; we
    never fall back to a machine-local folder there.  Only in local mode (tests,
    benches) do we create one under the system temp folder when it is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...) "
            "so staging data survives executor loss")
    path = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` stored once in the shared checkpoint folder; survives lost executors."""
    spark = df.sparkSession
    root = scratch_root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path of the shared scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared scratch folder: computed a
    single time, and read column by column afterwards."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Recursively delete ``path`` on whatever file system it lives on."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def path_is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath) and fs.getFileStatus(hpath).isDirectory())


def move_path(spark: SparkSession, source: str, dest: str) -> None:
    """Rename a folder on its file system."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(source)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(hpath, jvm.org.apache.hadoop.fs.Path(dest)):
        raise OSError(f"cannot move {source} to {dest}")


def list_entries(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what lies directly in a folder; none if there is
    no such folder."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    return [(status.getPath().getName(), bool(status.isDirectory())) for status in fs.listStatus(top)]


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files below a folder, without hidden ones and folders
    (names starting with ``_`` or ``.``)."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [top]
    while todo:
        for status in fs.listStatus(todo.pop()):
            name = status.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if status.isDirectory():
                todo.append(status.getPath())
            else:
                found.append(name)
    return found
