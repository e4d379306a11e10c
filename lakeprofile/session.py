"""Shared scratch space and task sizing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Scratch folders of local sessions that name none themselves.
_local_roots: dict[str, str] = {}
# Scratch paths handed out, by application.
_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is missing, a local session gets a temporary folder; a cluster session is refused,
    because a folder on one machine would not outlive (or even be seen by) its executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
        application = spark.sparkContext.applicationId
        if application not in _local_roots:
            _local_roots[application] = tempfile.mkdtemp(prefix="lakeprofile-")
        root = _local_roots[application]
    path = qualify(spark, f"{root.rstrip('/')}/lakeprofile/{uuid.uuid4().hex}/{label}")
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Removes what this session has written to scratch space; returns how many folders went.

    For callers that have saved their results: DataFrames that still read from scratch space can't be used afterwards.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    gone = 0
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        gone += bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))
    return gone


def qualify(spark: SparkSession, path: str) -> str:
    """Absolute form of ``path`` under the session's default file system; local paths carry no scheme."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = file_system.makeQualified(hadoop_path).toString()
    default = jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    if full.startswith("file:") and default == "file":
        full = "/" + full[len("file:"):].lstrip("/")
    return full


def rename_once(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file to a name that is free; ``FileExistsError`` if it isn't. One step on HDFS and local disks."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source_path, target_path = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    # The rename of a file context doesn't replace what is there.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source_path.getFileSystem(conf).getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(source_path, target_path, options)
    except Exception as problem:
        if target_path.getFileSystem(conf).exists(target_path):
            raise FileExistsError(target) from problem
        raise


def literal_glob(path: str) -> str:
    """``path`` for a reader of Spark, which would take some characters of it for a pattern."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", path)


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """Materialise ``df`` in shared scratch space and read it back: short lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows that stand for much work each (files, chunks) evenly over the cluster.

    Rows are dealt in turn, not by a hash of ``keys``, which would give some tasks several and others none; ``keys`` only
    say what tells the rows apart. The partition count is explicit, because adaptive execution would merge such tiny rows into
    one task. It follows ``spark.sql.shuffle.partitions``, the setting a large job is tuned by, and two tasks per core at least.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
