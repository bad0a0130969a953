"""Written tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: a lost
executor then costs a re-read, never a recomputation from the source.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_FREED_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the inputs' files for each bucket of a table that is kept by a key, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 8


#: The temporary folder of an application for which none is named.
_TEMPORARY: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, a temporary one in a single process (tests) and an error on a cluster."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors of {master} share")
        name = spark.sparkContext.applicationId
        if name not in _TEMPORARY:
            _TEMPORARY[name] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        root = _TEMPORARY[name]
    if ":" not in root:  # a path of the cluster's default file system; tasks that write files need it in full
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().replace("file:/", "file:///", 1)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """The URI of a folder that no other call gets."""
    return f"{shared_root(spark)}/sparkloom/{tag}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run within are deleted where it ends; else they fill the disks until the driver's next collection of garbage."""
    before = spark.conf.get(_FREED_KEY, None)
    spark.conf.set(_FREED_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED_KEY) if before is None else spark.conf.set(_FREED_KEY, before)


def written(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read back."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    with freed(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are sorted by the key, and neither is sent whole through the driver to all tasks, however few bytes its files have."""
    return df.hint("merge")


def content_key(spark: SparkSession, paths: list[str]) -> str:
    """A name of what tables of files hold: their paths, times of change, sizes and numbers of files, as the file system tells them."""
    facts = []
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        status, whole = files.getFileStatus(path), files.getContentSummary(path)
        facts.append(f"{status.getPath()} {status.getModificationTime()} {whole.getLength()} {whole.getFileCount()}")
    return hashlib.sha1("|".join(facts).encode()).hexdigest()


def kept(spark: SparkSession, tag: str, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of the tables at ``paths``, written once for as long as these stay the same; ``tag`` names the making and its version."""
    final = f"{shared_root(spark)}/sparkloom/kept-{tag}-{content_key(spark, paths)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(final)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        made = new_folder(spark, tag)
        with freed(spark):
            build().write.option("compression", "zstd").parquet(made)
        files.rename(spark._jvm.org.apache.hadoop.fs.Path(made), path)  # whole or not at all; another run's table serves as well
        if not files.exists(path):
            final = made
    return spark.read.parquet(final)


def buckets_of(spark: SparkSession, paths: list[str]) -> int:
    """How many buckets a table has that is kept of the tables at ``paths``."""
    sizes = []
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        sizes.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength())
    return max(LEAST_BUCKETS, -(-sum(sizes) // BUCKET_BYTES))


def _in_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    spark, name = df.sparkSession, f"sparkloom_{uuid.uuid4().hex}"
    with freed(spark):
        df.write.format("parquet").bucketBy(buckets, key).options(compression="zstd", path=path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, since it has a path of its own


def _of_buckets(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    name = f"sparkloom_{hashlib.sha1(path.encode()).hexdigest()}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (path '{path}') CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS")
    return spark.table(name)


def written_by(df: DataFrame, tag: str, key: str) -> DataFrame:
    """As ``written``, in as many buckets by a key as a shuffle has partitions: what a shuffle dealt by the key is written as it is, and joins of such tables by the key need no other."""
    path, buckets = new_folder(df.sparkSession, tag), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _in_buckets(df, path, key, buckets)
    return _of_buckets(df.sparkSession, path, key, buckets)


def kept_by(spark: SparkSession, tag: str, paths: list[str], key: str, build: Callable[[int], DataFrame]) -> DataFrame:
    """As ``kept``, in buckets by a key: what is grouped by the key, and by whatever besides, needs no shuffle. ``build`` gets the number of buckets and deals its rows by it and the key."""
    buckets = buckets_of(spark, paths)
    final = f"{shared_root(spark)}/sparkloom/kept-{tag}-{content_key(spark, paths)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(final)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        made = new_folder(spark, tag)
        _in_buckets(build(buckets), made, key, buckets)
        files.rename(spark._jvm.org.apache.hadoop.fs.Path(made), path)
        if not files.exists(path):
            final = made
    return _of_buckets(spark, final, key, buckets)


def spread(df: DataFrame) -> DataFrame:
    """The table over at least as many tasks as the session has cores; one whose rows lie in fewer is dealt anew, else it stays as it is read. Rows are looked for, since a file is split by its bytes, but each of its row groups is read by one task, however large it is."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    filled = parts if parts < cores else df.select(F.spark_partition_id().alias("part")).distinct().count()
    return df.repartition(max(cores, parts)) if filled < cores else df
