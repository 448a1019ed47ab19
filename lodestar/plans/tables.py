"""Written tables in the folder that driver and executors share: they end a lineage, and outlive a lost executor."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process (tests), a folder of our own, set as the checkpoint
    folder too. On a cluster no folder of the driver's machine will do, so an unset one is an error there."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unique folder name below the shared folder."""
    return f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What is planned and run within it removes the files of its own shuffles as it ends; otherwise they lie on the executors'
    disks until the driver's memory is next collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table."""
    path = scratch(df.sparkSession, name)
    with tidied(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_folders(df: DataFrame, column: str, folders: int | None, name: str) -> str:
    """The path of df as a written table with a folder for each value of column (0 to folders - 1), for tasks that read folders
    by themselves (folder_of). folders: none where df is dealt out by column already."""
    path = scratch(df.sparkSession, name)
    with tidied(df.sparkSession):
        (df if folders is None else df.repartition(folders, column)).write.option("compression", "zstd").partitionBy(column).parquet(path)
    return path


def folder_of(path: str, column: str, value: int) -> list:
    """The Arrow tables of one folder of in_folders(), in a task; none where no row has that value."""
    fs, root = pafs.FileSystem.from_uri(path)
    files = fs.get_file_info(pafs.FileSelector(f"{root}/{column}={value}", allow_not_found=True))
    return [pq.read_table(f, filesystem=fs, partitioning=None) for f in sorted(f.path for f in files) if f.endswith(".parquet")]


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by written() once nothing needs it."""
    for f in {p.rpartition("/")[0] for p in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
